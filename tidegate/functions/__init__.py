"""Column functions: protocols, addresses, hashes, HTTP and QUIC fields, bands."""
