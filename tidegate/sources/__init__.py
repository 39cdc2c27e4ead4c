"""Readers and writers: packet tables, frames, captures, logs, feature files, manifests."""
