"""Column functions over packet rows: protocols, flags, services, networks, sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: IP protocol numbers, TCP flag bits, fragment bits, the protected server and the two source networks.
TCP, UDP, ICMP = 6, 17, 1
FIN, SYN, RST, PSH, ACK = 1, 2, 4, 8, 16
MORE_FRAGMENTS, FRAGMENT_OFFSET = 0x2000, 0x1FFF
SERVER_IP = 168427778
NETWORKS = (("baseline", 168427776, 168428031), ("attack", 168428032, 168428287))


def protocol_name(proto: Column) -> Column:
    return F.when(proto == TCP, "tcp").when(proto == UDP, "udp").when(proto == ICMP, "icmp").otherwise("other")


def has_flag(flags: Column, bit: int) -> Column:
    """Whether a TCP flag is set; false where there are no flags."""
    return F.coalesce(flags.bitwiseAND(bit) != 0, F.lit(False))


def is_syn_ack(flags: Column) -> Column:
    return F.coalesce(flags.bitwiseAND(SYN | ACK) == SYN | ACK, F.lit(False))


def is_pure_ack(flags: Column) -> Column:
    return F.coalesce(flags == ACK, F.lit(False))


def is_fragment(frag: Column) -> Column:
    return F.coalesce(frag.bitwiseAND(MORE_FRAGMENTS | FRAGMENT_OFFSET) != 0, F.lit(False))


def is_small(length: Column, limit: int = 100) -> Column:
    return length < limit


def service_name(proto: Column, src: Column, dst: Column) -> Column:
    """The service that the ports tell; the first that fits."""
    either = lambda *ports: F.coalesce(src.isin(*ports), F.lit(False)) | F.coalesce(dst.isin(*ports), F.lit(False))
    return (
        F.when((proto == TCP) & (dst == 80), "http").when((proto == TCP) & (dst == 22), "ssh").when((proto == UDP) & either(53), "dns")
        .when((proto == UDP) & either(123), "ntp").when((proto == UDP) & either(443, 8443), "quic").otherwise("other")
    )


def network_class(ip: Column, networks=NETWORKS) -> Column:
    """The class of the address range that holds an address; for a few fixed ranges, else use ``join_networks``."""
    out = F.lit("other")
    for name, lo, hi in reversed(networks):
        out = F.when(ip.between(lo, hi), name).otherwise(out)
    return out


def direction(dst: Column, ports=(443, 8443)) -> Column:
    """in: to a service port; out: all else."""
    return F.when(F.coalesce(dst.isin(*ports), F.lit(False)), "in").otherwise("out")


def ratio(part: Column, whole: Column, digits: int = 6) -> Column:
    """part / whole, 0 where whole is 0 or null."""
    return F.round(F.when(whole > 0, part / whole).otherwise(0.0), digits)


def count_where(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def ip_to_string(ip: Column) -> Column:
    return F.concat_ws(".", *[F.shiftright(ip, s).bitwiseAND(255) for s in (24, 16, 8, 0)])


def string_to_ip(text: Column) -> Column:
    parts = F.split(text, r"\.")
    return sum((F.get(parts, i).cast("long") * (1 << (24 - 8 * i)) for i in range(4)), F.lit(0).cast("long"))


def jenkins_hash(values: list[Column]) -> Column:
    """One-at-a-time hash of bytes (columns of 0 to 255), 32 bits held in a long."""
    mask = 0xFFFFFFFF
    h = F.lit(0).cast("long")
    for b in values:
        h = (h + b).bitwiseAND(mask)
        h = (h + F.shiftleft(h, 10)).bitwiseAND(mask)
        h = h.bitwiseXOR(F.shiftright(h, 6))
    h = (h + F.shiftleft(h, 3)).bitwiseAND(mask)
    h = h.bitwiseXOR(F.shiftright(h, 11))
    return (h + F.shiftleft(h, 15)).bitwiseAND(mask)


def multiply_32(a: Column, b: int) -> Column:
    """The low 32 bits of a product; split in halves so that no intermediate leaves a long."""
    low = a * (b & 0xFFFF)
    high = F.shiftleft((a * (b >> 16)).bitwiseAND(0xFFFF), 16)
    return (low + high).bitwiseAND(0xFFFFFFFF)


def murmur_body(word: Column, seed: int = 0x9747B28C, length: int = 4) -> Column:
    """The body of Murmur2 over one 32-bit word, without tail or finalizer."""
    m = 0x5BD1E995
    k = multiply_32(word, m)
    k = multiply_32(k.bitwiseXOR(F.shiftright(k, 24)), m)
    return multiply_32(F.lit((seed ^ length) & 0xFFFFFFFF).cast("long"), m).bitwiseXOR(k)


def leading_zeros(value: Column, width: int = 32) -> Column:
    """Zeros before the first set bit of a value of ``width`` bits."""
    return F.when(value == 0, width).otherwise(width - F.length(F.bin(value))).cast("int")


def gbps(pps: Column, size: int = 700) -> Column:
    return pps * size * 8 / 1e9


def link_utilisation(rate: Column, capacity: float = 25.0) -> Column:
    return rate / capacity * 100


def band(value: Column, low: float, high: float, names=("low", "medium", "high")) -> Column:
    """names by value: up to low, up to high, above."""
    return F.when(value > high, names[2]).when(value > low, names[1]).otherwise(names[0])


def syn_ack_smoothed(syn: Column, ack: Column) -> Column:
    return F.when(ack > 10, syn / (ack + 1)).otherwise(0.0)


def syn_ack_band(ratio: Column, limits: tuple[float, float, float] = (1.0, 3.0, 5.0)) -> Column:
    """normal, elevated, suspicious or attack: how many of the limits a ratio is above."""
    low, mid, high = limits
    return F.when(ratio > high, "attack").when(ratio > mid, "suspicious").when(ratio > low, "elevated").otherwise("normal")


#: Alert levels and their codes.
ALERT_CODES = {"NONE": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}


def alert_code(level: Column) -> Column:
    return F.get(F.array([F.lit(v) for v in ALERT_CODES.values()]), F.array_position(F.array([F.lit(k) for k in ALERT_CODES]), level).cast("int") - 1)


def alert_level(code: Column) -> Column:
    return F.get(F.array([F.lit(k) for k in ALERT_CODES]), code)


def diurnal_factor(hour: Column) -> Column:
    """Expected share of the load at an hour of the day."""
    return 0.6 + 0.4 * F.sin(2 * F.pi() * (hour - 6) / 24)


def request_method(payload: Column) -> Column:
    found = F.regexp_extract(payload, "^(GET|POST|PUT|DELETE|HEAD|OPTIONS|PATCH) ", 1)
    return F.when(found == "", "OTHER").otherwise(found)


def request_path(payload: Column) -> Column:
    """The path, ended by white space, of 255 characters at most."""
    return F.left(F.regexp_extract(payload, r"^[A-Z]+ ([^\s]*)", 1), F.lit(255))


def request_header(payload: Column, name: str) -> Column:
    return F.regexp_extract(payload, rf"(?i)\r\n{name}:\s*([^\r\n]*)", 1)


def agent_family(agent: Column) -> Column:
    out = F.lit("Other")
    for name in ("Safari", "Firefox", "Chrome"):
        out = F.when(F.contains(agent, F.lit(name)), name).otherwise(out)
    return out


def url_category(path: Column) -> Column:
    low = F.lower(path)
    return (
        F.when(path.isin("/", "/index.html"), "Homepage").when(F.contains(low, F.lit("/api")), "API")
        .when(F.rlike(low, F.lit(r"\.(css|js|png|jpg|jpeg|gif|ico|svg|woff2?)$")), "Static").when(F.rlike(low, F.lit(r"\.(php|asp|aspx|jsp|html?)$")), "Dynamic")
        .when(F.rlike(low, F.lit("(ws|socket|stream|live)")), "Realtime").otherwise("Other")
    )


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, "\x1b\\[[0-9;]*[A-Za-z]", "")


def extract_number(text: Column, pattern: str, kind: str = "double") -> Column:
    """The first group of a pattern as a number (thousands may be set off by commas); 0 without a match or a number."""
    return F.coalesce(F.regexp_replace(F.regexp_extract(text, pattern, 1), ",", "").try_cast(kind), F.lit(0).cast(kind))
