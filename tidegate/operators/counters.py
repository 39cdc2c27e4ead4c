"""Windowed counters and ratios over packets.

Every counter is a conditional sum, so Spark adds up partial sums before the shuffle, and what is shuffled is a row
for each window (and key) and task. Distinct counts and entropies come from a table of (window, key) counts, not from
``distinct`` aggregates beside sums, which would copy each row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions import traffic as T

c = F.col


def window_start(width: str = "1 second", ts: str = "ts") -> Column:
    return F.window(ts, width)["start"]


def named(rows: DataFrame) -> DataFrame:
    """Aggregated rows with the start of their window as text; packets are grouped by the time itself."""
    return rows.withColumn("w", F.date_format("w", "yyyy-MM-dd HH:mm:ss"))


def counter_columns() -> dict[str, Column]:
    """All counters of a window, as aggregate columns."""
    flags = c("tcp_flags")
    net = T.network_class(c("src_ip"))
    service = T.service_name(c("proto"), c("src_port"), c("dst_port"))
    return {
        "packets": F.count("*"), "bytes": F.sum("pkt_len").cast("long"),
        "tcp": T.count_where(c("proto") == T.TCP), "udp": T.count_where(c("proto") == T.UDP), "icmp": T.count_where(c("proto") == T.ICMP),
        "syn": T.count_where(T.has_flag(flags, T.SYN)), "ack": T.count_where(T.has_flag(flags, T.ACK)), "rst": T.count_where(T.has_flag(flags, T.RST)),
        "fin": T.count_where(T.has_flag(flags, T.FIN)), "psh": T.count_where(T.has_flag(flags, T.PSH)), "syn_ack": T.count_where(T.is_syn_ack(flags)), "pure_ack": T.count_where(T.is_pure_ack(flags)),
        "frag": T.count_where(T.is_fragment(c("frag_off"))), "small": T.count_where(T.is_small(c("pkt_len"))),
        "http": T.count_where(service == "http"), "dns": T.count_where(service == "dns"), "ntp": T.count_where(service == "ntp"), "quic": T.count_where(service == "quic"),
        "baseline": T.count_where(net == "baseline"), "attack": T.count_where(net == "attack"),
    }


def window_counters(packets: DataFrame, width: str = "1 second", keys: tuple[str, ...] = (), only: tuple[str, ...] | None = None) -> DataFrame:
    """A row for each window (and key) with its counters; ``w`` is the window's start."""
    found = counter_columns()
    return packets.groupBy(window_start(width).alias("w"), *keys).agg(*[found[x].alias(x) for x in only or found]).transform(named)


def key_counts(packets: DataFrame, key: str, width: str = "1 second") -> DataFrame:
    """(window, key, n); rows without the key are left out."""
    return packets.where(c(key).isNotNull()).groupBy(window_start(width).alias("w"), c(key).alias("key")).agg(F.count("*").alias("n")).transform(named)


def entropy(counts: DataFrame, name: str, distinct: str) -> DataFrame:
    """Shannon entropy (bits) and number of keys of each window, from (w, key, n)."""
    total = counts.groupBy("w").agg(F.sum("n").alias("total"), F.sum(c("n") * F.log2("n")).alias("weighted"), F.count("*").alias(distinct))
    return total.select("w", F.round(F.log2("total") - c("weighted") / c("total"), 6).alias(name), distinct)


def feature_rows(packets: DataFrame, width: str = "1 second", seconds: float = 1.0) -> DataFrame:
    """The feature row of each window: rates, ratios, size statistics, entropies, distinct counts."""
    sizes = packets.groupBy(window_start(width).alias("w")).agg(*[v.alias(k) for k, v in counter_columns().items()], F.avg("pkt_len").alias("mean"), F.stddev_pop("pkt_len").alias("std")).transform(named)
    src = entropy(key_counts(packets, "src_ip", width), "entropy_src_ip", "unique_src_ips")
    dst = entropy(key_counts(packets, "dst_port", width), "entropy_dst_port", "unique_dst_ports")
    rows = sizes.join(src, "w", "left").join(dst, "w", "left")
    known = c("tcp") + c("udp") + c("icmp")
    return rows.select(
        "w", F.round(c("bytes") * 8 / 1e9 / seconds, 9).alias("gbps"), F.round(c("packets") / seconds, 6).alias("pps"), F.round("mean", 6).alias("avg_pkt_size"), F.round("std", 6).alias("std_dev"),
        T.ratio(c("tcp"), known).alias("tcp_ratio"), T.ratio(c("udp"), known).alias("udp_ratio"), T.ratio(c("icmp"), known).alias("icmp_ratio"),
        *[T.ratio(c(x), c("tcp")).alias(f"{x}_ratio") for x in ("syn", "ack", "rst", "fin")], T.ratio(c("frag"), c("packets")).alias("frag_ratio"), T.ratio(c("small"), c("packets")).alias("small_pkt_ratio"),
        F.coalesce("entropy_src_ip", F.lit(0.0)).alias("entropy_src_ip"), F.coalesce("entropy_dst_port", F.lit(0.0)).alias("entropy_dst_port"),
        F.coalesce("unique_src_ips", F.lit(0)).alias("unique_src_ips"), F.coalesce("unique_dst_ports", F.lit(0)).alias("unique_dst_ports"),
        F.round(c("syn") / seconds, 6).alias("syn_per_sec"), F.round(c("ack") / seconds, 6).alias("ack_per_sec"),
    )


def class_totals(packets: DataFrame, width: str = "1 second", seconds: float = 1.0) -> DataFrame:
    """Packets, bytes, Gbps and share of packets of each network class and window."""
    by = packets.groupBy(window_start(width).alias("w"), T.network_class(c("src_ip")).alias("net_class")).agg(F.count("*").alias("packets"), F.sum("pkt_len").alias("bytes")).transform(named)
    whole = by.groupBy("w").agg(F.sum("packets").alias("all_packets"))
    return by.join(whole, "w").select("w", "net_class", "packets", "bytes", F.round(c("bytes") * 8 / 1e9 / seconds, 9).alias("gbps"), F.round(100 * c("packets") / c("all_packets"), 6).alias("percent"))


def protocol_shares(packets: DataFrame) -> DataFrame:
    """Whole percentages of the services and protocols over all packets."""
    service = T.service_name(c("proto"), c("src_port"), c("dst_port"))
    one = packets.agg(F.count("*").alias("n"), *[T.count_where(service == s).alias(s) for s in ("http", "dns", "ssh")], T.count_where(c("proto") == T.ICMP).alias("icmp"), T.count_where(c("proto") == T.UDP).alias("udp"))
    return one.select(*[F.floor(100 * c(x) / F.greatest(c("n"), F.lit(1))).cast("long").alias(f"{x}_pct") for x in ("http", "dns", "ssh", "icmp", "udp")])
