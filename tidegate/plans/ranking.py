"""Top-k reports, limits, mixing and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate.functions import traffic as T
from tidegate.operators import counters as K
from tidegate.plans.registry import query
from tidegate.sources.tables import http_requests, packets, sql

c = F.col


def top(rows, key, n):
    """The n keys of most rows, ties by key; TakeOrdered, so no full sort."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(n)


def with_percent(rows, key, n):
    whole = F.broadcast(rows.agg(F.count("*").alias("total")))  # one row
    return top(rows, key, n).crossJoin(whole).select(key, "n", F.round(100 * c("n") / c("total"), 6).alias("pct"))


def top_sql(key, n):
    return f"SELECT {key}, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM packets), 6) AS pct FROM packets GROUP BY 1 ORDER BY n DESC, {key} LIMIT {n}"


@query("topn_src_ips", sql(top_sql("src_ip", 10)))
def topn_src_ips(spark, sf):
    return with_percent(packets(spark, sf), "src_ip", 10)


@query("topn_dst_ips", sql(top_sql("dst_ip", 10)))
def topn_dst_ips(spark, sf):
    return with_percent(packets(spark, sf), "dst_ip", 10)


@query("topn_ports", sql("SELECT dst_port, count(*) AS n FROM packets WHERE dst_port IS NOT NULL GROUP BY 1 ORDER BY n DESC, dst_port LIMIT 5"))
def topn_ports(spark, sf):
    return top(packets(spark, sf).where("dst_port IS NOT NULL"), "dst_port", 5)


@query("topn_paths", sql("SELECT left(split_part(payload, ' ', 2), 255) AS path, count(*) AS n FROM http_requests GROUP BY 1 ORDER BY n DESC, path LIMIT 15", "packets", "http_requests"))
def topn_paths(spark, sf):
    return top(http_requests(spark, sf).select(T.request_path(c("payload")).alias("path")), "path", 15)


@query("topn_hosts", sql("SELECT regexp_extract(payload, 'Host: ([^\\r\\n]*)', 1) AS host, count(*) AS n FROM http_requests GROUP BY 1 ORDER BY n DESC, host LIMIT 10", "packets", "http_requests"))
def topn_hosts(spark, sf):
    return top(http_requests(spark, sf).select(T.request_header(c("payload"), "Host").alias("host")), "host", 10)


@query("limit_first_n", sql("SELECT pkt_id, src_ip FROM packets ORDER BY ts, pkt_id LIMIT 500"))
def limit_first_n(spark, sf):
    return packets(spark, sf).orderBy("ts", "pkt_id").limit(500).select("pkt_id", "src_ip")


@query("mix_datasets", sql("""SELECT * FROM (SELECT pkt_id, 'attack' AS origin FROM packets WHERE net = 'attack' ORDER BY pkt_id * 7919 % 10007, pkt_id LIMIT 200)
  UNION ALL SELECT * FROM (SELECT pkt_id, 'benign' AS origin FROM packets WHERE net = 'baseline' ORDER BY pkt_id * 7919 % 10007, pkt_id LIMIT 466)"""))
def mix_datasets(spark, sf):
    return mix(packets(spark, sf), 200, 0.3)


def mix(rows, n_attack: int, share: float):
    """A mixture with the given share of attack packets: int(n * (1 - share) / share) benign ones, chosen by a fixed hash."""
    net = T.network_class(c("src_ip"))
    pick = lambda cls, n: rows.where(net == cls).orderBy(c("pkt_id") * 7919 % 10007, "pkt_id").limit(n)
    attack = pick("attack", n_attack).select("pkt_id", F.lit("attack").alias("origin"))
    return attack.unionByName(pick("baseline", int(n_attack * (1 - share) / share)).select("pkt_id", F.lit("benign").alias("origin")))


@query("union_labelled", sql("""SELECT w, packets, 'syn_flood' AS label FROM counters WHERE syn * 3 > tcp UNION ALL SELECT w, packets, 'udp_flood' FROM counters WHERE udp * 5 > packets UNION ALL SELECT w, packets, 'benign' FROM counters WHERE attack * 4 <= packets""", "counters"))
def union_labelled(spark, sf):
    rows = K.window_counters(packets(spark, sf), "1 day", only=("packets", "syn", "tcp", "udp", "attack"))
    part = lambda cond, label: rows.where(cond).select("w", "packets", F.lit(label).alias("label"))
    return part(c("syn") * 3 > c("tcp"), "syn_flood").unionByName(part(c("udp") * 5 > c("packets"), "udp_flood")).unionByName(part(c("attack") * 4 <= c("packets"), "benign"))


@query("compare_ip_sets", sql("""SELECT src_ip, CASE WHEN bool_or(ts < TIMESTAMP '2024-01-03') AND bool_or(ts >= TIMESTAMP '2024-01-28') THEN 'both' WHEN bool_or(ts < TIMESTAMP '2024-01-03') THEN 'first' ELSE 'second' END AS side
  FROM packets WHERE ts < TIMESTAMP '2024-01-03' OR ts >= TIMESTAMP '2024-01-28' GROUP BY src_ip"""))
def compare_ip_sets(spark, sf):
    p = packets(spark, sf)
    a, b = p.where("ts < timestamp_ntz'2024-01-03'").select("src_ip"), p.where("ts >= timestamp_ntz'2024-01-28'").select("src_ip")
    tag = lambda df, side: df.distinct().withColumn("side", F.lit(side))
    return tag(a.intersect(b), "both").union(tag(a.subtract(b), "first")).union(tag(b.subtract(a), "second"))
