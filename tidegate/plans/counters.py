"""Counters, ratios and totals by window."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate.functions import traffic as T
from tidegate.operators import blocks as B
from tidegate.operators import counters as K
from tidegate.plans.registry import query
from tidegate.sources.tables import http_requests, packets, sql

c = F.col
DAY, SECONDS = "1 day", 86400.0


@query("agg_window_stats", sql("SELECT w, round(packets / 86400.0::DOUBLE, 6) AS pps, round(bytes * 8 / 1e9 / 86400, 9) AS gbps, tcp, udp, icmp, syn, ack, rst, fin, frag FROM counters", "counters"))
def agg_window_stats(spark, sf):
    rows = K.window_counters(packets(spark, sf), DAY)
    return rows.select("w", F.round(c("packets") / SECONDS, 6).alias("pps"), F.round(c("bytes") * 8 / 1e9 / SECONDS, 9).alias("gbps"), "tcp", "udp", "icmp", "syn", "ack", "rst", "fin", "frag")


def ratio_sql(part: str, whole: str) -> str:
    return f"round(CASE WHEN {whole} > 0 THEN CAST({part} AS DOUBLE) / ({whole}) ELSE 0.0 END, 6)"


@query("agg_protocol_ratios", sql("SELECT w, " + ", ".join(f"{ratio_sql(x, '(tcp + udp + icmp)')} AS {x}_ratio" for x in ("tcp", "udp", "icmp")) + " FROM counters", "counters"))
def agg_protocol_ratios(spark, sf):
    rows = K.window_counters(packets(spark, sf), DAY, only=("tcp", "udp", "icmp"))
    return rows.select("w", *[T.ratio(c(x), c("tcp") + c("udp") + c("icmp")).alias(f"{x}_ratio") for x in ("tcp", "udp", "icmp")])


@query("agg_flag_ratios", sql("SELECT w, " + ", ".join(f"{ratio_sql(x, 'tcp')} AS {x}_ratio" for x in ("syn", "ack", "rst", "fin")) + " FROM counters", "counters"))
def agg_flag_ratios(spark, sf):
    rows = K.window_counters(packets(spark, sf), DAY, only=("tcp", "syn", "ack", "rst", "fin"))
    return rows.select("w", *[T.ratio(c(x), c("tcp")).alias(f"{x}_ratio") for x in ("syn", "ack", "rst", "fin")])


@query("agg_frag_small_ratio", sql(f"SELECT w, {ratio_sql('frag', 'packets')} AS frag_ratio, {ratio_sql('small', 'packets')} AS small_pkt_ratio FROM counters", "counters"))
def agg_frag_small_ratio(spark, sf):
    rows = K.window_counters(packets(spark, sf), DAY, only=("packets", "frag", "small"))
    return rows.select("w", T.ratio(c("frag"), c("packets")).alias("frag_ratio"), T.ratio(c("small"), c("packets")).alias("small_pkt_ratio"))


@query("agg_size_stats", sql("SELECT w, round(avg(pkt_len), 6) AS avg_len, min(pkt_len) AS min_len, max(pkt_len) AS max_len, round(stddev_pop(pkt_len), 6) AS std_len FROM packets GROUP BY w"))
def agg_size_stats(spark, sf):
    return packets(spark, sf).groupBy(K.window_start(DAY).alias("w")).agg(F.round(F.avg("pkt_len"), 6).alias("avg_len"), F.min("pkt_len").alias("min_len"), F.max("pkt_len").alias("max_len"), F.round(F.stddev_pop("pkt_len"), 6).alias("std_len")).transform(K.named)


FEATURES = f"""SELECT k.w, round(bytes * 8 / 1e9 / 86400, 9) AS gbps, round(packets / 86400.0::DOUBLE, 6) AS pps, avg_pkt_size, std_dev,
  {ratio_sql('tcp', '(tcp + udp + icmp)')} AS tcp_ratio, {ratio_sql('udp', '(tcp + udp + icmp)')} AS udp_ratio, {ratio_sql('icmp', '(tcp + udp + icmp)')} AS icmp_ratio,
  {ratio_sql('syn', 'tcp')} AS syn_ratio, {ratio_sql('ack', 'tcp')} AS ack_ratio, {ratio_sql('rst', 'tcp')} AS rst_ratio, {ratio_sql('fin', 'tcp')} AS fin_ratio,
  {ratio_sql('frag', 'packets')} AS frag_ratio, {ratio_sql('small', 'packets')} AS small_pkt_ratio, s.e AS entropy_src_ip, coalesce(d.e, 0) AS entropy_dst_port,
  s.u AS unique_src_ips, coalesce(d.u, 0) AS unique_dst_ports, round(syn / 86400.0::DOUBLE, 6) AS syn_per_sec, round(ack / 86400.0::DOUBLE, 6) AS ack_per_sec
FROM counters k JOIN (SELECT w, round(avg(pkt_len), 6) AS avg_pkt_size, round(stddev_pop(pkt_len), 6) AS std_dev FROM packets GROUP BY w) z USING (w)
LEFT JOIN (SELECT w, round(entropy(src_ip), 6) AS e, count(DISTINCT src_ip) AS u FROM packets GROUP BY w) s USING (w)
LEFT JOIN (SELECT w, round(entropy(dst_port), 6) AS e, count(DISTINCT dst_port) AS u FROM packets WHERE dst_port IS NOT NULL GROUP BY w) d USING (w)"""


@query("agg_feature_row", sql(FEATURES, "counters"))
def agg_feature_row(spark, sf):
    return K.feature_rows(packets(spark, sf), DAY, SECONDS)


@query("agg_class_totals", sql("SELECT w, net AS net_class, CAST(count(*) AS BIGINT) AS packets, CAST(sum(pkt_len) AS BIGINT) AS bytes, round(sum(pkt_len) * 8 / 1e9 / 86400, 9) AS gbps, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY w), 6) AS percent FROM packets GROUP BY w, net"))
def agg_class_totals(spark, sf):
    return K.class_totals(packets(spark, sf), DAY, SECONDS)


@query("agg_lifetime_totals", sql("SELECT w, total_packets, total_bytes, round(total_packets / s / 1e6, 12) AS mpps, round(total_bytes * 8 / s / 1e9, 12) AS gbps FROM (SELECT w, CAST(sum(packets) OVER o AS BIGINT) AS total_packets, CAST(sum(bytes) OVER o AS BIGINT) AS total_bytes, (epoch_us(strptime(w, '%Y-%m-%d %H:%M:%S')) + 86400000000 - (SELECT epoch_us(min(ts)) FROM packets)) / 1e6 AS s FROM counters WINDOW o AS (ORDER BY w)) x", "counters"))
def agg_lifetime_totals(spark, sf):
    """Packets and bytes since the start, and their rates since the first packet."""
    rows = K.window_counters(packets(spark, sf), DAY, only=("packets", "bytes"))
    at = F.unix_timestamp("w", "yyyy-MM-dd HH:mm:ss")
    total = B.running(rows, "w", F.floor(at / (7 * 86400)), {x: B.Scan(c(x)) for x in ("packets", "bytes")})
    first = F.broadcast(packets(spark, sf).agg(F.unix_micros(F.min("ts").cast("timestamp")).alias("first")))  # one row
    seconds = ((at + int(SECONDS)) * 1000000 - c("first")) / 1e6
    return total.crossJoin(first).select("w", c("packets").alias("total_packets"), c("bytes").alias("total_bytes"), F.round(c("packets") / seconds / 1e6, 12).alias("mpps"), F.round(c("bytes") * 8 / seconds / 1e9, 12).alias("gbps"))


@query("agg_attack_counters", sql(f"SELECT w, syn, syn_ack, {ratio_sql('syn', 'syn_ack')} AS syn_synack_ratio, http, dns FROM counters", "counters"))
def agg_attack_counters(spark, sf):
    return K.window_counters(packets(spark, sf), DAY, only=("syn", "syn_ack", "http", "dns")).withColumn("syn_synack_ratio", T.ratio(c("syn"), c("syn_ack")))


@query("agg_per_ip", sql("""SELECT w, src_ip, CAST(count(*) AS BIGINT) AS packets, CAST(sum(pkt_len) AS BIGINT) AS bytes, CAST(count(*) FILTER (WHERE proto = 6) AS BIGINT) AS tcp, CAST(count(*) FILTER (WHERE proto = 17) AS BIGINT) AS udp,
  CAST(count(*) FILTER (WHERE proto = 1) AS BIGINT) AS icmp, CAST(count(*) FILTER (WHERE tcp_flags & 2 <> 0) AS BIGINT) AS syn, CAST(count(*) FILTER (WHERE tcp_flags = 16) AS BIGINT) AS pure_ack,
  CAST(count(*) FILTER (WHERE proto = 6 AND dst_port = 80) AS BIGINT) AS http, CAST(count(*) FILTER (WHERE proto = 17 AND (src_port = 53 OR dst_port = 53)) AS BIGINT) AS dns, CAST(count(*) FILTER (WHERE frag_off & 16383 <> 0) AS BIGINT) AS frag,
  strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM packets GROUP BY w, src_ip"""))
def agg_per_ip(spark, sf):
    names = ("packets", "bytes", "tcp", "udp", "icmp", "syn", "pure_ack", "http", "dns", "frag")
    found = K.counter_columns()
    return packets(spark, sf).groupBy(K.window_start(DAY).alias("w"), "src_ip").agg(*[found[x].alias(x) for x in names], F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_seen")).transform(K.named)


@query("agg_active_ips", sql("SELECT w, count(DISTINCT src_ip) AS active_ips FROM packets GROUP BY w"))
def agg_active_ips(spark, sf):
    return K.key_counts(packets(spark, sf), "src_ip", DAY).groupBy("w").agg(F.count("*").alias("active_ips"))


@query("agg_http_methods", sql("""SELECT w, CAST(count(*) FILTER (WHERE payload LIKE 'GET %') AS BIGINT) AS get_n, CAST(count(*) FILTER (WHERE payload LIKE 'POST %') AS BIGINT) AS post_n,
  CAST(count(*) FILTER (WHERE payload NOT LIKE 'GET %' AND payload NOT LIKE 'POST %') AS BIGINT) AS other_n, round(100.0::DOUBLE * count(*) FILTER (WHERE payload LIKE 'GET %') / count(*), 6) AS get_pct FROM http_requests GROUP BY w""", "packets", "http_requests"))
def agg_http_methods(spark, sf):
    m = T.request_method(c("payload"))
    rows = http_requests(spark, sf).groupBy(K.window_start(DAY).alias("w")).agg(T.count_where(m == "GET").alias("get_n"), T.count_where(m == "POST").alias("post_n"), T.count_where(~m.isin("GET", "POST")).alias("other_n"), F.count("*").alias("n")).transform(K.named)
    return rows.select("w", "get_n", "post_n", "other_n", F.round(100 * c("get_n") / c("n"), 6).alias("get_pct"))




@query("agg_traffic_cube", sql("""SELECT coalesce(net, 'all') AS net_class, coalesce(CASE proto WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' WHEN 1 THEN 'icmp' END, 'all') AS protocol, CAST(count(*) AS BIGINT) AS packets, CAST(sum(pkt_len) AS BIGINT) AS bytes
  FROM packets GROUP BY CUBE (net, CASE proto WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' WHEN 1 THEN 'icmp' END)"""))
def agg_traffic_cube(spark, sf):
    rows = packets(spark, sf).select(T.network_class(c("src_ip")).alias("n"), T.protocol_name(c("proto")).alias("p"), "pkt_len")
    return rows.cube("n", "p").agg(F.count("*").alias("packets"), F.sum("pkt_len").alias("bytes")).select(F.coalesce("n", F.lit("all")).alias("net_class"), F.coalesce("p", F.lit("all")).alias("protocol"), "packets", "bytes")


PROFILE = """SELECT 'layer' AS dimension, unnest(['ethernet', 'ipv4', CASE proto WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' WHEN 1 THEN 'icmp' END, CASE WHEN proto = 6 AND dst_port = 80 THEN 'http' WHEN proto = 17 AND (src_port = 53 OR dst_port = 53) THEN 'dns' WHEN proto = 17 AND (src_port = 123 OR dst_port = 123) THEN 'ntp' WHEN proto = 17 AND (src_port IN (443, 8443) OR dst_port IN (443, 8443)) THEN 'quic' WHEN proto = 6 AND dst_port = 22 THEN 'ssh' END]) AS value FROM packets"""


@query("agg_capture_profile", sql(f"""SELECT dimension, value, count(*) AS n FROM ({PROFILE}) l WHERE value IS NOT NULL GROUP BY ALL UNION ALL SELECT 'method' AS dimension, split_part(payload, ' ', 1) AS value, count(*) AS n FROM http_requests GROUP BY 2 UNION ALL
  SELECT 'path', left(regexp_extract(payload, '^[A-Z]+ ([^\\s]*)', 1), 255), count(*) FROM http_requests GROUP BY 2 UNION ALL
  SELECT 'host', regexp_extract(payload, 'Host: ([^\\r\\n]*)', 1), count(*) FROM http_requests GROUP BY 2 UNION ALL
  SELECT 'agent', CASE WHEN payload LIKE '%Chrome%' THEN 'Chrome' WHEN payload LIKE '%Firefox%' THEN 'Firefox' WHEN payload LIKE '%Safari%' THEN 'Safari' ELSE 'Other' END, count(*) FROM http_requests GROUP BY 2""", "packets", "http_requests"))
def agg_capture_profile(spark, sf):
    """Packets of each protocol layer; requests of each method, path, host and kind of agent.

    Both are counted by all their dimensions at once, and only these counts are taken apart by dimension.
    """
    p = c("payload")
    service = T.service_name(c("proto"), c("src_port"), c("dst_port"))
    stack = packets(spark, sf).groupBy(T.protocol_name(c("proto")).alias("transport"), service.alias("service")).agg(F.count("*").alias("n"))
    layers = stack.select("n", F.explode(F.array_compact(F.array(F.lit("ethernet"), F.lit("ipv4"), c("transport"), F.nullif("service", F.lit("other"))))).alias("value")).select(F.lit("layer").alias("dimension"), "value", "n")
    told = {"method": T.request_method(p), "path": T.request_path(p), "host": T.request_header(p, "Host"), "agent": T.agent_family(T.request_header(p, "User-Agent"))}
    rows = http_requests(spark, sf).groupBy(*[v.alias(k) for k, v in told.items()]).agg(F.count("*").alias("n"))
    return rows.unpivot(["n"], list(told), "dimension", "value").select("dimension", "value", "n").unionByName(layers).groupBy("dimension", "value").agg(F.sum("n").alias("n"))


@query("agg_protocol_shares", sql("""SELECT CAST(floor(100.0::DOUBLE * count(*) FILTER (WHERE proto = 6 AND dst_port = 80) / count(*)) AS BIGINT) AS http_pct, CAST(floor(100.0::DOUBLE * count(*) FILTER (WHERE proto = 17 AND (src_port = 53 OR dst_port = 53)) / count(*)) AS BIGINT) AS dns_pct,
  CAST(floor(100.0::DOUBLE * count(*) FILTER (WHERE proto = 6 AND dst_port = 22) / count(*)) AS BIGINT) AS ssh_pct, CAST(floor(100.0::DOUBLE * count(*) FILTER (WHERE proto = 1) / count(*)) AS BIGINT) AS icmp_pct, CAST(floor(100.0::DOUBLE * count(*) FILTER (WHERE proto = 17) / count(*)) AS BIGINT) AS udp_pct FROM packets"""))
def agg_protocol_shares(spark, sf):
    return K.protocol_shares(packets(spark, sf))


REQUESTS = "SELECT regexp_extract(payload, '^[A-Z]+ ([^\\s?]*)', 1) AS path, split_part(payload, ' ', 1) AS method FROM http_requests"
TOTALS = "SELECT count(*) AS n, CAST(sum(pkt_len) AS BIGINT) AS b, count(DISTINCT concat(src_ip, ' ', w)) AS s FROM packets"


@query("agg_dataset_stats", sql(f"""SELECT 'total' AS kind, 'packets' AS name, n, NULL::DOUBLE AS share FROM ({TOTALS}) t UNION ALL SELECT 'total', 'bytes', b, NULL FROM ({TOTALS}) t UNION ALL SELECT 'total', 'sessions', s, NULL FROM ({TOTALS}) t UNION ALL SELECT 'total', 'packets_per_session', NULL, round(n / s::DOUBLE, 6) FROM ({TOTALS}) t
  UNION ALL SELECT 'method', method, count(*), round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM http_requests), 6) FROM ({REQUESTS}) r GROUP BY method
  UNION ALL (SELECT 'path', path, count(*) AS k, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM http_requests), 6) FROM ({REQUESTS}) r GROUP BY path ORDER BY k DESC, path LIMIT 10)""", "packets", "http_requests"))
def agg_dataset_stats(spark, sf):
    """Of a data set: packets, bytes, sessions (a source's day) and packets a session; the share of each method; the ten most frequent paths."""
    daily = packets(spark, sf).groupBy("src_ip", K.window_start(DAY).alias("w")).agg(F.count("*").alias("n"), F.sum("pkt_len").alias("b"))
    one = daily.agg(F.sum("n").alias("packets"), F.sum("b").alias("bytes"), F.count("*").alias("sessions"))
    none, nothing = F.lit(None).cast("double"), F.lit(None).cast("long")
    totals = one.unpivot([], ["packets", "bytes", "sessions"], "name", "n").select(F.lit("total").alias("kind"), "name", "n", none.alias("share"))
    totals = totals.unionByName(one.select(F.lit("total").alias("kind"), F.lit("packets_per_session").alias("name"), nothing.alias("n"), F.round(c("packets") / c("sessions"), 6).alias("share")))
    p = c("payload")
    counts = http_requests(spark, sf).groupBy(T.request_method(p).alias("method"), T.request_path(p).alias("path")).agg(F.count("*").alias("n"))
    whole = F.broadcast(counts.agg(F.sum("n").alias("all")))  # one row
    by = lambda x: counts.groupBy(c(x).alias("name")).agg(F.sum("n").alias("n"))
    share = lambda rows, kind: rows.crossJoin(whole).select(F.lit(kind).alias("kind"), "name", "n", F.round(100 * c("n") / c("all"), 6).alias("share"))
    return totals.unionByName(share(by("method"), "method")).unionByName(share(by("path").orderBy(F.desc("n"), "name").limit(10), "path"))


@query("agg_distinct_exact", sql("SELECT w, count(DISTINCT src_ip) AS src_ips, count(DISTINCT dst_port) AS dst_ports FROM packets GROUP BY w"))
def agg_distinct_exact(spark, sf):
    p = packets(spark, sf)
    a = K.key_counts(p, "src_ip", DAY).groupBy("w").agg(F.count("*").alias("src_ips"))
    b = K.key_counts(p, "dst_port", DAY).groupBy("w").agg(F.count("*").alias("dst_ports"))
    return a.join(b, "w", "left").select("w", "src_ips", F.coalesce("dst_ports", F.lit(0)).alias("dst_ports"))
