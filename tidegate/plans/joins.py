"""Lookups, interval, as-of, semi and full joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate.functions import traffic as T
from tidegate.operators import counters as K
from tidegate.operators import joins as J
from tidegate.plans.registry import query
from tidegate.sources.tables import packets, snapshots, sql

c = F.col
DAY = "1 day"
SNAP = ("packets", "snapshots")


@query("src_packets", sql("SELECT pkt_id, src_ip, dst_ip, proto, pkt_len, src_port, dst_port, tcp_flags, frag_off FROM packets"))
def src_packets(spark, sf):
    return packets(spark, sf).drop("ts")


@query("join_ip_state", sql("SELECT p.pkt_id, CAST(s.n AS BIGINT) AS ip_packets, CAST(s.b AS BIGINT) AS ip_bytes FROM packets p JOIN (SELECT src_ip, count(*) AS n, sum(pkt_len) AS b FROM packets GROUP BY src_ip) s USING (src_ip)"))
def join_ip_state(spark, sf):
    p = packets(spark, sf)
    state = p.groupBy("src_ip").agg(F.count("*").alias("ip_packets"), F.sum("pkt_len").alias("ip_bytes"))
    return J.join_state(p, state, "src_ip", "ip_packets").select("pkt_id", "ip_packets", "ip_bytes")


LIMITS = {("baseline", "udp"): 2, ("baseline", "syn"): 2, ("attack", "udp"): 1, ("attack", "syn"): 1}
LIMIT_ROWS = ", ".join(f"('{n}', '{m}', {v})" for (n, m), v in LIMITS.items())


@query("join_thresholds", sql(f"""SELECT w, src_ip, net AS net_class, metric, CAST(value AS BIGINT) AS value, CAST(limit_n AS BIGINT) AS limit_n, value > limit_n AS over FROM (
  SELECT w, src_ip, net, 'udp' AS metric, count(*) FILTER (WHERE proto = 17) AS value FROM packets GROUP BY ALL UNION ALL SELECT w, src_ip, net, 'syn', count(*) FILTER (WHERE tcp_flags & 2 <> 0) FROM packets GROUP BY ALL) s
  JOIN (VALUES {LIMIT_ROWS}) l(net_class, metric, limit_n) ON l.net_class = s.net AND l.metric = s.metric""".replace("'udp' AS metric", "'udp' AS metric").replace("SELECT w, src_ip, net AS net_class, metric", "SELECT w, src_ip, net AS net_class, s.metric")))
def join_thresholds(spark, sf):
    p = packets(spark, sf).withColumn("net_class", T.network_class(c("src_ip")))
    rows = K.window_counters(p, DAY, ("src_ip", "net_class"), only=("udp", "syn"))
    long = rows.unpivot(["w", "src_ip", "net_class"], ["udp", "syn"], "metric", "value")
    return long.join(F.broadcast(J.limits_table(spark, LIMITS)), ["net_class", "metric"]).withColumn("over", c("value") > c("limit_n"))


@query("dim_thresholds", sql(f"SELECT net AS net_class, l.metric, CAST(limit_n AS BIGINT) AS limit_n, count(*) AS packets FROM packets JOIN (VALUES {LIMIT_ROWS}) l(net_class, metric, limit_n) ON l.net_class = net GROUP BY ALL"))
def dim_thresholds(spark, sf):
    counts = packets(spark, sf).groupBy(T.network_class(c("src_ip")).alias("net_class")).agg(F.count("*").alias("packets"))
    return counts.join(F.broadcast(J.limits_table(spark, LIMITS)), "net_class").select("net_class", "metric", "limit_n", "packets")


@query("join_net_range", sql("SELECT pkt_id, net AS net_class FROM packets"))
def join_net_range(spark, sf):
    return J.join_networks(packets(spark, sf), J.networks(spark)).select("pkt_id", "net_class")


PHASES = (("baseline", 0, 50), ("attack", 50, 120), ("recovery", 120, 100000))
PHASE_ROWS = ", ".join(f"('{n}', {a}, {b})" for n, a, b in PHASES)


@query("join_phase_interval", sql(f"SELECT run_id, idx, phase FROM snapshots JOIN (VALUES {PHASE_ROWS}) p(phase, lo, hi) ON interval_s > lo AND interval_s <= hi", *SNAP))
def join_phase_interval(spark, sf):
    phases = spark.createDataFrame(list(PHASES), "phase string, lo int, hi int")
    return snapshots(spark, sf).join(F.broadcast(phases), (c("interval_s") > c("lo")) & (c("interval_s") <= c("hi"))).select("run_id", "idx", "phase")


@query("dim_phases", sql(f"SELECT phase, count(*) AS intervals, min(idx) AS first_idx FROM snapshots JOIN (VALUES {PHASE_ROWS}) p(phase, lo, hi) ON interval_s > lo AND interval_s <= hi GROUP BY phase", *SNAP))
def dim_phases(spark, sf):
    return join_phase_interval(spark, sf).groupBy("phase").agg(F.count("*").alias("intervals"), F.min("idx").alias("first_idx"))


@query("join_asof_attack", sql("""SELECT d.pkt_id, epoch_us(d.ts) - epoch_us(max(a.ts)) AS since_us FROM packets d LEFT JOIN packets a ON a.src_ip = d.src_ip AND a.ts <= d.ts AND a.tcp_flags & 2 <> 0 WHERE d.proto = 17 GROUP BY d.pkt_id, d.ts"""))
def join_asof_attack(spark, sf):
    p = packets(spark, sf)
    rows = J.asof_before(p.where(c("proto") == T.UDP).select("pkt_id", "src_ip", "ts"), p.where(T.has_flag(c("tcp_flags"), T.SYN)).select("src_ip", "ts"), "src_ip")
    micros = lambda x: F.unix_micros(c(x).cast("timestamp"))
    return rows.select("pkt_id", (micros("ts") - micros("mark_ts")).alias("since_us"))


@query("join_labels", sql("SELECT w, packets, CASE WHEN attack * 4 > packets THEN 'attack' ELSE 'benign' END AS label FROM counters", "counters"))
def join_labels(spark, sf):
    rows = K.window_counters(packets(spark, sf), DAY, only=("packets", "attack"))
    labels = rows.select("w", F.when(c("attack") * 4 > c("packets"), "attack").otherwise("benign").alias("label"))
    return rows.select("w", "packets").join(labels, "w")


@query("semi_seen_ips", sql("SELECT pkt_id FROM packets WHERE ts >= TIMESTAMP '2024-01-15' AND src_ip IN (SELECT src_ip FROM packets WHERE ts < TIMESTAMP '2024-01-05')"))
def semi_seen_ips(spark, sf):
    p = packets(spark, sf)
    late, early = p.where("ts >= timestamp_ntz'2024-01-15'"), p.where("ts < timestamp_ntz'2024-01-05'").select("src_ip")
    return late.join(early, "src_ip", "left_semi").select("pkt_id")


@query("anti_new_ips", sql("SELECT pkt_id FROM packets WHERE ts >= TIMESTAMP '2024-01-15' AND src_ip NOT IN (SELECT src_ip FROM packets WHERE ts < TIMESTAMP '2024-01-02')"))
def anti_new_ips(spark, sf):
    p = packets(spark, sf)
    late, early = p.where("ts >= timestamp_ntz'2024-01-15'"), p.where("ts < timestamp_ntz'2024-01-02'").select("src_ip")
    return late.join(early, "src_ip", "left_anti").select("pkt_id")


@query("join_compare_runs", sql("""SELECT coalesce(a.w, b.w) AS w, CAST(coalesce(a.n, 0) AS BIGINT) AS baseline, CAST(coalesce(b.n, 0) AS BIGINT) AS attack, CAST(coalesce(b.n, 0) - coalesce(a.n, 0) AS BIGINT) AS diff FROM
  (SELECT w, count(*) AS n FROM packets WHERE net = 'baseline' GROUP BY w) a FULL JOIN (SELECT w, count(*) AS n FROM packets WHERE net = 'attack' GROUP BY w) b ON a.w = b.w"""))
def join_compare_runs(spark, sf):
    p = packets(spark, sf).withColumn("net", T.network_class(c("src_ip")))
    of = lambda net: p.where(c("net") == net).groupBy(K.window_start(DAY).alias("w")).agg(F.count("*").alias(net)).transform(K.named)
    zero = lambda x: F.coalesce(c(x), F.lit(0))
    return of("baseline").join(of("attack"), "w", "full").select("w", zero("baseline").alias("baseline"), zero("attack").alias("attack"), (zero("attack") - zero("baseline")).alias("diff"))
