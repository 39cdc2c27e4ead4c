"""Run analysis over snapshots and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate.functions import traffic as T
from tidegate.operators import blocks as B
from tidegate.operators import counters as K
from tidegate.operators import distributions as D
from tidegate.operators import runs as U
from tidegate.operators import series as S
from tidegate.plans.registry import query
from tidegate.sources.storage import scratch
from tidegate.sources.tables import packets, snapshots, sql

c = F.col
SNAP = ("packets", "snapshots")
DELTA = "(SELECT *, greatest(0, total_packets - coalesce(lag(total_packets) OVER o, 0)) AS packets_d, greatest(0, total_bytes - coalesce(lag(total_bytes) OVER o, 0)) AS bytes_d, CASE WHEN attack_percent > 0 THEN 'attack' ELSE 'baseline' END AS phase FROM snapshots WINDOW o AS (PARTITION BY run_id ORDER BY idx)) d"


def totals(spark, sf):
    found = K.counter_columns()
    names = ("packets", "bytes", "tcp", "udp", "icmp", "syn", "ack", "rst", "fin", "frag")
    return packets(spark, sf).groupBy(T.network_class(c("src_ip")).alias("run_id")).agg(*[found[x].alias(x) for x in names], F.round(F.count("*") / 30.0, 6).alias("mean_pps"))


TOTALS = """(SELECT net AS run_id, count(*) AS packets, CAST(sum(pkt_len) AS BIGINT) AS bytes, count(*) FILTER (WHERE proto = 6) AS tcp, count(*) FILTER (WHERE proto = 17) AS udp, count(*) FILTER (WHERE proto = 1) AS icmp, count(*) FILTER (WHERE tcp_flags & 2 <> 0) AS syn,
  count(*) FILTER (WHERE tcp_flags & 16 <> 0) AS ack, count(*) FILTER (WHERE tcp_flags & 4 <> 0) AS rst, count(*) FILTER (WHERE tcp_flags & 1 <> 0) AS fin, count(*) FILTER (WHERE frag_off & 16383 <> 0) AS frag, round(count(*) / 30.0::DOUBLE, 6) AS mean_pps FROM packets GROUP BY net) t"""


@query("run_classify", sql(f"""SELECT run_id, CASE WHEN packets = 0 THEN 'No Traffic' WHEN syn > 0.7 * tcp THEN 'SYN Flood' WHEN udp > 0.7 * packets THEN 'UDP Flood' WHEN icmp > 0.5 * packets THEN 'ICMP Flood' WHEN frag > 0.3 * packets THEN 'Fragmentation' WHEN tcp > 0.9 * packets THEN 'TCP Flood'
  WHEN mean_pps > 10000 THEN 'Volumetric' ELSE 'Mixed Traffic' END AS attack_type, CASE WHEN mean_pps > 100000 THEN 'CRITICAL' WHEN mean_pps > 10000 THEN 'HIGH' WHEN mean_pps > 1000 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM {TOTALS}"""))
def run_classify(spark, sf):
    return U.classify(totals(spark, sf)).select("run_id", "attack_type", "severity")


SHARES = (("udp", "packets"), ("icmp", "packets"), ("syn", "tcp"), ("ack", "tcp"), ("rst", "tcp"), ("fin", "tcp"), ("frag", "packets"))


@query("run_summary", sql("SELECT count(*) AS windows, CAST(sum(packets) AS BIGINT) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(max(packets) AS BIGINT) AS peak, round(avg(packets), 6) AS mean, round(sum(tcp) / sum(packets)::DOUBLE, 6) AS tcp_share, round(sum(syn) / sum(ack)::DOUBLE, 6) AS syn_ack, count(*) FILTER (WHERE packets > 0) AS active, CAST(count(*) * 86400 AS BIGINT) AS duration_s, round(max(bytes) * 8 / 86400.0::DOUBLE / 1e3, 6) AS peak_kbps, round(avg(bytes) * 8 / 86400.0::DOUBLE / 1e3, 6) AS mean_kbps, "
    + ", ".join(f"round(sum({x}) / sum({of})::DOUBLE, 6) AS {x}_share" for x, of in SHARES) + " FROM counters", "counters"))
def run_summary(spark, sf):
    rows = K.window_counters(packets(spark, sf), "1 day")
    return rows.agg(F.count("*").alias("windows"), F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"), F.max("packets").alias("peak"), F.round(F.avg("packets"), 6).alias("mean"), F.round(F.sum("tcp") / F.sum("packets"), 6).alias("tcp_share"), F.round(F.sum("syn") / F.sum("ack"), 6).alias("syn_ack"),
                    T.count_where(c("packets") > 0).alias("active"), (F.count("*") * 86400).alias("duration_s"), F.round(F.max("bytes") * 8 / 86400.0 / 1e3, 6).alias("peak_kbps"), F.round(F.avg("bytes") * 8 / 86400.0 / 1e3, 6).alias("mean_kbps"),
                    *[F.round(F.sum(x) / F.sum(of), 6).alias(f"{x}_share") for x, of in SHARES])


@query("run_heatmap", sql("SELECT CAST((k * (least(30, n) - 1) + n - 2) // (n - 1) AS INT) AS bin, CAST(sum(tcp) AS BIGINT) AS tcp, CAST(sum(udp) AS BIGINT) AS udp, CAST(sum(icmp) AS BIGINT) AS icmp FROM (SELECT *, row_number() OVER (ORDER BY w) - 1 AS k, count(*) OVER () AS n FROM counters) s WHERE k > 0 GROUP BY 1", "counters"))
def run_heatmap(spark, sf):
    """min(30, n) edges evenly over n windows, bins closed on the right; the window on the first edge is in none."""
    rows = K.window_counters(packets(spark, sf), "1 day", only=("tcp", "udp", "icmp"))
    rows = B.numbered(rows, "w", F.floor(F.unix_timestamp("w", "yyyy-MM-dd HH:mm:ss") / (7 * 86400)), "k")
    rows = rows.crossJoin(F.broadcast(rows.agg(F.count("*").alias("n")))).where("k > 0")  # one row
    return rows.groupBy(F.expr("CAST((k * (least(30, n) - 1) + n - 2) DIV (n - 1) AS INT)").alias("bin")).agg(*[F.sum(x).alias(x) for x in ("tcp", "udp", "icmp")])


def long_sql(names):
    return " UNION ALL ".join(f"SELECT '{x}' AS name, CAST(sum({x}) AS BIGINT) AS n FROM counters" for x in names)


@query("run_flag_totals", sql(long_sql(("syn", "ack", "rst", "fin")), "counters"))
def run_flag_totals(spark, sf):
    names = ("syn", "ack", "rst", "fin")
    return K.window_counters(packets(spark, sf), "1 day", only=names).agg(*[F.sum(x).alias(x) for x in names]).unpivot([], list(names), "name", "n")


@query("run_proto_totals", sql(long_sql(("tcp", "udp", "icmp")), "counters"))
def run_proto_totals(spark, sf):
    names = ("tcp", "udp", "icmp")
    return K.window_counters(packets(spark, sf), "1 day", only=names).agg(*[F.sum(x).alias(x) for x in names]).unpivot([], list(names), "name", "n")


#: The second at which the attack of the snapshots starts.
ATTACK_START_S = 55


@query("snap_phase_split", sql(f"SELECT run_id, idx, phase, CASE WHEN interval_s >= {ATTACK_START_S} THEN 'attack' ELSE 'baseline' END AS phase_by_time FROM {DELTA}", *SNAP))
def snap_phase_split(spark, sf):
    return U.with_deltas(snapshots(spark, sf)).select("run_id", "idx", "phase", U.phase_of("start_time", ATTACK_START_S).alias("phase_by_time"))


@query("snap_phase_metrics", sql(f"SELECT run_id, phase, count(*) AS intervals, CAST(sum(packets_d) AS BIGINT) AS packets, round(avg(packets_d) / 5, 6) AS mean_pps, round(sum(bytes_d) * 8 / 1e9 / (count(*) * 5), 9) AS gbps, round(sum(bytes_d) * 8 / 1e9 / (count(*) * 5) / 25 * 100, 9) AS util FROM {DELTA} GROUP BY run_id, phase", *SNAP))
def snap_phase_metrics(spark, sf):
    rate = F.sum("bytes_d") * 8 / 1e9 / (F.count("*") * 5)
    return U.with_deltas(snapshots(spark, sf)).groupBy("run_id", "phase").agg(F.count("*").alias("intervals"), F.sum("packets_d").alias("packets"), F.round(F.avg("packets_d") / 5, 6).alias("mean_pps"), F.round(rate, 9).alias("gbps"), F.round(rate / 25 * 100, 9).alias("util"))


@query("snap_attack_pct", sql("SELECT run_id, max(attack_percent) AS max_pct, round(avg(attack_percent), 6) AS mean_pct FROM snapshots GROUP BY run_id", *SNAP))
def snap_attack_pct(spark, sf):
    return snapshots(spark, sf).groupBy("run_id").agg(F.max("attack_percent").alias("max_pct"), F.round(F.avg("attack_percent"), 6).alias("mean_pct"))


@query("snap_detection_delay", sql("SELECT run_id, CAST(greatest(0, a - s) AS INT) AS delay_s, level FROM (SELECT run_id, min(interval_s) FILTER (WHERE alert_level <> 'NONE' AND attack_percent > 0) AS a, min(interval_s) FILTER (WHERE attack_percent > 0) AS s, arg_min(alert_level, idx) FILTER (WHERE alert_level <> 'NONE' AND attack_percent > 0) AS level FROM snapshots GROUP BY run_id) x", *SNAP))
def snap_detection_delay(spark, sf):
    hit = (c("alert_level") != "NONE") & (c("attack_percent") > 0)
    rows = snapshots(spark, sf).groupBy("run_id").agg(F.min(F.when(hit, c("interval_s"))).alias("a"), F.min(F.when(c("attack_percent") > 0, c("interval_s"))).alias("s"), F.min_by("alert_level", F.when(hit, c("idx"))).alias("level"))
    return rows.select("run_id", F.greatest(F.lit(0), c("a") - c("s")).alias("delay_s"), "level")


LEVELS = "(VALUES ('NONE'), ('LOW'), ('MEDIUM'), ('HIGH'), ('CRITICAL')) l(alert_level)"


@query("snap_alert_counts", sql(f"SELECT l.alert_level, CAST(coalesce(n, 0) AS BIGINT) AS n, round(100.0::DOUBLE * coalesce(n, 0) / (SELECT count(*) FROM snapshots), 6) AS pct FROM {LEVELS} LEFT JOIN (SELECT alert_level, count(*) AS n FROM snapshots GROUP BY 1) s ON s.alert_level = l.alert_level", *SNAP))
def snap_alert_counts(spark, sf):
    rows = snapshots(spark, sf).groupBy("alert_level").agg(F.count("*").alias("n"))
    levels = F.broadcast(spark.createDataFrame([(x,) for x in T.ALERT_CODES], "alert_level string"))
    total = F.broadcast(rows.agg(F.sum("n").alias("total")))
    n = F.coalesce("n", F.lit(0))
    return rows.join(levels, "alert_level", "right").crossJoin(total).select("alert_level", n.alias("n"), F.round(100 * n / c("total"), 6).alias("pct"))


@query("snap_detection_rates", sql("""SELECT run_id, round(avg(CASE WHEN alert_level <> 'NONE' THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE attack_percent > 0), 6) AS detection, round(avg(CASE WHEN alert_level <> 'NONE' THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE NOT attack_percent > 0), 6) AS false_positive,
  round(avg(CASE WHEN alert_level = 'HIGH' THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE attack_percent > 0), 6) AS true_positive FROM snapshots GROUP BY run_id""", *SNAP))
def snap_detection_rates(spark, sf):
    real = c("attack_percent") > 0
    mean = lambda where, hit: F.round(F.avg(F.when(where, F.when(hit, 1.0).otherwise(0.0))), 6)
    return snapshots(spark, sf).groupBy("run_id").agg(mean(real, c("alert_level") != "NONE").alias("detection"), mean(~real, c("alert_level") != "NONE").alias("false_positive"), mean(real, c("alert_level") == "HIGH").alias("true_positive"))


CONFUSION = "(SELECT run_id, count(*) FILTER (WHERE NOT hit AND NOT r) AS tn, count(*) FILTER (WHERE hit AND NOT r) AS fp, count(*) FILTER (WHERE hit AND r) AS tp, count(*) FILTER (WHERE NOT hit AND r) AS fn FROM (SELECT run_id, alert_level IN ('MEDIUM', 'HIGH', 'CRITICAL') AS hit, attack_percent > 0 AS r FROM snapshots) s GROUP BY run_id) k"


@query("snap_confusion", sql(f"SELECT run_id, CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(tp AS BIGINT) AS tp, CAST(fn AS BIGINT) AS fn FROM {CONFUSION}", *SNAP))
def snap_confusion(spark, sf):
    return U.confusion(snapshots(spark, sf))


def guarded(a, b):
    return f"round(CASE WHEN ({b}) > 0 THEN ({a}) / ({b})::DOUBLE ELSE 0 END, 6)"


@query("snap_efficacy", sql(f"SELECT run_id, {guarded('tp + tn', 'tp + tn + fp + fn')} AS accuracy, {guarded('tp', 'tp + fp')} AS precision, {guarded('tp', 'tp + fn')} AS recall, {guarded('2 * tp', '2 * tp + fp + fn')} AS f1 FROM {CONFUSION}", *SNAP))
def snap_efficacy(spark, sf):
    return U.efficacy(U.confusion(snapshots(spark, sf))).select("run_id", "accuracy", "precision", "recall", "f1")


REASONS = "(SELECT w, unnest([CASE WHEN small > 0.25 * packets THEN concat('small share ', small) END, CASE WHEN udp > 0.21 * packets THEN concat('UDP rate ', udp) END, CASE WHEN syn > 0.34 * tcp THEN concat('SYN rate ', syn) END]) AS reason FROM counters) r"


def reasons(spark, sf):
    rows = K.window_counters(packets(spark, sf), "1 day")
    found = F.array_compact(F.array(F.when(c("small") > 0.25 * c("packets"), F.concat(F.lit("small share "), c("small"))), F.when(c("udp") > 0.21 * c("packets"), F.concat(F.lit("UDP rate "), c("udp"))), F.when(c("syn") > 0.34 * c("tcp"), F.concat(F.lit("SYN rate "), c("syn")))))
    return rows.select("w", F.explode(found).alias("reason"))


@query("snap_reason_types", sql(f"SELECT CASE WHEN lower(reason) LIKE '%small%' THEN 'small' WHEN lower(reason) LIKE '%syn%' THEN 'syn' WHEN lower(reason) LIKE '%udp%' THEN 'udp' ELSE 'other' END AS category, count(*) AS n FROM {REASONS} WHERE reason IS NOT NULL GROUP BY 1", "counters"))
def snap_reason_types(spark, sf):
    return reasons(spark, sf).groupBy(U.reason_category(c("reason")).alias("category")).agg(F.count("*").alias("n"))


@query("snap_reason_rates", sql(f"SELECT split_part(reason, ' ', 1) AS kind, count(*) AS n, round(avg(CAST(regexp_extract(reason, '([0-9]+)$', 1) AS DOUBLE)), 6) AS mean_rate FROM {REASONS} WHERE reason IS NOT NULL GROUP BY 1", "counters"))
def snap_reason_rates(spark, sf):
    return reasons(spark, sf).groupBy(F.split_part("reason", F.lit(" "), F.lit(1)).alias("kind")).agg(F.count("*").alias("n"), F.round(F.avg(T.extract_number(c("reason"), "([0-9]+)$")), 6).alias("mean_rate"))


@query("snap_attack_ranges", sql("SELECT run_id, CASE WHEN attack_percent < 0.1 THEN 'none' WHEN attack_percent < 10 THEN 'low' WHEN attack_percent < 15 THEN 'medium' ELSE 'high' END AS bin, count(*) AS n FROM snapshots GROUP BY 1, 2", *SNAP))
def snap_attack_ranges(spark, sf):
    return snapshots(spark, sf).groupBy("run_id", S.bins(c("attack_percent"), (0.1, 10, 15), ("none", "low", "medium", "high")).alias("bin")).agg(F.count("*").alias("n"))


@query("snap_link_util", sql(f"SELECT run_id, round(avg(u), 9) AS avg_util, round(max(u), 9) AS max_util, round(min(u), 9) AS min_util, round(100 - max(u), 9) AS headroom FROM (SELECT run_id, bytes_d * 8 / 1e9 / 5 / 25 * 100 AS u FROM {DELTA}) x GROUP BY run_id", *SNAP))
def snap_link_util(spark, sf):
    rows = U.with_deltas(snapshots(spark, sf)).withColumn("u", T.link_utilisation(c("bytes_d") * 8 / 1e9 / 5))
    return rows.groupBy("run_id").agg(F.round(F.avg("u"), 9).alias("avg_util"), F.round(F.max("u"), 9).alias("max_util"), F.round(F.min("u"), 9).alias("min_util"), F.round(100 - F.max("u"), 9).alias("headroom"))


#: Widths of the bins of each metric.
WIDTHS = {"pkt_len": 100, "ttl": 4, "src_port": 1000, "dst_port": 1000, "gap_us": 60_000_000}
LONG = ("SELECT 'pkt_len' AS metric, CAST(pkt_len AS BIGINT) AS value FROM packets UNION ALL SELECT 'ttl', CAST(64 - src_ip % 13 AS BIGINT) FROM packets UNION ALL SELECT 'src_port', CAST(src_port AS BIGINT) FROM packets UNION ALL SELECT 'dst_port', CAST(dst_port AS BIGINT) FROM packets"
        " UNION ALL SELECT 'gap_us', epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts, pkt_id)) FROM packets")  # fmt: skip


@query("dist_extract", sql("SELECT metric, bin, n, CAST(sum(n) OVER (PARTITION BY metric) AS BIGINT) AS total, true AS within_bound FROM (SELECT metric, CAST(value // CASE metric " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WIDTHS.items()) + f" END AS BIGINT) AS bin, count(*) AS n FROM ({LONG}) l WHERE value IS NOT NULL GROUP BY 1, 2) b"))
def dist_extract(spark, sf):
    """Histograms of packet size, time to live, ports and the time since the packet before, as read from frames; with
    each whether the quantiles of its sketches, made by day and united, are within their bound of the exact ranks."""
    from tidegate.sources import frames as N

    read = N.decode_frames(N.pack_frames(packets(spark, sf))).withColumn("us", F.unix_micros(c("ts").cast("timestamp")))
    day = F.floor(c("us") / 86_400_000_000)
    # Packets of one time are told apart by their number.
    order = read.withColumn("at", F.struct("us", "pkt_id"))
    seen = B.lagged(B.numbered(order, "at", day), "us", "before").select(F.floor(c("us") / 86_400_000_000).alias("day"), c("pkt_len").cast("long").alias("pkt_len"), c("ttl").cast("long").alias("ttl"), c("src_port").cast("long").alias("src_port"), c("dst_port").cast("long").alias("dst_port"), (c("us") - c("before")).alias("gap_us"))
    long = seen.unpivot(["day"], list(WIDTHS), "metric", "value").where("value IS NOT NULL")
    told = D.quantiles(D.united(D.sketches(long, "metric", "day"), "metric"), "metric").drop("n")
    counts = long.groupBy("metric", "value").agg(F.count("*").alias("times"))
    width = F.element_at(F.create_map(*[F.lit(x) for kv in WIDTHS.items() for x in kv]), c("metric"))
    bins = counts.groupBy("metric", F.floor(c("value") / width).alias("bin")).agg(F.sum("times").alias("n"))
    whole = counts.groupBy("metric").agg(F.sum("times").alias("total")).join(D.within_rank(told, counts, "metric"), "metric")
    return bins.join(F.broadcast(whole), "metric").select("metric", "bin", "n", "total", "within_bound")  # a row for each metric


@query("replay_report", sql("""SELECT net AS run_id, CAST(count(*) AS BIGINT) AS files, CAST(sum(n) AS BIGINT) AS packets, CAST(count(*) FILTER (WHERE n >= 80) AS BIGINT) AS ok, CAST(count(*) FILTER (WHERE n < 80) AS BIGINT) AS failed, CAST(sum(d) AS BIGINT) AS duration_sec, round(avg(round(b * 8 / 1e6 / greatest(d, 1)::DOUBLE, 9)), 9) AS mean_mbps
  FROM (SELECT net, w, count(*) AS n, sum(pkt_len) AS b, epoch_us(max(ts)) // 1000000 - epoch_us(min(ts)) // 1000000 AS d FROM packets GROUP BY net, w) s GROUP BY net"""))
def replay_report(spark, sf):
    """A report written as CSV (a row for each file sent) and summed up when read."""
    path = scratch(spark, "replay")
    rows = packets(spark, sf).groupBy(T.network_class(c("src_ip")).alias("run_id"), K.window_start("1 day").alias("w")).agg(F.count("*").alias("packets_sent"), F.sum("pkt_len").alias("b"), (F.unix_seconds(F.max("ts").cast("timestamp")) - F.unix_seconds(F.min("ts").cast("timestamp"))).alias("duration_sec")).transform(K.named)
    report = rows.select("run_id", c("w").alias("timestamp"), F.concat("run_id", F.lit("/"), "w", F.lit(".pcap")).alias("pcap_file"), "packets_sent", "duration_sec", F.round(c("b") * 8 / 1e6 / F.greatest("duration_sec", F.lit(1)), 9).alias("mbps_actual"), F.when(c("packets_sent") >= 80, "OK").otherwise("FAILED").alias("status"))
    report.write.csv(path, header=True)
    back = spark.read.schema("run_id string, timestamp string, pcap_file string, packets_sent long, duration_sec long, mbps_actual double, status string").csv(path, header=True)
    return back.groupBy("run_id").agg(F.count("*").alias("files"), F.sum("duration_sec").alias("duration_sec"), F.round(F.avg("mbps_actual"), 9).alias("mean_mbps"), F.sum("packets_sent").alias("packets"), F.count_if(c("status") == "OK").alias("ok"), F.count_if(c("status") == "FAILED").alias("failed"))
