"""Streaming queries, run over what is there and compared with the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate.functions import traffic as T
from tidegate.operators import counters as K
from tidegate.plans.registry import query
from tidegate.sources.tables import sql
from tidegate.sources.storage import scratch
from tidegate.sources.tables import table
from tidegate.streaming.gaps import detection_gaps
from tidegate.streaming.ticks import early_alerts
from tidegate.streaming.windows import dropped_rows, first_seen, on_time, packet_stream, run_available, stream_of

c = F.col
DAY = "1 day"
COUNTS = ("packets", "bytes", "tcp", "udp", "syn")
SMALL = "w, packets, bytes, tcp, udp, syn"


@query("st_tumbling_1s", sql("SELECT strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS w, CAST(count(*) AS BIGINT) AS packets, CAST(sum(pkt_len) AS BIGINT) AS bytes FROM packets GROUP BY 1"))
def st_tumbling_1s(spark, sf):
    stream = packet_stream(spark, sf)
    rows = stream.rows.groupBy(F.window("ts", "1 second").alias("win")).agg(F.count("*").alias("packets"), F.sum("pkt_len").alias("bytes"))
    return run_available(stream, rows, "tumbling-1s").select(F.date_format("win.start", "yyyy-MM-dd HH:mm:ss").alias("w"), "packets", "bytes")


@query("st_tumbling_5s", sql("SELECT CAST(epoch_us(ts) // 5000000 * 5 AS BIGINT) AS w, CAST(count(*) AS BIGINT) AS packets, CAST(count(*) FILTER (WHERE net = 'attack') AS BIGINT) AS attack FROM packets GROUP BY 1"))
def st_tumbling_5s(spark, sf):
    stream = packet_stream(spark, sf)
    rows = stream.rows.groupBy(F.window("ts", "5 seconds").alias("win")).agg(F.count("*").alias("packets"), T.count_where(T.network_class(c("src_ip")) == "attack").alias("attack"))
    return run_available(stream, rows, "tumbling-5s").select(F.unix_timestamp("win.start").alias("w"), "packets", "attack")


#: Limits of the early rule, scaled to daily windows of the fixtures: packets and attack share at the end of an hour's pane.
EARLY = {"packets": 8, "attack_pct": 28}
TICKS = """p AS (SELECT w, CAST(epoch_us(date_trunc('hour', ts)) AS BIGINT) AS pane, count(*) AS n, count(*) FILTER (WHERE net = 'attack') AS a FROM packets GROUP BY 1, 2),
r AS (SELECT w, pane, CAST(sum(n) OVER o AS BIGINT) AS packets, CAST(sum(a) OVER o AS BIGINT) AS attack FROM p WINDOW o AS (PARTITION BY w ORDER BY pane))"""


def early_attack(sums):
    return (sums["packets"] >= EARLY["packets"]) & (sums["attack"] * 100 > sums["packets"] * EARLY["attack_pct"])


@query("st_fast_tick", sql("", "packets").rstrip() + ",\n" + TICKS + f"""
SELECT d.w, f.pane, coalesce(f.packets, 0) AS packets, coalesce(f.attack, 0) AS attack FROM (SELECT DISTINCT w FROM p) d
LEFT JOIN (SELECT w, min(pane) AS pane, arg_min(packets, pane) AS packets, arg_min(attack, pane) AS attack FROM r WHERE packets >= {EARLY['packets']} AND attack * 100 > packets * {EARLY['attack_pct']} GROUP BY w) f USING (w)""")
def st_fast_tick(spark, sf):
    """A running window is evaluated again at each pane; the first pane at which the rule fires, when its window closes."""
    stream = packet_stream(spark, sf)
    sums = {"packets": F.lit(1), "attack": (T.network_class(c("src_ip")) == "attack").cast("long")}
    found = early_alerts(stream.rows.where(on_time()), DAY, "1 hour", sums, early_attack)
    done = run_available(stream, found, "fast-tick", "update").where("final")
    return done.select(F.date_format(F.timestamp_micros("win"), "yyyy-MM-dd HH:mm:ss").alias("w"), "pane", "packets", "attack")


@query("st_reset_state", sql(f"SELECT {SMALL}, sources FROM counters JOIN (SELECT w, count(DISTINCT src_ip) AS sources FROM packets GROUP BY w) s USING (w)", "counters"))
def st_reset_state(spark, sf):
    """Counters and the distinct sketch of each window; both are dropped when it closes."""
    found, stream = K.counter_columns(), packet_stream(spark, sf)
    rows = stream.rows.groupBy(F.window("ts", DAY).alias("win")).agg(*[found[x].alias(x) for x in COUNTS], F.hll_sketch_agg("src_ip", F.lit(14)).alias("sketch"))
    return run_available(stream, rows, "reset-state").select(F.date_format("win.start", "yyyy-MM-dd HH:mm:ss").alias("w"), *COUNTS, F.hll_sketch_estimate("sketch").alias("sources"))


@query("st_lifetime", sql("SELECT CAST(count(*) AS BIGINT) AS packets, CAST(sum(pkt_len) AS BIGINT) AS bytes FROM packets"))
def st_lifetime(spark, sf):
    """One row, which each batch replaces."""
    stream = packet_stream(spark, sf)
    return run_available(stream, stream.rows.where(on_time()).groupBy().agg(F.count("*").alias("packets"), F.sum("pkt_len").alias("bytes")), "lifetime", "complete")


@query("st_latch_first_detection", sql("SELECT src_ip, epoch_us(min(ts)) AS first_us FROM packets WHERE tcp_flags & 2 <> 0 GROUP BY src_ip"))
def st_latch_first_detection(spark, sf):
    stream = packet_stream(spark, sf)
    return first_seen(stream, stream.rows.where(T.has_flag(c("tcp_flags"), T.SYN)), "src_ip", "latch")


@query("st_inter_detection", sql("SELECT sensor, w, CAST(epoch(strptime(w, '%Y-%m-%d %H:%M:%S')) - epoch(strptime(lag(w) OVER (PARTITION BY sensor ORDER BY w), '%Y-%m-%d %H:%M:%S')) AS BIGINT) AS gap_s FROM (SELECT src_ip % 4 AS sensor, w FROM packets GROUP BY 1, 2 HAVING count(*) FILTER (WHERE tcp_flags & 2 <> 0) * 5 > count(*)) x"))
def st_inter_detection(spark, sf):
    """The time of each sensor's last detection is state that outlives the batch; a gap goes out with its second detection."""
    stream = packet_stream(spark, sf)
    syn = T.count_where(T.has_flag(c("tcp_flags"), T.SYN)).alias("syn")
    windows = stream.rows.where(on_time()).groupBy((c("src_ip") % 4).alias("sensor"), F.window("ts", DAY).alias("win")).agg(F.count("*").alias("packets"), syn)
    detections = windows.where(c("syn") * 5 > c("packets")).select("sensor", F.unix_micros("win.start").alias("at_us"))
    gaps = run_available(stream, detection_gaps(detections), "inter-detection")
    return gaps.select("sensor", F.date_format(F.timestamp_micros("at_us"), "yyyy-MM-dd HH:mm:ss").alias("w"), F.expr("gap_us div 1000000").alias("gap_s"))


@query("st_alert_sink", sql("SELECT w, 'SYN_FLOOD' AS alert_type FROM counters WHERE syn > 0.34 * tcp", "counters"))
def st_alert_sink(spark, sf):
    found, stream = K.counter_columns(), packet_stream(spark, sf)
    rows = stream.rows.groupBy(F.window("ts", DAY).alias("win")).agg(found["syn"].alias("syn"), found["tcp"].alias("tcp"))
    alerts = lambda b: b.where(c("syn") > 0.34 * c("tcp")).select(F.date_format("win.start", "yyyy-MM-dd HH:mm:ss").alias("w"), F.lit("SYN_FLOOD").alias("alert_type"))
    return run_available(stream, rows, "alert-sink", then=alerts)


LATE = "event_id % 40 = 0 AND ts < TIMESTAMP '2024-01-20 00:00:00'"


@query("st_late_data", sql(f"SELECT w, CAST(count(*) FILTER (WHERE NOT late) AS BIGINT) AS packets, CAST((SELECT count(*) FROM events WHERE {LATE}) AS BIGINT) AS dropped FROM (SELECT w, pkt_id % 40 = 0 AND ts < TIMESTAMP '2024-01-20 00:00:00' AS late FROM packets) s GROUP BY w"))
def st_late_data(spark, sf):
    """One packet in 40 of the first days comes after all others, behind the watermark. Packets are deduplicated within
    the watermark before they are counted, so the engine's own count of dropped rows is one of packets."""
    events = table(spark, sf, "events")
    path = scratch(spark, "late-in")
    bring = lambda cond: lambda: events.where(cond).write.mode("append").parquet(path)
    bring(f"NOT ({LATE})")()
    stream = stream_of(spark, path, events.schema)
    rows = stream.rows.dropDuplicatesWithinWatermark(["pkt_id"]).groupBy(F.window("ts", DAY).alias("win")).agg(F.count("*").alias("packets"))
    seen: list = []
    done = run_available(stream, rows, "late-data", feeds=[bring(LATE)], progress=seen).where(on_time("win.start"))
    return done.select(F.date_format("win.start", "yyyy-MM-dd HH:mm:ss").alias("w"), "packets", F.lit(dropped_rows(seen)).cast("long").alias("dropped"))


@query("st_session_flows", sql("""SELECT src_ip, CAST(epoch_us(min(ts)) AS BIGINT) AS start_us, CAST(count(*) AS BIGINT) AS packets FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 86400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY src_ip ORDER BY ts, pkt_id) AS s
  FROM (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY src_ip ORDER BY ts, pkt_id)) AS gap FROM packets) a) b GROUP BY src_ip, s"""))
def st_session_flows(spark, sf):
    stream = packet_stream(spark, sf)
    rows = stream.rows.where(on_time()).groupBy("src_ip", F.session_window("ts", DAY).alias("s")).agg(F.count("*").alias("packets"))
    return run_available(stream, rows, "sessions").select("src_ip", F.unix_micros("s.start").alias("start_us"), "packets")


@query("st_sketch_merge", sql("""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS d, count(DISTINCT src_ip) AS sources, CAST((SELECT count(DISTINCT src_ip) FROM packets) AS BIGINT) AS run_sources,
  CAST(count(*) FILTER (WHERE src_ip % 7 = 0) AS BIGINT) AS cell_0, CAST((SELECT count(*) FROM packets WHERE src_ip % 7 = 0) AS BIGINT) AS run_cell_0 FROM packets GROUP BY 1"""))
def st_sketch_merge(spark, sf):
    """Sketches of hours, united to days and to the run: distinct counts by union, counter cells by sum."""
    stream = packet_stream(spark, sf)
    cell = F.sum(F.when(c("src_ip") % 7 == 0, 1).otherwise(0)).alias("cell_0")
    hours = stream.rows.groupBy(F.window("ts", "1 hour").alias("win")).agg(F.hll_sketch_agg("src_ip", F.lit(14)).alias("sketch"), cell)
    union = lambda rows, *by: rows.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"), F.sum("cell_0").alias("cell_0"))
    days = union(run_available(stream, hours, "sketch-merge").withColumn("d", F.date_format("win.start", "yyyy-MM-dd")), "d")
    run = union(days).select(F.hll_sketch_estimate("sketch").alias("run_sources"), c("cell_0").alias("run_cell_0"))
    return days.select("d", F.hll_sketch_estimate("sketch").alias("sources"), "cell_0").crossJoin(run)
