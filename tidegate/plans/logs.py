"""Detector logs: written in the detectors' forms, read as a splittable source, all fields; and what is computed from them.

The given tables hold no logs, so hourly blocks of a detector are derived from the packets (``detector_blocks``); a
day is a log. Figures that no packet has (card counters, sketches) are counts of packets by number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegate.functions import traffic as T
from tidegate.operators import distributions as Q
from tidegate.operators import runs as U
from tidegate.plans.registry import query
from tidegate.sources import detector_logs as D
from tidegate.sources.storage import scratch
from tidegate.sources.tables import SQL, packets

c = F.col


def whole(a: str, b: str) -> str:
    """Integer division of positive numbers, as text that means the same to Spark and DuckDB."""
    return f"CAST((({a}) - ({a}) % ({b})) / ({b}) AS BIGINT)"


COUNTS = {
    "n": "count(*)", "bytes": "sum(pkt_len)", "base": "sum(CASE WHEN net = 'baseline' THEN 1 ELSE 0 END)", "att": "sum(CASE WHEN net = 'attack' THEN 1 ELSE 0 END)", "base_bytes": "sum(CASE WHEN net = 'baseline' THEN pkt_len ELSE 0 END)", "att_bytes": "sum(CASE WHEN net = 'attack' THEN pkt_len ELSE 0 END)",
    "tcp": "sum(CASE WHEN proto = 6 THEN 1 ELSE 0 END)", "udp": "sum(CASE WHEN proto = 17 THEN 1 ELSE 0 END)", "icmp": "sum(CASE WHEN proto = 1 THEN 1 ELSE 0 END)", "syn": "sum(CASE WHEN (tcp_flags & 2) <> 0 THEN 1 ELSE 0 END)", "ack": "sum(CASE WHEN (tcp_flags & 16) <> 0 THEN 1 ELSE 0 END)", "syn_ack": "sum(CASE WHEN (tcp_flags & 18) = 18 THEN 1 ELSE 0 END)",
    "http": "sum(CASE WHEN proto = 6 AND dst_port = 80 THEN 1 ELSE 0 END)", "post": "sum(CASE WHEN proto = 6 AND dst_port = 80 AND pkt_id % 5 = 0 THEN 1 ELSE 0 END)", "top": "sum(CASE WHEN proto = 6 AND dst_port = 80 AND pkt_id % 7 = 0 THEN 1 ELSE 0 END)", "dns": "sum(CASE WHEN proto = 17 AND (src_port = 53 OR dst_port = 53) THEN 1 ELSE 0 END)",
    "quic": "sum(CASE WHEN proto = 17 AND (src_port = 443 OR dst_port = 443) THEN 1 ELSE 0 END)", "quic_long": "sum(CASE WHEN proto = 17 AND (src_port = 443 OR dst_port = 443) AND pkt_id % 3 = 0 THEN 1 ELSE 0 END)", "bytes_in": "sum(CASE WHEN proto = 17 AND dst_port = 443 THEN pkt_len ELSE 0 END)", "bytes_out": "sum(CASE WHEN proto = 17 AND src_port = 443 THEN pkt_len ELSE 0 END)",
    "ips": "count(DISTINCT src_ip)", "missed": "sum(CASE WHEN pkt_id % 50 = 7 THEN 1 ELSE 0 END)", "no_buffer": "sum(CASE WHEN pkt_id % 97 = 3 THEN 1 ELSE 0 END)", "errors": "sum(CASE WHEN pkt_id % 211 = 5 THEN 1 ELSE 0 END)", "polls": "sum(pkt_id % 11)", "empty": "sum(CASE WHEN pkt_id % 11 > 3 THEN pkt_id % 11 - 1 ELSE 0 END)",
}
ALERT = "att * 7 > n * 2"
LEVEL = f"CASE WHEN {ALERT} THEN 'HIGH' WHEN syn * 5 > tcp * 2 THEN 'LOW' ELSE 'NONE' END"
TOTAL = "CASE WHEN h % 9 = 5 THEN NULL ELSE n END"
FIRST = f"{ALERT} AND h % 3 = 0"  # hours whose block tells a latency
SHARED = {"total_packets": TOTAL, "baseline_packets": "base", "baseline_percent": f"{whole('1000 * base', 'n')} / 10e0", "attack_packets": "att", "attack_percent": f"{whole('1000 * att', 'n')} / 10e0", "alert_level": LEVEL, "alert_reason": f"CASE WHEN {ALERT} THEN concat('UDP FLOOD detected: ', udp, ' UDP pps | SYN FLOOD detected: ', syn, ' SYN pps') END"}
FIELDS = {
    "aggregate": SHARED | {
        "tcp_packets": "tcp", "udp_packets": "udp", "icmp_packets": "icmp", "baseline_gbps": f"{whole('base_bytes', '10')} / 100e0", "attack_gbps": f"{whole('att_bytes', '10')} / 100e0", "total_gbps": f"{whole('bytes', '10')} / 100e0", "cumulative_mpps": f"{whole('37 * n', '10')} / 100e0", "cumulative_gbps": f"{whole('3 * bytes', '10')} / 100e0",
        "syn_packets": "syn", "syn_ack_packets": "syn_ack", "syn_ack_ratio": f"{whole('100 * syn', 'greatest(ack, 1)')} / 100e0", "http_requests": "http", "dns_queries": "dns",
        "udp_flood_events": "CASE WHEN udp * 4 > n THEN udp ELSE 0 END", "syn_flood_events": "CASE WHEN syn * 3 > tcp THEN syn ELSE 0 END", "http_flood_events": "CASE WHEN http * 4 > n THEN http ELSE 0 END", "icmp_flood_events": "CASE WHEN icmp * 5 > n THEN icmp ELSE 0 END", "dns_amp_events": "CASE WHEN dns > 1 THEN dns ELSE 0 END",
        "throughput_mpps": f"{whole('7 * n', '10')} / 100e0", "cycles_per_pkt": whole("100000", "n"), "active_ips": "ips", "rx_packets_nic": "n + missed", "rx_dropped": "missed", "rx_no_mbufs": "no_buffer", "rx_errors": "errors",
        "detection_latency_ms": f"CASE WHEN {FIRST} THEN (4000 + 100 * n + h) / 100e0 END", "improvement_factor": f"CASE WHEN {FIRST} THEN {whole('8660', 'n + 20')} / 10e0 END", "packets_until_detection": f"CASE WHEN {FIRST} THEN 3 * n END",
        "sketch_memory_kb": "64 * ips * 1e0", "sketch_sampling_rate": "CAST(32 AS BIGINT)", "sketch_updates": whole("32 * att", "7"),
    },
    "http": SHARED | {
        "http_packets": "http", "unique_ips": "ips", "heavy_hitters": whole("ips", "3"), "get_count": "http - post", "get_percent": f"{whole('1000 * (http - post)', 'greatest(http, 1)')} / 10e0", "post_count": "post", "post_percent": f"{whole('1000 * post', 'greatest(http, 1)')} / 10e0", "top_url_count": "top", "top_url_percent": f"{whole('1000 * top', 'greatest(http, 1)')} / 10e0",
    },
    "quic": SHARED | {
        "quic_packets": "quic", "long_headers": "quic_long", "short_headers": "quic - quic_long", "total_acks": "ack", "bytes_in": "bytes_in", "bytes_out": "bytes_out", "bytes_ratio": f"{whole('100 * bytes_out', 'greatest(bytes_in, 1)')} / 100e0", "unique_ips": "ips", "heavy_ackers": whole("ack", "5"), "suspicious_ips": whole("ips", "4"), "high_ack_rate_detections": whole("ack", "3"), "bytes_anomalies": whole("udp", "3"),
        "max_bytes_ratio": f"{whole('130 * bytes_out', 'greatest(bytes_in, 1)')} / 100e0", "max_ack_rate": "7 * ack", "amplification_at_detection": f"CASE WHEN {ALERT} THEN {whole('100 * bytes_out', 'greatest(bytes_in, 1)')} / 100e0 END", "mb_at_detection": f"CASE WHEN {ALERT} THEN {whole('bytes', '10')} / 100e0 END", "cycles_per_packet": f"{whole('90000', 'n')} / 10e0", "throughput_per_core_gbps": f"{whole('bytes', '14')} / 100e0",
    },
}

HOURS_SQL = "hours AS (SELECT *, CAST(row_number() OVER (PARTITION BY d ORDER BY h) - 1 AS BIGINT) AS idx FROM (SELECT strftime(ts, '%Y-%m-%d') AS d, CAST(hour(ts) AS BIGINT) AS h, " + ", ".join(f"CAST({v} AS BIGINT) AS {k}" for k, v in COUNTS.items()) + " FROM packets GROUP BY 1, 2) x)"


def logs_sql(body: str) -> str:
    """SQL over the hourly blocks."""
    return f"WITH packets AS ({SQL['packets']}),\n{HOURS_SQL}\n{body}"


def detector_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of each hour: d, h, idx (within the day) and COUNTS."""
    rows = packets(spark, sf).withColumn("net", T.network_class(c("src_ip")))
    hours = rows.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("d"), F.hour("ts").cast("long").alias("h")).agg(*[F.expr(v).cast("long").alias(k) for k, v in COUNTS.items()])
    return hours.withColumn("idx", F.row_number().over(Window.partitionBy("d").orderBy("h")).cast("long") - 1)


def field_rows(blocks: DataFrame, kind: str) -> DataFrame:
    return blocks.selectExpr("d", "idx", *[f"{v} AS {k}" for k, v in FIELDS[kind].items()])


def logged(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """Logs of a kind, written and read again: log, idx, time_s and all fields."""
    path = scratch(spark, f"log-{kind}")
    D.write_log(field_rows(detector_blocks(spark, sf), kind), D.LAYOUTS[kind], path, log="d")
    return D.read_log(spark, path, D.LAYOUTS[kind]).withColumn("log", F.regexp_extract("file", "log=([^/]+)", 1)).drop("file")


def fields_sql(kind: str) -> str:
    """What a reader must find: figures left out are 0 in aggregate logs; blocks without a total do not count in the others."""
    layout = D.LAYOUTS[kind]
    own = ", ".join(f"{FIELDS[kind][x]} AS {x}" for x in layout.columns)
    carried = "CASE WHEN detection_latency_ms IS NULL THEN (SELECT coalesce(arg_min(p.detection_latency_ms, p.idx), 0) FROM f p WHERE p.d = f.d AND p.idx <= f.idx AND p.detection_latency_ms > 0) ELSE detection_latency_ms END"

    def value(name: str, type_: str) -> str:
        if name == "detection_latency_ms":
            return f"{carried} AS {name}"
        if type_ == "string":
            return f"coalesce({name}, '{'' if layout.zero else 'None'}') AS {name}"
        return f"CAST({f'coalesce({name}, 0)' if layout.zero else name} AS {'BIGINT' if type_ == 'long' else 'DOUBLE'}) AS {name}"

    return logs_sql(f", f AS (SELECT d, idx, {own} FROM hours) SELECT d AS log, idx, idx * {layout.interval_s} AS time_s, {', '.join(value(n, t) for n, t, _ in layout.fields)} FROM f" + (f" WHERE {layout.needed} > 0" if layout.needed else ""))


@query("log_parse_agg", fields_sql("aggregate"))
def log_parse_agg(spark, sf):
    """All 38 fields and the running time of each block of aggregate logs."""
    return logged(spark, sf, "aggregate")


@query("log_parse_http", fields_sql("http"))
def log_parse_http(spark, sf):
    return logged(spark, sf, "http")


@query("log_parse_quic", fields_sql("quic"))
def log_parse_quic(spark, sf):
    return logged(spark, sf, "quic")


@query("sink_stats_text", logs_sql(f"SELECT d AS log, count(*) AS blocks, sum({TOTAL}) AS packets, count(*) FILTER (WHERE ({LEVEL}) = 'HIGH') AS high FROM hours GROUP BY d"))
def sink_stats_text(spark, sf):
    """Written as text, a file for each day; summed up when read again."""
    rows = logged(spark, sf, "aggregate")
    return rows.groupBy("log").agg(F.count("*").alias("blocks"), F.sum("total_packets").alias("packets"), F.count_if(c("alert_level") == "HIGH").alias("high"))


@query("src_stats_text", logs_sql("SELECT d AS log, idx, CAST(strpos(concat(baseline, attack), '10.10') AS INT) AS labelled FROM (SELECT d, idx, 'Baseline (10.10' AS baseline, '' AS attack FROM hours) x"))
def src_stats_text(spark, sf):
    """The blocks of logs with their place: those of one range of a file are numbered on from the ranges before."""
    path = scratch(spark, "log-blocks")
    D.write_log(field_rows(detector_blocks(spark, sf), "http"), D.HTTP, path, log="d")
    found = D.blocks(spark, path, D.HTTP)
    return found.select(F.regexp_extract("file", "log=([^/]+)", 1).alias("log"), "idx", F.instr(F.regexp_extract("text", r"Baseline \([^.]*\.[^.)]*", 0), "10.10").alias("labelled"))


NIC = "sum(n) AS processed, sum(missed) AS missed, sum(no_buffer) AS no_buffer, sum(errors) AS errors, sum(polls) AS polls, sum(empty) AS empty"
NIC_SHARES = "round(100e0 * (missed + no_buffer) / (processed + missed), 6) AS drop_pct, round(100e0 * processed / (processed + missed), 6) AS processed_pct, round(100e0 * empty / polls, 6) AS empty_pct"


@query("agg_nic_drops", logs_sql(f"SELECT d AS w, CAST(processed + missed AS BIGINT) AS received, CAST(processed AS BIGINT) AS processed, CAST(missed AS BIGINT) AS missed, CAST(no_buffer AS BIGINT) AS no_buffer, CAST(errors AS BIGINT) AS errors, CAST(missed + no_buffer AS BIGINT) AS dropped, CAST(polls AS BIGINT) AS polls, {NIC_SHARES} FROM (SELECT d, {NIC} FROM hours GROUP BY d) x"))
def agg_nic_drops(spark, sf):
    """Packets that the card received, missed or had no buffer for, and polls that came back empty."""
    rows = detector_blocks(spark, sf).groupBy(c("d").alias("w")).agg(F.sum("n").alias("processed"), *[F.sum(x).alias(x) for x in ("missed", "no_buffer", "errors", "polls", "empty")])
    received, dropped = c("processed") + c("missed"), c("missed") + c("no_buffer")
    pct = lambda a, b, name: F.round(100 * a / b, 6).alias(name)
    return rows.select("w", received.alias("received"), "processed", "missed", "no_buffer", "errors", dropped.alias("dropped"), "polls", pct(dropped, received, "drop_pct"), pct(c("processed"), received, "processed_pct"), pct(c("empty"), c("polls"), "empty_pct"))


@query("snap_drop_rate", logs_sql("SELECT d AS run_id, CAST(sum(missed) AS BIGINT) AS dropped, CAST(sum(n + missed) AS BIGINT) AS received, round(100e0 * sum(missed) / sum(n + missed), 6) AS drop_pct, round(max(100e0 * missed / (n + missed)), 6) AS worst_pct FROM hours GROUP BY d"))
def snap_drop_rate(spark, sf):
    """From the card's counters in the blocks of a log."""
    rows = logged(spark, sf, "aggregate")
    return rows.groupBy(c("log").alias("run_id")).agg(F.sum("rx_dropped").alias("dropped"), F.sum("rx_packets_nic").alias("received"), F.round(100 * F.sum("rx_dropped") / F.sum("rx_packets_nic"), 6).alias("drop_pct"), F.round(F.max(100 * c("rx_dropped") / c("rx_packets_nic")), 6).alias("worst_pct"))


@query("snap_sketch_memory", logs_sql(f"SELECT d AS run_id, CAST(arg_max(64 * ips, idx) AS DOUBLE) AS memory_kb, round(arg_max(64 * ips, idx) / 14e0, 6) AS per_worker_kb, CAST(32 AS BIGINT) AS sampling, CAST(sum({whole('32 * att', '7')}) AS BIGINT) AS updates, CAST(32 * sum({whole('32 * att', '7')}) AS BIGINT) AS estimated_packets FROM hours GROUP BY d"))
def snap_sketch_memory(spark, sf):
    """From the sketch figures of a log: memory of the last block, in all and for each of 14 workers; updates times the sampling rate."""
    rows = logged(spark, sf, "aggregate")
    last = rows.groupBy(c("log").alias("run_id")).agg(F.max_by("sketch_memory_kb", "idx").alias("memory_kb"), F.max("sketch_sampling_rate").alias("sampling"), F.sum("sketch_updates").alias("updates"))
    return last.select("run_id", "memory_kb", F.round(c("memory_kb") / 14, 6).alias("per_worker_kb"), "sampling", "updates", (c("updates") * c("sampling")).alias("estimated_packets"))


EVENTS = ("udp_flood_events", "syn_flood_events", "http_flood_events", "icmp_flood_events", "dns_amp_events")


@query("snap_run_summary", logs_sql(f", f AS (SELECT d, h, idx, n, bytes, att, missed, {', '.join(f'{v} AS {k}' for k, v in FIELDS['aggregate'].items())} FROM hours) SELECT d AS run_id, CAST(sum(coalesce(total_packets, 0)) AS BIGINT) AS packets, max(total_gbps) AS peak_gbps, round(avg(total_gbps), 6) AS mean_gbps, max(attack_percent) AS most_attack_pct, count(*) FILTER (WHERE alert_level = 'HIGH') AS highs, min(idx * 5) FILTER (WHERE alert_level <> 'NONE') AS first_alert_s, {', '.join(f'CAST(max({x}) AS BIGINT) AS max_{x}' for x in EVENTS)}, round(avg(cycles_per_pkt), 6) AS mean_cycles, CAST(min(cycles_per_pkt) AS BIGINT) AS least_cycles, round(100e0 * sum(missed) / sum(n + missed), 6) AS drop_pct FROM f GROUP BY d"))
def snap_run_summary(spark, sf):
    """Throughput, alerts, greatest event counts, cycles and drops of a log."""
    rows = logged(spark, sf, "aggregate")
    return rows.groupBy(c("log").alias("run_id")).agg(F.sum("total_packets").alias("packets"), F.max("total_gbps").alias("peak_gbps"), F.round(F.avg("total_gbps"), 6).alias("mean_gbps"), F.max("attack_percent").alias("most_attack_pct"), F.count_if(c("alert_level") == "HIGH").alias("highs"), F.min(F.when(c("alert_level") != "NONE", c("time_s"))).alias("first_alert_s"),
                                                  *[F.max(x).alias(f"max_{x}") for x in EVENTS], F.round(F.avg("cycles_per_pkt"), 6).alias("mean_cycles"), F.min("cycles_per_pkt").alias("least_cycles"), F.round(100 * F.sum("rx_dropped") / F.sum("rx_packets_nic"), 6).alias("drop_pct"))


LATENCIES = f"SELECT detection_latency_ms AS ms FROM ({fields_sql('aggregate')}) l WHERE detection_latency_ms > 0"


@query("snap_latency_hist", f"SELECT CAST(CASE WHEN hi > lo THEN least(20, floor((ms - lo) / (hi - lo) * 20) + 1) ELSE 1 END AS INT) AS bin, count(*) AS n, min(mean) AS mean_ms, true AS median_within FROM (SELECT ms, min(ms) OVER () AS lo, max(ms) OVER () AS hi, (SELECT round(avg(ms), 6) FROM ({LATENCIES}) m) AS mean FROM ({LATENCIES}) k) x GROUP BY 1")
def snap_latency_hist(spark, sf):
    """Detection latencies of logs in 20 bins of equal width, their mean, and whether the sketched median is within its bound."""
    rows = logged(spark, sf, "aggregate").where(c("detection_latency_ms") > 0).select(c("detection_latency_ms").alias("ms"), "log")
    bins = U.equal_bins(rows, "ms", 20)
    hundredths = rows.select(F.lit("ms").alias("metric"), "log", F.round(c("ms") * 100).cast("long").alias("value"))
    told = Q.quantiles(Q.united(Q.sketches(hundredths, "metric", "log"), "metric"), "metric", points=(0.5,)).drop("n")
    median = Q.within_rank(told, hundredths.groupBy("metric", "value").agg(F.count("*").alias("times")), "metric")
    one = rows.agg(F.round(F.avg("ms"), 6).alias("mean_ms")).crossJoin(median.select(c("within_bound").alias("median_within")))  # one row
    return bins.crossJoin(F.broadcast(one))
