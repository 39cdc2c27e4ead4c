"""Window functions over interval series and packets of a source."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidegate.functions import quic as Q
from tidegate.functions import traffic as T
from tidegate.operators import blocks as B
from tidegate.operators import counters as K
from tidegate.operators import series as S
from tidegate.plans.registry import query
from tidegate.sources.tables import packets, snapshots, sql

c = F.col
DAY = "1 day"
SNAP = ("packets", "snapshots")


def in_weeks():
    """The block of a daily row: blocks are ranges of time, so series of any length are in many of them."""
    return F.floor(F.unix_timestamp("w", "yyyy-MM-dd HH:mm:ss") / (7 * 86400))


def daily_series(spark, sf, *names):
    return K.window_counters(packets(spark, sf), DAY, only=names)


@query("win_counter_delta", sql("""SELECT run_id, idx, CAST(greatest(0, total_packets - coalesce(lag(total_packets) OVER o, 0)) AS BIGINT) AS packets_delta, round(greatest(0, total_packets - coalesce(lag(total_packets) OVER o, 0)) / 5.0::DOUBLE, 6) AS packets_rate,
  CAST(greatest(0, total_bytes - coalesce(lag(total_bytes) OVER o, 0)) AS BIGINT) AS bytes_delta FROM snapshots WINDOW o AS (PARTITION BY run_id ORDER BY idx)""", *SNAP))
def win_counter_delta(spark, sf):
    rows = S.counter_deltas(snapshots(spark, sf), ("total_packets", "total_bytes"), seconds=5.0)
    return rows.select("run_id", "idx", c("total_packets_delta").alias("packets_delta"), c("total_packets_rate").alias("packets_rate"), c("total_bytes_delta").alias("bytes_delta"))


@query("win_sliding_stats", sql("""SELECT w, pm AS packets_mean, ps AS packets_std, px AS packets_max, bm AS bytes_mean, tm AS tcp_share_mean, um AS udp_share_mean, im AS icmp_share_mean, sm AS syn_share_mean FROM (SELECT w, round(avg(packets) OVER o, 6) AS pm, round(stddev_samp(packets) OVER o, 6) AS ps, round(CAST(max(packets) OVER o AS DOUBLE), 6) AS px,
  round(avg(bytes) OVER o, 6) AS bm, round(avg(tcp / packets::DOUBLE) OVER o, 6) AS tm, round(avg(udp / packets::DOUBLE) OVER o, 6) AS um, round(avg(icmp / packets::DOUBLE) OVER o, 6) AS im, round(avg(CASE WHEN tcp > 0 THEN syn / tcp::DOUBLE ELSE 0 END) OVER o, 6) AS sm, count(*) OVER o AS n FROM counters WINDOW o AS (ORDER BY w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) s WHERE n = 10""", "counters"))
def win_sliding_stats(spark, sf):
    rows = daily_series(spark, sf, "packets", "bytes", "tcp", "udp", "icmp", "syn")
    rows = rows.withColumns({f"{x}_share": F.when(c(of) > 0, c(x) / c(of)).otherwise(0.0) for x, of in (("tcp", "packets"), ("udp", "packets"), ("icmp", "packets"), ("syn", "tcp"))})
    mean = lambda x: lambda w: F.round(F.avg(x).over(w), 6)
    stats = {f"{x}_mean": mean(x) for x in ("packets", "bytes", "tcp_share", "udp_share", "icmp_share", "syn_share")} | {"packets_std": lambda w: F.round(F.stddev_samp("packets").over(w), 6), "packets_max": lambda w: F.max("packets").over(w).cast("double")}
    out = B.trailing(B.numbered(rows, "w", in_weeks()), stats, 10, block_rows=16).where("place >= 9")
    return out.select("w", *stats)


@query("win_cumulative", sql("SELECT w, CAST(sum(packets) OVER (ORDER BY w) AS BIGINT) AS packets, CAST(sum(bytes) OVER (ORDER BY w) AS BIGINT) AS bytes FROM counters", "counters"))
def win_cumulative(spark, sf):
    rows = daily_series(spark, sf, "packets", "bytes")
    return B.running(rows, "w", in_weeks(), {x: B.Scan(c(x)) for x in ("packets", "bytes")}).select("w", "packets", "bytes")


@query("win_relative_time", sql("SELECT pkt_id, round((epoch_us(ts) - epoch_us((SELECT min(ts) FROM packets))) / 1e6, 6) AS seconds FROM packets"))
def win_relative_time(spark, sf):
    p = packets(spark, sf)
    first = F.broadcast(p.agg(F.min("ts").alias("first_ts")))  # one row
    micros = lambda x: F.unix_micros(c(x).cast("timestamp"))
    return p.crossJoin(first).select("pkt_id", F.round((micros("ts") - micros("first_ts")) / 1e6, 6).alias("seconds"))


@query("win_inter_arrival", sql("SELECT pkt_id, round((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY src_ip ORDER BY ts, pkt_id))) / 1e6, 6) AS gap FROM packets"))
def win_inter_arrival(spark, sf):
    rows = packets(spark, sf).withColumn("us", F.unix_micros(c("ts").cast("timestamp")))
    return S.split_lag(rows, "src_ip", ("ts", "pkt_id"), "us", F.date_trunc("day", "ts"), "before").select("pkt_id", F.round((c("us") - c("before")) / 1e6, 6).alias("gap"))


#: The detector of the series fixtures: a day is detected where its share of attack packets is above a quarter.
DETECTED = "SELECT w, row_number() OVER (ORDER BY w) AS k, CAST(epoch_ms(strptime(w, '%Y-%m-%d %H:%M:%S')) AS BIGINT) AS ms FROM counters WHERE attack * 4 > packets"


def detections(spark, sf):
    rows = K.window_counters(packets(spark, sf), DAY, only=("packets", "attack", "bytes")).where(c("attack") * 4 > c("packets"))
    return rows.select("w", (F.unix_timestamp("w", "yyyy-MM-dd HH:mm:ss") * 1000).alias("ms"), "packets", "bytes", "attack")


def gaps(spark, sf):
    rows = B.lagged(B.numbered(detections(spark, sf), "ms", in_weeks()), "ms", "before", block_rows=16)
    return rows.withColumn("gap_ms", c("ms") - c("before")).where("gap_ms IS NOT NULL")


GAPS = f"SELECT ms - lag(ms) OVER (ORDER BY k) AS gap_ms FROM ({DETECTED}) d QUALIFY gap_ms IS NOT NULL"


@query("win_inter_detection", sql(f"SELECT CAST(min(gap_ms) AS BIGINT) AS min_gap, CAST(max(gap_ms) AS BIGINT) AS max_gap, round(avg(gap_ms), 6) AS avg_gap, count(*) AS n FROM ({GAPS}) g", "counters"))
def win_inter_detection(spark, sf):
    return gaps(spark, sf).agg(F.min("gap_ms").alias("min_gap"), F.max("gap_ms").alias("max_gap"), F.round(F.avg("gap_ms"), 6).alias("avg_gap"), F.count("*").alias("n"))


#: Edges of the latency histogram (milliseconds) and names of its bins.
EDGES, BIN_NAMES = (20, 30, 40, 50), ("< 20 ms", "20-30 ms", "30-40 ms", "40-50 ms", "> 50 ms")
BINS_SQL = "CASE " + " ".join(f"WHEN ms < {e} THEN '{n}'" for e, n in zip(EDGES, BIN_NAMES, strict=False)) + f" ELSE '{BIN_NAMES[-1]}' END"


@query("win_latency_histogram", sql(f"SELECT bin, n, round(CASE WHEN total > 0 THEN 100.0::DOUBLE * n / total ELSE 0 END, 6) AS pct FROM (SELECT b.bin, count(g.bin) AS n, (SELECT count(*) FROM ({GAPS}) t) AS total FROM (SELECT unnest([{', '.join(repr(x) for x in BIN_NAMES)}]) AS bin) b LEFT JOIN (SELECT {BINS_SQL} AS bin FROM (SELECT gap_ms / 3600000 AS ms FROM ({GAPS}) x) y) g USING (bin) GROUP BY b.bin) z", "counters"))
def win_latency_histogram(spark, sf):
    """Gaps between detections in the detector's bins, empty ones too. The fixture's hours stand for milliseconds."""
    found = gaps(spark, sf).groupBy(S.bins(c("gap_ms") / 3600000, EDGES, BIN_NAMES).alias("bin")).agg(F.count("*").alias("n"))
    every = spark.createDataFrame([(x,) for x in BIN_NAMES], "bin string").join(found, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
    whole = F.broadcast(every.agg(F.sum("n").alias("total")))  # one row
    return every.crossJoin(whole).select("bin", "n", F.round(F.when(c("total") > 0, 100 * c("n") / c("total")).otherwise(0.0), 6).alias("pct"))


@query("win_first_detection", sql("SELECT w, total_packets, total_bytes, attack_share FROM (SELECT w, CAST(sum(packets) OVER o AS BIGINT) AS total_packets, CAST(sum(bytes) OVER o AS BIGINT) AS total_bytes, round(attack / packets::DOUBLE, 6) AS attack_share, attack * 4 > packets AS hit FROM counters WINDOW o AS (ORDER BY w)) s WHERE hit ORDER BY w LIMIT 1", "counters"))
def win_first_detection(spark, sf):
    """The totals up to the first window that is detected: that window first, then one sum over what is not after it."""
    rows = daily_series(spark, sf, "packets", "bytes", "attack")
    first = rows.where(c("attack") * 4 > c("packets")).agg(F.min("w").alias("first")).where("first IS NOT NULL")  # one row
    upto = rows.join(F.broadcast(first), c("w") <= c("first"))
    found = upto.groupBy("first").agg(F.sum("packets").alias("total_packets"), F.sum("bytes").alias("total_bytes"), F.round(F.max(F.when(c("w") == c("first"), c("attack") / c("packets"))), 6).alias("attack_share"))
    return found.withColumnRenamed("first", "w")


@query("win_detection_latency", sql(f"SELECT CAST(min(d.ms) + 86400000 - (SELECT epoch_us(min(ts)) // 1000 FROM packets WHERE net = 'attack') AS BIGINT) AS latency_ms, round((min(d.ms) + 86400000 - (SELECT epoch_us(min(ts)) // 1000 FROM packets WHERE net = 'attack')) / 866.0::DOUBLE, 6) AS factor FROM ({DETECTED}) d", "counters"))
def win_detection_latency(spark, sf):
    first = packets(spark, sf).where(T.network_class(c("src_ip")) == "attack").agg(F.unix_millis(F.min("ts").cast("timestamp")).alias("first_ms"))
    seen = detections(spark, sf).agg(F.min("ms").alias("ms"))
    rows = seen.crossJoin(first).withColumn("latency_ms", c("ms") + 86400000 - c("first_ms"))
    return rows.select("latency_ms", F.round(c("latency_ms") / 866.0, 6).alias("factor"))


@query("win_ack_rate", sql("SELECT w, round(ack / 86400.0::DOUBLE, 6) AS ack_rate, CASE WHEN ack > 145 THEN 'critical' WHEN ack > 130 THEN 'warning' ELSE 'normal' END AS band FROM counters", "counters"))
def win_ack_rate(spark, sf):
    rows = K.window_counters(packets(spark, sf), DAY, only=("ack",))
    return rows.select("w", F.round(c("ack") / 86400.0, 6).alias("ack_rate"), T.band(c("ack"), 130, 145, ("normal", "warning", "critical")).alias("band"))


@query("win_pktnum_jump", sql("SELECT src_ip, CAST(count(*) FILTER (WHERE jump > 1000) AS BIGINT) AS jumps, CAST(max(jump) AS BIGINT) AS max_jump FROM (SELECT src_ip, pkt_id - lag(pkt_id) OVER (PARTITION BY src_ip ORDER BY ts, pkt_id) AS jump FROM packets WHERE proto = 17 AND pkt_id % 3 < 2) s GROUP BY src_ip"))
def win_pktnum_jump(spark, sf):
    """Jumps in the largest packet number that a source acknowledges, from one of its acknowledgements to the next."""
    rows = Q.acknowledged_jumps(Q.with_sample_payload(packets(spark, sf).where(c("proto") == T.UDP)))
    return rows.groupBy("src_ip").agg(T.count_where(c("jump") > 1000).alias("jumps"), F.max("jump").alias("max_jump"))


@query("win_ack_burst", sql("SELECT src_ip, count(*) AS bursts, count(*) > 1 AS alert FROM (SELECT src_ip, epoch_us(ts) // 43200000000 AS pane, count(*) AS n FROM packets WHERE proto = 17 AND pkt_id % 3 < 2 GROUP BY 1, 2 HAVING count(*) > 1) s GROUP BY src_ip"))
def win_ack_burst(spark, sf):
    """The fixture spreads packets over a month, so panes of half a day with more than one acknowledgement stand for 100 ms with more than 100."""
    acks = Q.acknowledgements(Q.with_sample_payload(packets(spark, sf).where(c("proto") == T.UDP)))
    return Q.ack_bursts(acks, "12 hours", 1).groupBy("src_ip").agg(F.count("*").alias("bursts")).withColumn("alert", c("bursts") > 1)


@query("win_first_high_span", sql("SELECT run_id, min(idx) FILTER (WHERE alert_level = 'HIGH') AS first_high, max(idx) AS last_idx, CAST(count(*) FILTER (WHERE alert_level = 'HIGH') AS BIGINT) AS highs FROM snapshots GROUP BY run_id", *SNAP))
def win_first_high_span(spark, sf):
    high = c("alert_level") == "HIGH"
    return snapshots(spark, sf).groupBy("run_id").agg(F.min(F.when(high, c("idx"))).alias("first_high"), F.max("idx").alias("last_idx"), T.count_where(high).alias("highs"))


@query("win_monotonic_check", sql("SELECT run_id, CAST(count(*) FILTER (WHERE total_packets < p) AS BIGINT) AS violations FROM (SELECT run_id, total_packets, lag(total_packets) OVER (PARTITION BY run_id ORDER BY idx) AS p FROM snapshots) s GROUP BY run_id", *SNAP))
def win_monotonic_check(spark, sf):
    rows = snapshots(spark, sf).withColumn("p", F.lag("total_packets").over(S.ordered()))
    return rows.groupBy("run_id").agg(T.count_where(F.coalesce(c("total_packets") < c("p"), F.lit(False))).alias("violations"))


@query("win_rank_sources", sql("SELECT w, src_ip, n, rank() OVER (PARTITION BY w ORDER BY n DESC) AS rank, row_number() OVER (PARTITION BY w ORDER BY n DESC, src_ip) AS place FROM (SELECT w, src_ip, count(*) AS n FROM packets GROUP BY w, src_ip) s"))
def win_rank_sources(spark, sf):
    rows = K.key_counts(packets(spark, sf), "src_ip", DAY)
    by = Window.partitionBy("w")
    return rows.select("w", c("key").alias("src_ip"), "n", F.rank().over(by.orderBy(F.desc("n"))).alias("rank"), F.row_number().over(by.orderBy(F.desc("n"), "key")).alias("place"))
