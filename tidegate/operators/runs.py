"""Run analysis: phases, detection delay, confusion, efficacy and utilisation from snapshot series, and their text form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.functions import traffic as T

c = F.col


def phase_of(phase_by: str = "attack_percent", start_s: float | None = None) -> Column:
    """baseline or attack, by the share of attack packets, or by the time at which the attack started."""
    if phase_by == "attack_percent":
        return F.when(c("attack_percent") > 0, "attack").otherwise("baseline")
    if phase_by != "start_time" or start_s is None:
        raise ValueError("phase_by is attack_percent, or start_time with a start")
    return F.when(c("interval_s") >= start_s, "attack").otherwise("baseline")


def with_deltas(snapshots: DataFrame) -> DataFrame:
    """Snapshots with packets_d, bytes_d, attack_d of each interval (cumulative counters, clamped at 0) and phase."""
    o = Window.partitionBy("run_id").orderBy("idx")
    delta = lambda x: F.greatest(F.lit(0), c(x) - F.coalesce(F.lag(x).over(o), F.lit(0)))
    return snapshots.withColumns({"packets_d": delta("total_packets"), "bytes_d": delta("total_bytes"), "attack_d": delta("attack_packets"), "phase": phase_of()})


def confusion(snapshots: DataFrame, positive: tuple[str, ...] = ("MEDIUM", "HIGH", "CRITICAL")) -> DataFrame:
    """tn, fp, tp, fn of each run: a snapshot is positive by its alert level and real by its phase."""
    hit = c("alert_level").isin(*positive)
    real = c("attack_percent") > 0
    return snapshots.groupBy("run_id").agg(T.count_where(~hit & ~real).alias("tn"), T.count_where(hit & ~real).alias("fp"), T.count_where(hit & real).alias("tp"), T.count_where(~hit & real).alias("fn"))


def efficacy(counts: DataFrame) -> DataFrame:
    """accuracy, precision, recall and F1 from a confusion; 0 where undefined."""
    rows = counts.withColumns({"accuracy": T.ratio(c("tp") + c("tn"), c("tp") + c("tn") + c("fp") + c("fn")), "precision": T.ratio(c("tp"), c("tp") + c("fp")), "recall": T.ratio(c("tp"), c("tp") + c("fn"))})
    return rows.withColumn("f1", T.ratio(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")))


def classify(totals: DataFrame) -> DataFrame:
    """attack_type and severity of a run from its totals (packets, tcp, udp, icmp, syn, frag, mean_pps); the first that fits."""
    share = lambda a, b: F.when(c(b) > 0, c(a) / c(b)).otherwise(0.0)
    kind = (
        F.when(c("packets") == 0, "No Traffic").when(share("syn", "tcp") > 0.7, "SYN Flood").when(share("udp", "packets") > 0.7, "UDP Flood").when(share("icmp", "packets") > 0.5, "ICMP Flood")
        .when(share("frag", "packets") > 0.3, "Fragmentation").when(share("tcp", "packets") > 0.9, "TCP Flood").when(c("mean_pps") > 10000, "Volumetric").otherwise("Mixed Traffic")
    )
    severity = F.when(c("mean_pps") > 100000, "CRITICAL").when(c("mean_pps") > 10000, "HIGH").when(c("mean_pps") > 1000, "MEDIUM").otherwise("LOW")
    return totals.withColumns({"attack_type": kind, "severity": severity})


def equal_bins(rows: DataFrame, value: str, n: int) -> DataFrame:
    """bin (1 to n) and count of a value over n bins of equal width between its least and greatest; one row of bounds is broadcast."""
    bounds = F.broadcast(rows.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi")))
    place = F.when(c("hi") > c("lo"), F.least(F.lit(n), F.floor((c(value) - c("lo")) / (c("hi") - c("lo")) * n) + 1)).otherwise(1)
    return rows.crossJoin(bounds).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def reason_category(reason: Column) -> Column:
    out = F.lit("other")
    for word in ("udp", "syn", "small"):
        out = F.when(F.contains(F.lower(reason), F.lit(word)), word).otherwise(out)
    return out
