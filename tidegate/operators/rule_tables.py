"""Rules as rows: limits are a table that is joined with the metrics of windows, so rule sets can be changed and compared as data.

A condition is a row (limits, rule, severity, signal, mode, weight, metric, relation, value). The conditions of a
signal hold together (mode all) or one of them does (any); a rule fires if all its signals hold, and its score is the
weight of those that do. Metrics are unpivoted and meet the conditions by name; the table of conditions is small and
fixed, so it is broadcast, and what is counted is a row for each window and condition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.functions import traffic as T
from tidegate.operators import counters as K

c = F.col

CONDITION = "limits string, rule string, severity string, signal string, mode string, weight int, metric string, relation string, value double"
Conditions = tuple[tuple, ...]


def conjunction(limits: str, rule: str, severity: str, *conditions: tuple[str, str, float]) -> Conditions:
    """A rule whose conditions (metric, relation, value) must all hold."""
    return tuple((limits, rule, severity, f"{m} {r}", "all", 1, m, r, float(v)) for m, r, v in conditions)


def scored(limits: str, rule: str, *signals: tuple[str, int, tuple[tuple[str, str, float], ...]]) -> Conditions:
    """A score of signals (name, weight, conditions of which one must hold)."""
    return tuple((limits, rule, "NONE", s, "any", n, m, r, float(v)) for s, n, conditions in signals for m, r, v in conditions)


def metric_rows(packets: DataFrame, width: str = "1 second", seconds: float = 1.0) -> DataFrame:
    """The feature row of each window, and what rules need besides: psh_ratio (of TCP), web_share (to ports 80 and 443)
    and reflector_share (UDP from ports 53 and 123), both of all packets."""
    web = F.coalesce(c("dst_port").isin(80, 443), F.lit(False))
    reflected = (c("proto") == T.UDP) & F.coalesce(c("src_port").isin(53, 123), F.lit(False))
    more = packets.groupBy(K.window_start(width).alias("w")).agg(F.count("*").alias("n"), T.count_where(c("proto") == T.TCP).alias("tcp"), T.count_where(T.has_flag(c("tcp_flags"), T.PSH)).alias("psh"), T.count_where(web).alias("web"), T.count_where(reflected).alias("reflected")).transform(K.named)
    more = more.select("w", T.ratio(c("psh"), c("tcp")).alias("psh_ratio"), T.ratio(c("web"), c("n")).alias("web_share"), T.ratio(c("reflected"), c("n")).alias("reflector_share"))
    return K.feature_rows(packets, width, seconds).join(more, "w")


def conditions_of(spark: SparkSession, rules: Conditions) -> DataFrame:
    """The table of conditions; one that stands twice counts once."""
    return spark.createDataFrame(list(dict.fromkeys(rules)), CONDITION)


def held_conditions(metrics: DataFrame, conditions: DataFrame, keep: str = "w") -> DataFrame:
    """Each window with each condition and whether it holds; a metric that a window lacks holds nothing."""
    names = [x for x in metrics.columns if x != keep]
    long = metrics.select(keep, *[c(x).cast("double").alias(x) for x in names]).unpivot([keep], names, "metric", "found")
    told = long.join(F.broadcast(conditions), "metric")
    relation = F.when(c("relation") == ">", c("found") > c("value")).when(c("relation") == ">=", c("found") >= c("value")).when(c("relation") == "<", c("found") < c("value")).when(c("relation") == "<=", c("found") <= c("value"))
    return told.withColumn("holds", F.coalesce(relation, F.lit(False)))


def evaluate(metrics: DataFrame, conditions: DataFrame, keep: str = "w") -> DataFrame:
    """A row for each window, limits and rule: severity, fired, score, signals (those that hold, in order of name)."""
    by = [keep, "limits", "rule", "severity"]
    signals = held_conditions(metrics, conditions, keep).groupBy(*by, "signal", "mode", "weight").agg(F.bool_and("holds").alias("every"), F.bool_or("holds").alias("some"))
    signals = signals.withColumn("holds", F.when(c("mode") == "any", c("some")).otherwise(c("every")))
    # A rule has a handful of signals.
    return signals.groupBy(*by).agg(F.bool_and("holds").alias("fired"), F.sum(F.when(c("holds"), c("weight")).otherwise(0)).alias("score"), F.sort_array(F.collect_list(F.when(c("holds"), c("signal")))).alias("signals"))
