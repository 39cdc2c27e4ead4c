"""Distributions of metrics by mergeable quantile sketches.

A sketch is made for each metric and window by a partial aggregate and united over windows, so quantiles of any span
come from what is kept of the windows, without going back to the packets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col

#: Size of a sketch, and the share of the ranks by which its quantiles may be off.
SKETCH_K, RANK_ERROR = 400, 0.02
POINTS = (0.25, 0.5, 0.75, 0.95, 0.99)


def sketches(rows: DataFrame, *by: str, value: str = "value", k: int = SKETCH_K) -> DataFrame:
    """A sketch of a whole-numbered value for each of ``by``; nulls are not counted."""
    return rows.where(c(value).isNotNull()).groupBy(*by).agg(F.kll_sketch_agg_bigint(c(value).cast("long"), F.lit(k)).alias("sketch"))


def united(found: DataFrame, *by: str, k: int = SKETCH_K) -> DataFrame:
    """Sketches of several rows as one for each of ``by``."""
    return found.groupBy(*by).agg(F.kll_merge_agg_bigint("sketch", F.lit(k)).alias("sketch"))


def quantiles(found: DataFrame, *by: str, points: tuple[float, ...] = POINTS) -> DataFrame:
    """by, n, and point and quantile in a row for each point."""
    each = F.array(*[F.struct(F.lit(p).alias("point"), F.kll_sketch_get_quantile_bigint("sketch", F.lit(p)).alias("quantile")) for p in points])
    return found.select(*by, F.kll_sketch_get_n_bigint("sketch").alias("n"), F.explode(each).alias("q")).select(*by, "n", "q.point", "q.quantile")


def within_rank(told: DataFrame, counts: DataFrame, *by: str, error: float = RANK_ERROR) -> DataFrame:
    """by and whether every quantile is within the error: of ``counts`` (by, value, times), no more than point + error
    are below the quantile, and at least point - error are not above it. There are a few quantiles for each of ``by``."""
    ranks = counts.join(F.broadcast(told), [*by]).groupBy(*by, "point", "quantile").agg(F.sum("times").alias("all"), F.sum(F.when(c("value") < c("quantile"), c("times")).otherwise(0)).alias("below"), F.sum(F.when(c("value") <= c("quantile"), c("times")).otherwise(0)).alias("upto"))
    ok = (c("below") <= (c("point") + error) * c("all")) & (c("upto") >= (c("point") - error) * c("all"))
    return ranks.groupBy(*by).agg(F.bool_and(ok).alias("within_bound"))
