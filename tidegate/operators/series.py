"""Window functions over series: one row for each interval of a run, or packets of one source.

Series windows are always partitioned by run, sensor or source, and run on aggregated rows wherever the operator
allows it, so that no task holds the packets of a whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def ordered(keys: tuple[str, ...] = ("run_id",), order: str = "idx"):
    return Window.partitionBy(*keys).orderBy(order)


def counter_deltas(rows: DataFrame, counters: tuple[str, ...], keys=("run_id",), order="idx", seconds: float | None = None) -> DataFrame:
    """Per-interval differences of cumulative counters, the first from 0 and none below 0; rates if ``seconds`` is given."""
    w = ordered(keys, order)
    delta = lambda x: F.greatest(F.lit(0), c(x) - F.coalesce(F.lag(x).over(w), F.lit(0)))
    out = rows.withColumns({f"{x}_delta": delta(x) for x in counters})
    return out.withColumns({f"{x}_rate": F.round(c(f"{x}_delta") / seconds, 6) for x in counters}) if seconds else out


def sliding_stats(rows: DataFrame, columns: dict[str, tuple[str, ...]], keys, order: str, length: int = 10) -> DataFrame:
    """Trailing statistics (mean, std of the sample, max) over ``length`` rows; only full windows."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(length - 1), 0)
    found = {"mean": F.avg, "std": F.stddev_samp, "max": F.max}
    stats = {f"{x}_{s}": F.round(found[s](x).over(w), 6) for x, names in columns.items() for s in names}
    return rows.withColumns({**stats, "rows_seen": F.count("*").over(w)}).where(c("rows_seen") == length).drop("rows_seen")


def split_lag(rows: DataFrame, key: str, order: tuple[str, ...], value: str, bucket: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the value of the row before it in its key's order, null for the first.

    A key is split by time buckets, so that a key with a great share of the rows is dealt to many tasks. The first row
    of a bucket takes the last value of the bucket before, from a table of one row for each key and bucket. ``bucket``
    must grow with the first column of ``order``.
    """
    cut = rows.withColumn("bucket_", bucket)
    inside = Window.partitionBy(key, "bucket_").orderBy(*order)
    ends = cut.groupBy(key, "bucket_").agg(F.max_by(value, F.struct(*order)).alias("end_"))
    before = ends.select(key, "bucket_", F.lag("end_").over(Window.partitionBy(key).orderBy("bucket_")).alias("end_"))
    seen = cut.withColumns({"lag_": F.lag(value).over(inside), "place_": F.row_number().over(inside)}).join(before, [key, "bucket_"])
    return seen.withColumn(name, F.when(c("place_") == 1, c("end_")).otherwise(c("lag_"))).drop("bucket_", "end_", "lag_", "place_")


def rescale_time(packets: DataFrame, factor: float) -> DataFrame:
    """Packets with ``us``: their time in microseconds, moved towards the first packet by a factor."""
    first = packets.agg(F.min("ts").alias("first_ts"))
    micros = lambda x: F.unix_micros(c(x).cast("timestamp"))
    return packets.crossJoin(F.broadcast(first)).withColumn("us", (micros("first_ts") + F.floor((micros("ts") - micros("first_ts")) / F.lit(factor))).cast("long"))


def bins(value: Column, edges: tuple[float, ...], names: tuple[str, ...]) -> Column:
    """The name of the half-open bin [edge, next edge) that holds a value; below the first edge the first name, from the last edge on the last."""
    out = F.lit(names[-1])
    for edge, name in list(zip(edges, names, strict=False))[::-1]:
        out = F.when(value < edge, name).otherwise(out)
    return out
