"""Joins of packets and windows with small tables, intervals and earlier events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.functions import traffic as T

c = F.col

#: Rows of a table of ranges or limits up to which it is broadcast; a larger one is refused by ``small``.
MOST_SMALL = 100_000


def small(df: DataFrame, most: int = MOST_SMALL) -> DataFrame:
    """A broadcast hint for a table that is counted to be small; else the table as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def networks(spark: SparkSession, rows=T.NETWORKS) -> DataFrame:
    return spark.createDataFrame(list(rows), "net_class string, lo long, hi long")


def join_networks(packets: DataFrame, ranges: DataFrame, key: str = "src_ip", prefix_bits: int = 24) -> DataFrame:
    """Packets with the class of the range that holds their address, other without one.

    Ranges are cut into blocks of 2^(32 - prefix_bits) addresses and joined by block, an equi-join; so a table of
    many ranges needs no nested loop.
    """
    size = 1 << (32 - prefix_bits)
    blocks = ranges.select("net_class", "lo", "hi", F.explode(F.sequence(F.floor(c("lo") / size), F.floor(c("hi") / size))).alias("block"))
    inside = (F.floor(c(key) / size) == c("block")) & c(key).between(c("lo"), c("hi"))
    return packets.join(small(blocks), inside, "left").withColumn("net_class", F.coalesce("net_class", F.lit("other"))).drop("lo", "hi", "block")


def limits_table(spark: SparkSession, limits: dict[tuple[str, str], int]) -> DataFrame:
    return spark.createDataFrame([(n, m, v) for (n, m), v in limits.items()], "net_class string, metric string, limit_n long")


def asof_before(events: DataFrame, marks: DataFrame, key: str, ts: str = "ts", bucket: str = "day") -> DataFrame:
    """Each event with the last mark of its key at or before it (mark_ts), null without one.

    Both sides are united and a running ``last`` picks the mark, so no pairs are made. A key is split by time buckets
    (a unit of date_trunc), so that a hot key is dealt to many tasks; a bucket without an earlier mark takes the last
    one of the buckets before, from a table of one row for each key and bucket.
    """
    from pyspark.sql import Window

    kind = dict(marks.select(ts).dtypes)[ts]
    old = events.withColumns({"mark_": F.lit(None).cast(kind), "event_": F.lit(1)})
    both = old.unionByName(marks.select(key, ts, c(ts).alias("mark_"), F.lit(0).alias("event_")), allowMissingColumns=True).withColumn("bucket_", F.date_trunc(bucket, ts))
    inside = Window.partitionBy(key, "bucket_").orderBy(ts, "event_").rowsBetween(Window.unboundedPreceding, 0)
    ends = both.groupBy(key, "bucket_").agg(F.max("mark_").alias("end_"))
    earlier = Window.partitionBy(key).orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(key, "bucket_", F.max("end_").over(earlier).alias("end_"))
    seen = both.withColumn("near_", F.last("mark_", ignorenulls=True).over(inside)).join(before, [key, "bucket_"])
    return seen.where("event_ = 1").withColumn("mark_ts", F.coalesce("near_", "end_")).drop("mark_", "event_", "bucket_", "near_", "end_")


#: A key with more rows than this, and than 1 in MOST_HOT of all, is joined apart; there are at most MOST_HOT of them.
HOT_ROWS, MOST_HOT = 10_000, 10_000


def join_state(rows: DataFrame, state: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` with the row of ``state`` for their key; ``count`` is the state's number of rows with the key.

    Keys with very many rows would fill one task. They are few, which bounds their table, so it is broadcast.
    """
    total = state.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    bound = max(HOT_ROWS, total // MOST_HOT)
    hot = state.where(F.col(count) > bound)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(state.where(F.col(count) <= bound), key)
    return cold.unionByName(rows.join(F.broadcast(hot), key).select(*cold.columns))
