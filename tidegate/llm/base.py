"""What the operators share: reading tables, bounded batches, values bound once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.sources.packages import ship
from tidegate.sources.storage import discard, materialise, release, scratch, shared_dir
from tidegate.sources.tables import table

__all__ = ["BATCH_ROWS", "discard", "let", "lookup", "materialise", "release", "scratch", "shared_dir", "ship", "small_batches", "table"]

#: Rows in an Arrow batch sent to Python. Small, so that a batch of very long texts still fits a worker.
BATCH_ROWS = 256


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows of an Arrow batch for the Python stages of this session, and send them the package."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` and lambdas within it use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: A key with more rows than this, and than 1 in MOST_HOT of all rows, is joined apart; there are at most MOST_HOT of them.
HOT_ROWS, MOST_HOT = 1000, 10_000


def lookup(rows: DataFrame, found: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined ("inner" or "left") with ``found``, which has one row for each key and in ``n`` the number of rows with it (about ``total`` in all).

    Keys with very many rows would fill one task: they are few, which bounds their table, and it is broadcast.
    """
    bound = max(HOT_ROWS, total // MOST_HOT)
    hot = found.where(F.col("n") > bound)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(found.where(F.col("n") <= bound), key, how)
    return cold.unionByName(rows.join(F.broadcast(hot), key).select(*cold.columns))
