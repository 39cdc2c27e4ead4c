"""Prefix scans, row numbers and trailing windows over a series in blocks, so that no task holds the whole series.

A series is cut into blocks of its order (time). Within a block a window function runs; the totals of blocks, one row
each, are scanned in the same way in blocks of blocks, and what stands before a block is added to its rows. Trailing
windows take the last rows of the block before as a halo. Every window function is partitioned by block; the topmost
scan is over one row for each SUPER * SUPER of the least blocks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col

#: Blocks in a block of blocks, and rows of a block by number.
SUPER, BLOCK_ROWS = 1024, 10_000


@dataclass(frozen=True)
class Scan:
    """value: of a row; agg: its aggregate; join: of what stands before and within. A null counts as nothing."""

    value: Column
    agg: Callable[[Column], Column] = F.sum
    join: Callable[[Column, Column], Column] = lambda a, b: a + b


def union_of_sketches(value: Column) -> Scan:
    return Scan(value, F.hll_union_agg, F.hll_union)


def _joined(scan: Scan, before: Column, own: Column) -> Column:
    return F.when(before.isNull(), own).when(own.isNull(), before).otherwise(scan.join(before, own))


def _before(totals: DataFrame, scans: dict[str, Scan], keys: tuple[str, ...], depth: int) -> DataFrame:
    """keys, block_ and for each scan what stands before the block (null before the first)."""
    held = {k: Scan(c(k), s.agg, s.join) for k, s in scans.items()}

    def earlier(rows: DataFrame, *by: str) -> DataFrame:
        """with_ each scan: over the rows before, by the last of the sums up to them."""
        order = Window.partitionBy(*keys, *by).orderBy("block_")
        upto = rows.withColumns({f"upto_{k}": s.agg(c(k)).over(order.rowsBetween(Window.unboundedPreceding, 0)) for k, s in held.items()})
        return upto.withColumns({f"with_{k}": F.lag(f"upto_{k}").over(order) for k in held})

    if not depth:
        return earlier(totals).select(*keys, "block_", *[c(f"with_{k}").alias(k) for k in held])
    cut = totals.withColumn("super_", F.floor(c("block_") / SUPER))
    up = _before(cut.groupBy(*keys, c("super_").alias("block_")).agg(*[s.agg(c(k)).alias(k) for k, s in held.items()]), held, keys, depth - 1)
    up = up.select(*keys, c("block_").alias("super_"), *[c(k).alias(f"up_{k}") for k in held])
    return earlier(cut, "super_").join(up, [*keys, "super_"]).select(*keys, "block_", *[_joined(s, c(f"up_{k}"), c(f"with_{k}")).alias(k) for k, s in held.items()])


def running(rows: DataFrame, order: str, block: Column, scans: dict[str, Scan], keys: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with each scan over the rows of the key up to and with this one. ``block``: a whole number that grows with ``order``."""
    cut = rows.withColumns({"block_": block.cast("long"), **{f"own_{k}": s.value for k, s in scans.items()}})
    totals = cut.groupBy(*keys, "block_").agg(*[s.agg(c(f"own_{k}")).alias(k) for k, s in scans.items()])
    before = _before(totals, scans, keys, 2).select(*keys, "block_", *[c(k).alias(f"before_{k}") for k in scans])
    upto = Window.partitionBy(*keys, "block_").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    done = cut.join(before, [*keys, "block_"]).withColumns({k: _joined(s, c(f"before_{k}"), s.agg(c(f"own_{k}")).over(upto)) for k, s in scans.items()})
    return done.drop("block_", *[f"{x}_{k}" for k in scans for x in ("own", "before")])


def numbered(rows: DataFrame, order: str, block: Column, name: str = "place", keys: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with their number in the key's order, from 0. ``order`` tells the rows of a key apart."""
    return running(rows, order, block, {name: Scan(F.lit(1).cast("long"))}, keys).withColumn(name, c(name) - 1)


def with_halo(rows: DataFrame, length: int, place: str = "place", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows dealt to block_ by their number, the last ``length`` of each block copied to the next one; own_ marks those of the block itself."""
    if not 0 <= length <= block_rows:
        raise ValueError("a halo is no longer than a block")
    at = F.floor(c(place) / block_rows)
    near_end = c(place) % block_rows >= block_rows - length
    to = F.when(near_end, F.array(at, at + 1)).otherwise(F.array(at))
    return rows.withColumn("block_", F.explode(to)).withColumn("own_", F.floor(c(place) / block_rows) == c("block_"))


def trailing(rows: DataFrame, columns: dict[str, Callable[[object], Column]], length: int, place: str = "place", keys: tuple[str, ...] = (), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` with each of ``columns``, made from the window of the ``length`` rows that end with this one. Rows are numbered."""
    window = Window.partitionBy(*keys, "block_").orderBy(place).rowsBetween(-(length - 1), 0)
    return with_halo(rows, length - 1, place, block_rows).withColumns({k: v(window) for k, v in columns.items()}).where("own_").drop("block_", "own_")


def lagged(rows: DataFrame, value: str, name: str, place: str = "place", keys: tuple[str, ...] = (), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` with the value of the row before, null in the first. Rows are numbered."""
    order = Window.partitionBy(*keys, "block_").orderBy(place)
    return with_halo(rows, 1, place, block_rows).withColumn(name, F.lag(value).over(order)).where("own_").drop("block_", "own_")
