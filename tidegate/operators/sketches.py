"""Sketches as relations: count-min, HyperLogLog and Bloom tables that merge by union and aggregate.

Cells are rows, so a sketch of a window is built by a partial aggregate, merged by a sum (or maximum) and kept in any
table. Hashes are plain arithmetic on 31-bit values, the same in every engine. Spark's own sketch aggregates stand
beside them where the relation is not needed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col

#: A prime above 2^31, and the factors and shifts of the rows of a sketch.
PRIME = 2147483659
FACTORS = (1103515245, 69069, 1664525, 22695477, 214013, 16807, 48271, 40692)


def row_hash(key: Column, row: int, salt: int = 12345) -> Column:
    """A number below PRIME for a key (a long) and a row; the key is folded first, so that products stay in a long."""
    return (F.pmod(key.cast("long"), F.lit(PRIME)) * FACTORS[row] % PRIME + salt * (row + 1)) % PRIME


def hash_sql(key: str, row: int, salt: int = 12345) -> str:
    return f"((({key} % {PRIME}) * {FACTORS[row]} % {PRIME} + {salt * (row + 1)}) % {PRIME})"


def fifth_power(x: Column) -> Column:
    """x^5 modulo PRIME: a permutation that is not linear, so that evenly spaced keys are not spread evenly."""
    square = x * x % PRIME
    return square * square % PRIME * x % PRIME


def fifth_power_sql(x: str) -> str:
    return f"(((({x} * {x}) % {PRIME}) * (({x} * {x}) % {PRIME})) % {PRIME} * {x} % {PRIME})"


def cms_build(rows: DataFrame, key: str, depth: int = 4, width: int = 2048, weight: Column | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Cells (row, bucket, cnt) of a count-min sketch, for each of ``keys`` if given. A null key is not counted.

    Rows are spread to their cells and summed up in each task, so what is shuffled is at most a row for each cell and task, however many keys there are.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("row"), (row_hash(c(key), i) % width).alias("bucket")) for i in range(depth)])
    counted = rows.where(c(key).isNotNull()).select(*keys, (weight if weight is not None else F.lit(1)).cast("long").alias("n"), F.explode(cells).alias("cell"))
    return counted.groupBy(*keys, c("cell.row").alias("row"), c("cell.bucket").alias("bucket")).agg(F.sum("n").alias("cnt"))


def cms_query(sketch: DataFrame, wanted: DataFrame, key: str, depth: int = 4, width: int = 2048) -> DataFrame:
    """The estimate of each wanted key: the least of its cells."""
    cells = F.array(*[F.struct(F.lit(i).alias("row"), (row_hash(c(key), i) % width).alias("bucket")) for i in range(depth)])
    spread = wanted.select(key, F.explode(cells).alias("cell")).select(key, "cell.row", "cell.bucket")
    return spread.join(sketch, ["row", "bucket"], "left").groupBy(key).agg(F.min(F.coalesce("cnt", F.lit(0))).alias("estimate"))


def cms_merge(*sketches: DataFrame) -> DataFrame:
    """The sketch of the union of the inputs: cell by cell sums."""
    out = sketches[0]
    for s in sketches[1:]:
        out = out.unionByName(s)
    return out.groupBy("row", "bucket").agg(F.sum("cnt").alias("cnt"))


def hll_registers(rows: DataFrame, key: str, bits: int = 10, keys: tuple[str, ...] = ()) -> DataFrame:
    """Registers (idx, rho): the most leading zeros plus one among hashes of 31 - bits remaining bits."""
    h = row_hash(fifth_power(row_hash(c(key), 0)), 4) % (1 << 31)
    rest = 31 - bits
    low = h.bitwiseAND((1 << rest) - 1)
    rho = F.when(low == 0, rest + 1).otherwise(rest - F.length(F.bin(low)) + 1)
    return rows.where(c(key).isNotNull()).select(*keys, F.shiftright(h, rest).alias("idx"), rho.cast("int").alias("rho")).groupBy(*keys, "idx").agg(F.max("rho").alias("rho"))


def hll_estimate(registers: DataFrame, bits: int = 10, keys: tuple[str, ...] = ()) -> DataFrame:
    """The number of distinct keys from the registers; linear counting while many are empty."""
    m = 1 << bits
    alpha = 0.7213 / (1 + 1.079 / m)
    sums = registers.groupBy(*keys).agg(F.sum(F.pow(F.lit(2.0), -c("rho"))).alias("s"), F.count("*").alias("filled"))
    raw = alpha * m * m / (c("s") + (m - c("filled")))
    empty = m - c("filled")
    return sums.select(*keys, F.round(F.when((raw <= 2.5 * m) & (empty > 0), m * F.log(m / empty)).otherwise(raw), 4).alias("estimate"))


def bloom_build(rows: DataFrame, key: str, hashes: int = 7, bits: int = 1_000_000) -> DataFrame:
    """The set bits of a Bloom filter over the keys."""
    return rows.where(c(key).isNotNull()).select(key).distinct().select(F.explode(F.array(*[row_hash(c(key), i) % bits for i in range(hashes)])).alias("bit")).distinct()


def bloom_member(wanted: DataFrame, bloom: DataFrame, key: str, hashes: int = 7, bits: int = 1_000_000) -> DataFrame:
    """Whether each wanted key may be in the set; never false for a member."""
    spread = wanted.select(key).distinct().select(key, F.explode(F.array_distinct(F.array(*[row_hash(c(key), i) % bits for i in range(hashes)]))).alias("bit"))
    return spread.join(bloom.withColumn("hit", F.lit(1)), "bit", "left").groupBy(key).agg(F.min(F.coalesce("hit", F.lit(0))).alias("low")).select(key, (c("low") == 1).alias("maybe"))


def cms_bound(total: Column, width: int = 2048) -> Column:
    """The error that a count-min estimate exceeds with small chance only."""
    return F.lit(math.e / width) * total
