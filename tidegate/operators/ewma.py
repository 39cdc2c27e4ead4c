"""Exponentially weighted mean and deviation of a series, in blocks.

With a mean m, a variance v and a weight a, a value x makes m' = a x + (1-a) m and v' = (1-a)(v + a (x-m)^2). Of the
vector (1, m, m^2, v) that is a linear map with a 4 x 4 matrix, and a block of values is the product of theirs. So
blocks are multiplied out by themselves, the products (one for each block) are chained, in blocks again where there
are many, and each block is replayed from the vector that stands before it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col

#: Values of a block, and products chained by one task.
BLOCK_ROWS = 1000
STATE = "m double, q double, v double"


def value_maps(x: np.ndarray, alpha: float) -> np.ndarray:
    """The matrix of each value."""
    a, b = alpha, 1 - alpha
    out = np.zeros((len(x), 4, 4))
    out[:, 0, 0] = 1
    out[:, 1, 0], out[:, 1, 1] = a * x, b
    out[:, 2, 0], out[:, 2, 1], out[:, 2, 2] = a * a * x * x, 2 * a * b * x, b * b
    out[:, 3, 0], out[:, 3, 1], out[:, 3, 2], out[:, 3, 3] = a * b * x * x, -2 * a * b * x, a * b, b
    return out


def first_map(x: float) -> np.ndarray:
    """A series begins with its first value as mean and no deviation."""
    out = np.zeros((4, 4))
    out[:, 0] = (1, x, x * x, 0)
    return out


def product(maps: np.ndarray) -> np.ndarray:
    """The maps in order as one, by pairs."""
    while len(maps) > 1:
        odd = maps[-1:] if len(maps) % 2 else maps[:0]
        maps = np.concatenate((maps[1::2] @ maps[: len(maps) - len(odd) : 2], odd))
    return maps[0]


def _chain(maps: DataFrame, number: int, size: int) -> DataFrame:
    """block_ and the vector before it, from block_ and map (16 numbers); the blocks are numbered without holes."""

    def replay(part: pd.DataFrame, start: np.ndarray) -> pd.DataFrame:
        part = part.sort_values("block_")
        rows, now = [], start
        for m in np.array(part["map"].tolist()).reshape(-1, 4, 4):
            rows.append(now[1:])
            now = m @ now
        return pd.DataFrame(np.array(rows), columns=["m", "q", "v"]).assign(block_=part["block_"].to_numpy())

    schema = f"block_ long, {STATE}"
    order = ["block_", "m", "q", "v"]
    cut = maps.withColumn("super_", F.floor(c("block_") / size))
    if number <= size:
        return cut.groupBy("super_").applyInPandas(lambda part: replay(part, np.array([1.0, 0, 0, 0]))[order], schema)  # one, of ``size`` rows at most

    def multiply(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("block_")
        return pd.DataFrame({"block_": [part["super_"].iloc[0]], "map": [product(np.array(part["map"].tolist()).reshape(-1, 4, 4)).ravel()]})

    above = _chain(cut.groupBy("super_").applyInPandas(multiply, "block_ long, map array<double>"), -(-number // size), size).withColumnRenamed("block_", "super_")
    held = cut.join(above, "super_")
    return held.groupBy("super_").applyInPandas(lambda part: replay(part, np.array([1.0, *part[["m", "q", "v"]].iloc[0]]))[order], schema)


def ewma(rows: DataFrame, value: str, place: str = "place", alpha: float = 0.1, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """place, mean and deviation (with the value) and z: the distance of the value from the mean before it, in deviations
    before it (0 where there was none). Rows are numbered from 0 without holes. An empty series gives none."""
    cut = rows.select(c(place).cast("long").alias("place"), c(value).cast("double").alias("x"), F.floor(c(place) / block_rows).alias("block_"))

    def multiply(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place")
        maps = value_maps(part["x"].to_numpy(), alpha)
        if part["place"].iloc[0] == 0:
            maps[0] = first_map(part["x"].iloc[0])
        return pd.DataFrame({"block_": [part["block_"].iloc[0]], "map": [product(maps).ravel()]})

    maps = cut.groupBy("block_").applyInPandas(multiply, "block_ long, map array<double>")
    before = _chain(maps, -(-rows.count() // block_rows), max(2, block_rows))

    def replay(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place")
        m, v = part["m"].iloc[0], max(0.0, part["v"].iloc[0])
        out = []
        for at, x in zip(part["place"], part["x"], strict=True):
            if at == 0:
                z, m, v = 0.0, x, 0.0
            else:
                z = (x - m) / np.sqrt(v) if v > 0 else 0.0
                m, v = alpha * x + (1 - alpha) * m, (1 - alpha) * (v + alpha * (x - m) ** 2)
            out.append((at, m, np.sqrt(v), z))
        return pd.DataFrame(out, columns=["place", "mean", "deviation", "z"])

    return cut.join(before, "block_").groupBy("block_").applyInPandas(replay, "place long, mean double, deviation double, z double")
