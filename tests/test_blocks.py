"""Scans in blocks against plain loops: edges of blocks, empty blocks, keys, blocks of blocks; the weighted mean."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegate.operators import blocks as B
from tidegate.operators import ewma as E

c = F.col


def series(n, keys=("a",), seed=1):
    rng = random.Random(seed)
    return [(k, t, rng.randint(0, 50)) for k in keys for t in sorted(rng.sample(range(20 * n), n))]


@pytest.mark.parametrize(("width", "superblock"), [(7, 1024), (7, 3), (100000, 1024)])
def test_running(spark, monkeypatch, width, superblock):
    monkeypatch.setattr(B, "SUPER", superblock)
    rows = series(300, ("a", "b"))
    df = spark.createDataFrame(rows, "k string, t long, v long")
    got = {(r["k"], r["t"]): (r["total"], r["place"]) for r in B.numbered(B.running(df, "t", F.floor(c("t") / width), {"total": B.Scan(c("v"))}, ("k",)), "t", F.floor(c("t") / width), keys=("k",)).collect()}
    want = {}
    for key in "ab":
        total = 0
        for i, (_, t, v) in enumerate(x for x in rows if x[0] == key):
            total += v
            want[key, t] = (total, i)
    assert got == want
    assert B.running(df.limit(0), "t", c("t"), {"total": B.Scan(c("v"))}).count() == 0


def test_running_distinct(spark):
    rng = random.Random(3)
    rows = [(t, rng.randint(0, 40 + t)) for t in range(60) for _ in range(5)]
    days = spark.createDataFrame(rows, "t long, ip long").groupBy("t").agg(F.hll_sketch_agg("ip", F.lit(14)).alias("s"))
    got = {r["t"]: r["n"] for r in B.running(days, "t", F.floor(c("t") / 7), {"all": B.union_of_sketches(c("s"))}).select("t", F.hll_sketch_estimate("all").alias("n")).collect()}
    assert got == {t: len({ip for u, ip in rows if u <= t}) for t in range(60)}


@pytest.mark.parametrize("block_rows", [9, 10, 13, 10000])
def test_trailing_windows_cross_blocks(spark, block_rows):
    rows = series(95)
    df = B.numbered(spark.createDataFrame(rows, "k string, t long, v long"), "t", F.floor(c("t") / 50))
    got = B.trailing(df, {"m": lambda w: F.avg("v").over(w), "s": lambda w: F.stddev_samp("v").over(w), "n": lambda w: F.count("*").over(w)}, 10, block_rows=block_rows)
    got = {r["t"]: (r["n"], round(r["m"], 9), None if r["s"] is None else round(r["s"], 9)) for r in B.lagged(got, "v", "last", block_rows=block_rows).collect()}
    values = [v for _, _, v in rows]
    for i, (_, t, _) in enumerate(rows):
        part = values[max(0, i - 9) : i + 1]
        assert got[t] == (len(part), round(statistics.fmean(part), 9), round(statistics.stdev(part), 9) if len(part) > 1 else None)
    last = {r["t"]: r["last"] for r in B.lagged(df, "v", "last", block_rows=block_rows).collect()}
    assert [last[t] for _, t, _ in rows] == [None, *values[:-1]]
    with pytest.raises(ValueError):
        B.with_halo(df, 20, block_rows=10)


@pytest.mark.parametrize("block_rows", [1, 2, 7, 1000])
def test_ewma_equals_the_recursion(spark, block_rows):
    rng = np.random.default_rng(5)
    x = np.concatenate((rng.normal(300, 20, 60), [300.0] * 5, rng.normal(1e4, 1, 20)))
    got = {r["place"]: (r["mean"], r["deviation"], r["z"]) for r in E.ewma(spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "place long, v double"), "v", block_rows=block_rows).collect()}
    m, v = x[0], 0.0
    for i, value in enumerate(x):
        z = 0.0
        if i:
            z = (value - m) / np.sqrt(v) if v > 0 else 0.0
            m, v = 0.1 * value + 0.9 * m, 0.9 * (v + 0.1 * (value - m) ** 2)
        assert np.allclose(got[i], (m, np.sqrt(v), z), rtol=1e-6, atol=1e-6)
    # A product of maps is their composition.
    maps = E.value_maps(x[:9], 0.1)
    state = np.array([1, 5.0, 25.0, 2.0])
    step = state
    for one in maps:
        step = one @ step
    assert np.allclose(E.product(maps) @ state, step)
    assert E.ewma(spark.createDataFrame([], "place long, v double"), "v").count() == 0
