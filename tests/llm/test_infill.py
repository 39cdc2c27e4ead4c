"""Fill-in-middle against a plain version, and back."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import EDGE
from tidegate.llm import infill


def plainly(key, text, percent=(10, 20), seed=1):
    text, n = text or "", len(text or "")
    d = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100 - percent[0]:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < percent[1] else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def check(rows, df):
    got = infill.fill_in_middle(df).withColumn("again", infill.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((str(r["doc_id"]), r["n"], r["form"], r["prefix_units"], r["middle_units"], r["output"]) for r in got) == sorted((str(k), *plainly(k, t)) for k, t in rows)
    assert all(r["again"] == r["text"] for r in got)


def test_edges(spark, edge, none):
    check([(r[0], r[1]) for r in EDGE], edge)
    assert infill.fill_in_middle(none).count() == 0


def test_any_text(spark):
    """Characters of several code units, line ends, replacement signs, pieces of sentinels, sentinels, one very long text."""
    rng, signs = random.Random(2), ["a", "\n", "\r\n", "😀", "é", "$1", "\\", "<", "P>", "<P", "S>", " ", "\x00", "ß", "}", "\\E"]
    rows = [(i, "".join(rng.choice(signs) for _ in range(rng.randint(0, 900)))) for i in range(400)]
    rows += [(1000 + i, f"before {s} after") for i, s in enumerate(infill.SENTINELS)] + [(2000 + i, "<" * i + "S") for i in range(20)]
    rows += [(3000, "😀a" * 1_000_000), (3001, "x" * 255), (3002, "x" * 256), (3003, "x" * 257), (3003, "x" * 257), (None, "no key")]
    check(rows, spark.createDataFrame(rows, "doc_id long, text string"))


def test_units_and_sentinels(spark):
    """Lines as units: cuts fall between lines; other shares, other sentinels."""
    rng = random.Random(3)
    rows = [(i, "".join(f"line {j} of {i}\n" for j in range(rng.randint(1, 700)))) for i in range(60)]
    marks = ("[pre$]", "{suf}", "(mid\\)")
    got = infill.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), unit="[^\\n]*\\n", sentinels=marks, plain_percent=0, spm_percent=50)
    forms = set()
    for r in got.withColumn("again", infill.restored(F.col("output"), F.col("form"), marks)).collect():
        lines = r["text"].splitlines(keepends=True)
        a, b = r["prefix_units"], r["prefix_units"] + r["middle_units"]
        p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
        assert r["n"] == len(lines) and r["again"] == r["text"]
        assert r["output"] == (f"{marks[0]}{p}{marks[1]}{s}{marks[2]}{m}" if r["form"] == "psm" else f"{marks[1]}{s}{marks[0]}{p}{marks[2]}{m}")
        forms.add(r["form"])
    assert forms == {"psm", "spm"}
    for wrong in (("<P>", "<P>", "<M>"), ("<P>", "<P>>", "<M>"), ("ab", "cab", "d"), ("", "b", "c")):
        with pytest.raises(ValueError):
            infill.fill_in_middle(got, sentinels=wrong)
