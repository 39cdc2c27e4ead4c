"""Keys that are missing or repeat: samples stay bounded and are never empty, no item and no row is lost."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import DOC
from tidegate.llm import decontaminate, digests, language, quality

SF = "/root/testdata/sf0.001"
TEXTS = {"en": "the house and the garden are over there with some water", "de": "das haus und der garten sind nicht weit vom wasser weg", "fr": "la maison et le jardin ne sont pas loin de la riviere"}


def corpus(spark, n, key):
    """n rows of three languages; their key is an expression."""
    rows = spark.createDataFrame(list(enumerate(TEXTS.items())), "i int, pair struct<lang: string, text: string>")
    return spark.range(n).join(F.broadcast(rows), F.col("id") % 3 == F.col("i")).select(F.expr(key).cast("long").alias("doc_id"), F.concat("pair.text", F.lit(" "), F.col("id").cast("string")).alias("text"), "pair.lang", F.lit("a").alias("source"), F.lit(0).cast("long").alias("n_chars"), F.lit("x").alias("key"), F.lit("x").alias("score"))


@pytest.mark.parametrize("key", ["NULL", "17", "id"])
def test_language_sample(spark, key):
    docs = corpus(spark, 20000, key)
    drawn = language.sample(docs, "doc_id", "text", "lang", 300)
    assert all(200 < r["count"] < 450 for r in drawn.groupBy("lang").count().collect()) and drawn.select("lang").distinct().count() == 3
    seen = language.predict(docs, language.fit(docs, per_lang=300), keep=("doc_id", "lang"))
    assert seen.where("lang = lang_pred").count() == 20000


def test_language_sample_of_equal_rows(spark):
    docs = spark.range(9000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("one and the same text").alias("text"), F.lit("en").alias("lang"))
    assert 200 < language.sample(docs, "doc_id", "text", "lang", 300).count() < 450
    assert language.fit(docs, per_lang=300).langs == ["en"]


def test_pipeline_keeps_keyless_documents(spark):
    docs = corpus(spark, 20000, "NULL").select("doc_id", "text", "lang", "source", "n_chars")
    assert corpus_pipeline.identify_language(spark, docs, SF).count() == 20000


def test_language_against_plain_version(spark, docs, texts):
    """n-grams, bit weights and decoding in plain Python."""

    def grams(text):
        raw = bytes(language.LETTER[b] for b in text.lower().encode())
        raw = b" " + raw + b" "
        for n in language.ORDERS:
            for i in range(len(raw) - n + 1):
                x = 0
                for b in raw[i : i + n]:
                    x = ((x << 8) | b) & 0xFFFFFFFF
                x = ((x ^ (x >> 15)) * (0x85EBCA6B + 2 * n)) & 0xFFFFFFFF
                x = ((x ^ (x >> 13)) * 0xC2B2AE35) & 0xFFFFFFFF
                yield x >> (32 - language.HASH_BITS)

    rows = [(t[:300], g) for t, g in zip([t for t in texts.values() if len(t) > 50][:24], ["en", "de", "fr", "xx"] * 6)]
    df = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(rows)], "doc_id long, text string, lang string")
    model = language.fit(df)
    langs = sorted({g for _, g in rows})
    counts = {g: np.zeros(1 << language.HASH_BITS) for g in langs}
    for t, g in rows:
        for b in grams(t):
            counts[g][b] += 1
    rate = {g: (c + 0.5) / (c.sum() + 0.5 * len(c)) for g, c in counts.items()}
    code = language.code_matrix(len(langs))
    assert model.langs == langs and (model.code == code).all()
    for j in range(code.shape[1]):
        plus, minus = ([rate[g] for g, x in zip(langs, code[:, j]) if x == s] for s in (1, -1))
        want = np.clip(np.log(np.mean(plus, 0)) - np.log(np.mean(minus, 0)), -8, 8)
        assert np.allclose(model.weights[:, j], want, atol=1e-5)
    for t, _ in rows[:8]:
        found = [*grams(t)]
        m = model.weights[found].sum(0) / np.sqrt(len(found) + 10)
        assert np.allclose(model.margins(pa.array([t]))[0], m, atol=1e-4)
        loss = [sum(w * np.logaddexp(0, -z * c) for w, z, c in zip(model.trust, np.clip(m * model.scale + model.bias, -30, 30), row)) for row in code]
        p = np.exp(-np.array(loss))
        assert np.allclose(model.decode(m[None, :])[0], p / p.sum(), atol=1e-6)


def test_items_without_and_with_repeated_keys(spark):
    base = ["the quick brown fox jumps over the lazy dog near the old stone bridge", "seven small ships sailed slowly across the calm northern sea last winter", "every morning she walks along the river bank before going to work", "engineers measured how much water flows through the narrow pipe system"]
    items = spark.createDataFrame([(None, base[0]), (7, base[1]), (7, base[2]), (8, base[3]), (8, base[3]), (9, ""), (10, None)], "item_id long, text string").withColumn("item", F.lit("x"))
    docs = spark.createDataFrame([(i, "well then " + t + " and so on") for i, t in enumerate(base)] + [(50, "nothing of the kind stands in this text at all")], "doc_id long, text string").withColumn("mark", F.lit("x"))
    got = sorted(((r["doc_id"], r["item_id"], r["kind"]) for r in decontaminate.find_leaks(docs, items).collect()), key=str)
    assert got == [(0, None, "exact"), (1, 7, "exact"), (2, 7, "exact"), (3, 8, "exact")]
    assert [r["doc_id"] for r in decontaminate.without_leaks(docs, items).collect()] == [50]
    assert decontaminate.find_leaks(docs, items.limit(0)).count() == 0 and decontaminate.find_leaks(docs.limit(0), items).count() == 0


def test_equal_rows_are_not_one_run(spark):
    n = 3 * digests.RUN_ROWS
    docs = spark.range(n + 3).select(F.when(F.col("id") < n, F.lit(5)).otherwise(F.col("id") - n + 4).cast("long").alias("doc_id"), F.when(F.col("id") < n, F.lit("the very same text")).otherwise(F.concat(F.lit("another text "), F.col("id").cast("string"))).alias("text"))
    got = digests.edited_digests(docs).collect()
    assert len(got) == n + 3
    text = "the very same text"
    own = digests.digest(text.encode()).hex()
    repeated = [r for r in got if r["doc_id"] == 5 and r["fingerprint"] == own]
    assert len(repeated) == n and sum(r["near_next"] == 1 for r in repeated) == n - 1
    edited = hashlib.sha256((text[: len(text) - len(text) // 2] + text[: len(text) // 2]).encode()).hexdigest()
    assert sum(r["edited_sha256"] == edited for r in repeated) == n - 1
    # The others, and the one of them that stands among neighbours, as in a plain walk.
    order = sorted({(r["doc_id"], r["text"]) for r in docs.collect()}, key=lambda x: (-x[0], x[1]))
    assert len(order) == 4 and len({(r["doc_id"], r["fingerprint"]) for r in got}) == 4


def test_quality_sample_of_repeated_keys(spark):
    """One labelled key with many rows: the sample stays bounded; null keys are scored and not held out."""
    docs = spark.range(40000).select(F.lit(3).cast("long").alias("doc_id"), F.concat(F.lit("some line of text "), (F.col("id") % 50).cast("string")).alias("text")).withColumns({"y": F.lit("x"), "lines": F.lit("x")})
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    field = quality.fit(docs, labels, most=500)
    assert field is not None
    some = spark.createDataFrame([(None, "a text without a key", "x"), (3, "another", "x"), (3, "another", "x")], "doc_id long, text string, score string")
    rows = quality.score_quality(some, field).select(quality.held_out().alias("h"), "score").collect()
    assert len(rows) == 3 and all(r["h"] is not None and 0 <= r["score"] <= 1 for r in rows)
    assert language.predict(spark.createDataFrame([(None, "words", None, None, None)], DOC), None).select(language.held_out().alias("h")).first()["h"] is False
