"""Token counts against the library, with cold, warm and shared caches."""

import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.test_operators import EDGE
from tidegate.llm import tokencounts as K
from tidegate.llm.base import scratch

MODEL = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def exact():
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    return lambda t: len(model.encode(t or ""))


def told(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in df.collect()), key=str)


def expected(rows, exact):
    return sorted(((k, len((t or "").encode()), exact(t)) for k, t in rows), key=str)


def stored(spark, cache):
    return spark.read.schema(K.CACHE).parquet(cache)


@pytest.mark.parametrize("few", [0, K.MOST_BROADCAST])
def test_whole_table(spark, docs, texts, exact, few):
    cache = scratch(spark, "t")
    assert told(K.count_tokens(docs, MODEL, cache, broadcast_up_to=few)) == expected(texts.items(), exact)
    assert stored(spark, cache).count() == len({t.replace("▁", " ") for t in texts.values()})


def test_edges(spark, edge, none, exact):
    cache = scratch(spark, "t")
    assert told(K.count_tokens(none, MODEL, cache)) == [] and stored(spark, cache).count() == 0
    assert told(K.count_tokens(edge, MODEL, cache)) == expected([(r[0], r[1]) for r in EDGE], exact)
    odd = [(1, "</s> <s> a <unk>"), (2, "a▁b"), (3, "a b"), (4, "▁"), (5, "a  b\n\tc "), (6, "日本 😀 \U000f0000"), (7, "\x00\x01"), (8, "<0x41>")]
    assert told(K.count_tokens(spark.createDataFrame(odd, "doc_id long, text string"), MODEL, cache)) == expected(odd, exact)


def test_hits_are_not_encoded(spark, exact, monkeypatch):
    """Of a second corpus only new contents are encoded; stored counts are believed; another version has counts of its own."""
    cache, calls = scratch(spark, "t"), []
    append = K.append_misses
    monkeypatch.setattr(K, "append_misses", lambda texts, missing, number, *a: (calls.append(number), append(texts, missing, number, *a))[1])
    of = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    K.count_tokens(of([(i, f"text {i % 5}") for i in range(40)]), MODEL, cache).count()
    assert calls == [5]
    # A count that no tokenizer gives shows that the cache answers.
    version = K.version_digest(MODEL)
    spark.createDataFrame([("planted",)], "text string").select(F.lit(version).alias("tokenizer"), F.unhex(F.sha2("text", 256)).alias("content"), F.lit(777).cast("long").alias("n_tokens")).write.mode("append").partitionBy("tokenizer").parquet(cache)
    rows = [(1, "text 1"), (2, "planted"), (3, "new"), (4, "new")]
    got = {r["doc_id"]: r["n_tokens"] for r in K.count_tokens(of(rows), MODEL, cache).collect()}
    assert calls == [5, 1] and got == {1: exact("text 1"), 2: 777, 3: exact("new"), 4: exact("new")}
    other = P.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(other)
    assert {r["doc_id"]: r["n_tokens"] for r in K.count_tokens(of(rows), other, cache).collect()} == {k: len(whole.encode(t, add_special_tokens=False).ids) for k, t in rows}
    assert calls == [5, 1, 3] and stored(spark, cache).select("tokenizer").distinct().count() == 2
    # The same contents appended twice, as two jobs at once would.
    stored(spark, cache).where(F.col("tokenizer") == version).cache().write.mode("append").partitionBy("tokenizer").parquet(cache)
    assert told(K.count_tokens(of(rows), MODEL, cache)) == sorted(((k, len(t.encode()), 777 if t == "planted" else exact(t)) for k, t in rows), key=str)


def test_hot_content(spark, exact):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("the same text")).otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    got = K.count_tokens(rows, MODEL, scratch(spark, "t"))
    assert got.count() == 6000 and {r["n_tokens"] for r in got.where("doc_id % 3 = 0").select("n_tokens").distinct().collect()} == {exact("the same text")}
