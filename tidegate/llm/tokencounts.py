"""Token counts with a digest cache: each distinct content is encoded once for each tokenizer version, ever.

A cache is a Parquet folder of (tokenizer, content, n_tokens): ``tokenizer`` is the digest of the vocabulary file and
of the library's version and options, ``content`` the SHA-256 of the text in the form to which the tokenizer itself
brings it. Contents that stand in the cache under the version are looked up, the distinct others are encoded, and
their counts appended, so that the next run, or another corpus with the same texts, finds them.

Scale. What is joined are digests. Only texts of contents that the cache lacks are shuffled, one for each partition
and content (the partial aggregate drops the copies first); where few are missing their digests are broadcast, by
their counted number, and all other texts stay where they are. A content that very many rows share is joined apart.
Appending the same content twice, as two jobs at once or a repeated one may, does no harm: equal contents have equal
counts, and a reader takes one.

Null texts are empty. Repeated keys and rows give repeated rows, null keys stay; other columns are not looked at; an
empty table gives none and appends nothing.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm import textarrays as ta
from tidegate.llm.base import lookup, materialise, scratch, small_batches, table

CACHE = "tokenizer string, content binary, n_tokens long"
#: Missing contents whose digests are broadcast (about 10 MB).
MOST_BROADCAST = 100_000
#: Bytes of text encoded at a time.
ENCODE_BYTES = 1_000_000
LONG_TOKENS = 4096


def encoder(file: str) -> Callable[[list[str]], list[int]]:
    """Counts the tokens of texts by the library of the vocabulary file, without added tokens."""
    if file.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=file)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks run in parallel already
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(file)
    whole.no_truncation()
    whole.no_padding()
    return lambda texts: [len(x.ids) for x in whole.encode_batch_fast(texts, add_special_tokens=False)]


def version_digest(file: str) -> str:
    """Names what decides a count: the vocabulary, the library and its version, and how it is called."""
    if file.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    with open(file, "rb") as f:
        return hashlib.sha256(f.read() + f"\n{library.__name__} {library.__version__} no added tokens".encode()).hexdigest()


def normal_form(text: Column, file: str) -> Column:
    """A text as its tokenizer sees it, as far as that is known without the library: one that writes spaces as U+2581
    and changes nothing else takes both for the same; else texts are their own form."""
    if file.endswith(".model"):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(file, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.escape_whitespaces and not spec.precompiled_charsmap and not spec.remove_extra_whitespaces:
            return F.replace(text, F.lit("▁"), F.lit(" "))
    return text


def stored_counts(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """What a cache holds for a tokenizer version: content, n_tokens, one row for each content."""
    spark.createDataFrame([], CACHE).write.mode("ignore").partitionBy("tokenizer").parquet(cache)
    return spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def append_misses(texts: DataFrame, missing: DataFrame, number: int, cache: str, file: str, version: str, broadcast_up_to: int = MOST_BROADCAST) -> None:
    """Encode one text of each missing content (``number`` of them) and append the counts to the cache."""
    few = number <= broadcast_up_to
    found = texts.join(F.broadcast(missing), "content", "left_semi") if few else texts
    one = found.groupBy("content").agg(F.first("text").alias("text"))
    one = one if few else one.join(missing, "content", "left_semi")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(file)
        for whole in batches:
            for lo, hi in ta.chunks(whole.column(1), ENCODE_BYTES):
                part = whole.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count(part.column(1).to_pylist()), pa.int64())], ["content", "n_tokens"])

    counted = one.select("content", "text").mapInArrow(encode, "content binary, n_tokens long")
    counted.select(F.lit(version).alias("tokenizer"), "content", "n_tokens").write.mode("append").partitionBy("tokenizer").parquet(cache)


def count_tokens(docs: DataFrame, file: str, cache: str, key: str = "doc_id", text: str = "text", broadcast_up_to: int = MOST_BROADCAST) -> DataFrame:
    """A row for each row of ``docs``: key, n_bytes (UTF-8), n_tokens; the cache holds all its contents afterwards."""
    spark = docs.sparkSession
    small_batches(spark)
    version = version_digest(file)
    whole = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("raw")).select("key", F.octet_length("raw").cast("long").alias("n_bytes"), normal_form(F.col("raw"), file).alias("text"))
    texts = whole.withColumn("content", F.unhex(F.sha2("text", 256)))
    rows = materialise(texts.select("key", "n_bytes", "content"), "token-rows")
    wanted = materialise(rows.groupBy("content").agg(F.count("*").alias("n")), "token-contents")
    missing = materialise(wanted.join(stored_counts(spark, cache, version), "content", "left_anti").select("content"), "token-misses")
    if number := missing.count():
        append_misses(texts.select("content", "text"), missing, number, cache, file, version, broadcast_up_to)
    counts = stored_counts(spark, cache, version).join(wanted, "content")
    return lookup(rows, counts, "content", rows.count()).select(F.col("key").alias(key), "n_bytes", "n_tokens")


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all ``documents``, from a cache of its own that starts empty."""
    import public_tokenizers as P

    counted = count_tokens(table(spark, sf_dir, "documents"), P.path("piece_bpe_32k.model"), scratch(spark, "token-cache"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LONG_TOKENS)
