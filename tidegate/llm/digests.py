"""Document fingerprints: a quartile bucket digest.

Byte triplets from a window of four bytes are hashed into 128 buckets and counted. The digest holds the length (on a
logarithmic scale), the ratios of the quartiles of the counts, and for each bucket the quartile that its count falls
in (two bits). Two digests are compared by a difference with an upper bound, and likeness is one minus its share of
that bound. Equal texts have equal digests.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm.base import materialise, small_batches, table

BUCKETS = 128
#: For each triplet the bytes of the window that it takes, and odd multipliers.
TRIPLETS = (((0, 1, 2), 0x9E3779B1), ((0, 1, 3), 0x85EBCA77), ((0, 2, 3), 0xC2B2AE3D))
#: The difference of two buckets by how many quartiles they are apart; length and ratios add at most so much.
STEP = np.array([0, 1, 2, 6], dtype=np.int64)
LENGTH_WEIGHT, LENGTH_MOST, RATIO_MOST = 4, 60, 12
#: Upper bound of the difference; a greater one counts as this.
MOST = 300
#: Documents in a run of neighbours, and runs at most (their borders reach the driver: 16 bytes each).
RUN_ROWS, MOST_RUNS = 1024, 100_000
#: Runs that one task takes.
RUNS_A_TASK = 4


def digest(data: bytes) -> bytes:
    """34 bytes: length code, ratio code, 32 bytes of quartile codes."""
    raw = np.frombuffer(data, np.uint8).astype(np.uint32)
    counts = np.zeros(BUCKETS, np.int64)
    n = len(raw) - 3
    if n > 0:
        for places, odd in TRIPLETS:
            x = raw[places[0] : places[0] + n] << np.uint32(16)
            x |= raw[places[1] : places[1] + n] << np.uint32(8)
            x |= raw[places[2] : places[2] + n]
            x *= np.uint32(odd)
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            counts += np.bincount(x >> np.uint32(25), minlength=BUCKETS)
    q1, q2, q3 = np.partition(counts, (31, 63, 95))[[31, 63, 95]]
    code = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    body = np.packbits(np.stack([code >> 1, code & 1], 1).ravel()).tobytes()
    length = min(255, round(8 * math.log2(len(data) + 1)))
    ratio = (int(q1) * 15 // max(1, int(q3))) << 4 | int(q2) * 15 // max(1, int(q3))
    return bytes([length, ratio]) + body


def quartiles(fingerprint: bytes) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(fingerprint[2:], np.uint8)).reshape(-1, 2)
    return bits[:, 0].astype(np.int64) * 2 + bits[:, 1]


def difference(a: bytes, b: bytes) -> int:
    """From 0 (equal digests) to MOST."""
    total = min(LENGTH_MOST, LENGTH_WEIGHT * abs(a[0] - b[0]))
    total += min(RATIO_MOST, abs((a[1] >> 4) - (b[1] >> 4)) + abs((a[1] & 15) - (b[1] & 15)))
    total += int(STEP[np.abs(quartiles(a) - quartiles(b))].sum())
    return min(MOST, total)


def likeness(a: bytes, b: bytes) -> float:
    return 1.0 - difference(a, b) / MOST


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint (hexadecimal) of each whole text; null counts as empty."""
    small_batches(docs.sparkSession)
    kind = dict(docs.select(F.col(key).alias("key")).dtypes)["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([digest(t.encode()).hex() for t in b.column(1).to_pylist()], pa.string())], [key, "fingerprint"])

    return docs.select(key, F.coalesce(F.col(text), F.lit("")).alias(text)).mapInArrow(run, f"`{key}` {kind}, fingerprint string")


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))


def neighbour_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", run_rows: int = RUN_ROWS, places: DataFrame | None = None) -> DataFrame:
    """Documents dealt into runs of neighbours by descending key, each run with the first document of the next one.

    Keys are ranked by range partitions, so that a run has about ``run_rows`` documents whatever the keys are: far
    apart, negative, or at the ends of their type. Rows of one key, and rows without a key, are told apart by a hash of
    their texts, so they too are dealt over several runs. Texts are shuffled once; what is broadcast is three numbers for
    each run. ``places``: key and mark (hash) of each text, if they are written already. Columns: run, ahead (1: the next
    run's document), key, text; sorted by them within partitions, the key descending and null last.
    """
    rows = keyed(docs, key, text)
    down = F.coalesce(-F.col("key").cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    places = materialise(rows.select("key", "mark"), "digest-places") if places is None else places
    ranked = places.select(F.col("key").isNull().cast("int").alias("none"), down.alias("down"), "mark")
    runs = max(1, min(MOST_RUNS, -(-ranked.count() // run_rows)))
    firsts = ranked.repartitionByRange(runs, "none", "down", "mark").groupBy(F.spark_partition_id().alias("run")).agg(F.min(F.struct("none", "down", "mark")).alias("first"))
    tops = sorted((r["first"]["none"], int(r["first"]["down"]), r["first"]["mark"]) for r in firsts.collect())  # MOST_RUNS rows at most
    borders = docs.sparkSession.sparkContext.broadcast(tops)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [(int(k is None), -k if k is not None else 0, m) for k, m in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]
            run = [max(0, bisect_right(borders.value, x) - 1) for x in at]
            # The first document of a run is seen from the run before as well; that of the first run from the last.
            opens = [i for i, (x, r) in enumerate(zip(at, run, strict=True)) if borders.value[r] == x]
            take = list(range(len(at))) + opens
            to = run + [(run[i] - 1) % len(borders.value) for i in opens]
            ahead = [0] * len(at) + [1] * len(opens)
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(ahead, pa.int32()), *[b.column(i).take(pa.array(take, pa.int64())) for i in range(3)]], ["run", "ahead", "key", "text", "mark"])

    dealt = rows.mapInArrow(deal, "run long, ahead int, key long, text string, mark long")
    return dealt.repartition(-(-len(tops) // RUNS_A_TASK) or 1, "run").sortWithinPartitions("run", "ahead", F.desc_nulls_last("key"), "mark", "text").drop("mark")


def edited_digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document the digest of its text and of its edited text, and likenesses to the edited and the next text.

    Null texts are empty. Equal keys are separate rows, in the order of a hash of their texts; null keys come last. A
    single document is its own next one. Of very many rows equal in both, one is among its neighbours and the others
    are each followed by an equal text, so they are worked out once and repeated, and no run holds them all. An empty
    table gives none; other columns are not looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    places = materialise(keyed(docs, key, text).select("key", "mark"), "digest-places")
    # Fewer than 1 in RUN_ROWS rows.
    hot = materialise(places.groupBy("key", "mark").agg(F.count("*").alias("n")).where(F.col("n") > RUN_ROWS), "digest-hot")
    if hot.isEmpty():
        return _edited(docs, places, key, text)
    same = lambda a, b: a["key"].eqNullSafe(b["key"]) & (a["mark"] == b["mark"])
    rows = keyed(docs, key, text)
    one = materialise(rows.join(hot, same(rows, hot)).groupBy(rows["key"], rows["mark"]).agg(F.first("text").alias("text"), F.max("n").alias("n")), "digest-repeated")
    alone = materialise(rows.join(hot, same(rows, hot), "left_anti").select("key", "text").unionByName(one.select("key", "text")), "digest-single")
    own = one.select(F.monotonically_increasing_id().alias("key"), "key", "text", "n").toDF("id", "key", "text", "n")
    own = materialise(own, "digest-own")
    # Each of them by itself: its next text is its own.
    follow = own.select("id", "text").groupBy("id").applyInArrow(lambda t: _self_digest(t), "id long, " + _SHAPE)
    copies = own.select("id", "key", "n").join(follow, "id").withColumn("copy", F.explode(F.sequence(F.lit(2), F.col("n")))).select(F.col("key").alias(key), *_FIELDS)
    return _edited(alone, None, "key", "text").withColumnRenamed("key", key).unionByName(copies)


_SHAPE = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_FIELDS = [x.split()[0] for x in _SHAPE.split(", ")]


def _self_digest(rows: pa.Table) -> pa.Table:
    ((i, text),) = zip(*(rows.column(c).to_pylist() for c in ("id", "text")), strict=True)
    found = compared((None, i, text, digest(text.encode())), text, digest(text.encode()))
    return pa.table([pa.array([v], k) for v, k in zip(found, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()], strict=True)], names=["id", *_FIELDS])


def _edited(docs: DataFrame, places: DataFrame | None, key: str, text: str) -> DataFrame:
    schema = f"`{key}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # run, key, text, digest of the document that waits for its next one
        for b in batches:
            out: list[tuple] = []
            for r, ahead, k, t in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if ahead and (held is None or held[0] != r):
                    continue
                own = digest(t.encode())
                if held is not None and held[0] == r:
                    out.append(compared(held, t, own))
                held = None if ahead else (r, k, t, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate([pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()])], [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return neighbour_runs(docs, key, text, places=places).mapInArrow(run, schema)


def compared(held: tuple, next_text: str, next_digest: bytes) -> tuple:
    _, k, text, own = held
    cut = len(text) // 2
    edited = (text[: len(text) - cut] + next_text[:cut]).encode()
    other = digest(edited)
    return k, len(text), hashlib.sha256(edited).hexdigest(), own.hex(), other.hex(), likeness(own, other), likeness(own, next_digest)


def op5_bucket_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every whole text of ``documents`` and of its edited text."""
    return edited_digests(table(spark, sf_dir, "documents"))
