"""Language identification by error-correcting output codes.

Each language has a binary codeword; for each bit a classifier over hashed byte n-grams (log-odds between the
languages whose bit is set and the others) predicts it. A text's margins are decoded by the loss of each codeword,
weighted by how reliable each bit proved; the codeword of least loss is the language. A small gap to the second is
flagged as ambiguous.

The classifiers are fitted on a bounded sample: SAMPLE_PER_LANG documents a language, chosen by a hash of key and text.

Rows are documents by themselves: null keys stay (and are not held out), keys and rows that repeat give rows that
repeat. An empty table gives none, and no model. Columns that are not named are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm import textarrays as ta
from tidegate.llm.base import materialise, small_batches, table

#: Most documents of each language that the classifiers are fitted on (in expectation; a hash decides).
SAMPLE_PER_LANG = 3000
#: Languages at most; more are an error, not cut off.
MOST_LANGS = 1000
HASH_BITS, ORDERS = 15, (2, 3, 4)
#: Buckets whose weights one task makes, and rows of the sample whose margins calibrate the bits (in expectation).
PART_BUCKETS, CALIBRATE_ROWS = 512, 30_000
#: A gap in probability between the best and the second language below which a text counts as ambiguous.
AMBIGUOUS_GAP = 0.2
UNDETERMINED = "und"
#: Bytes handled at a time in the scoring pass.
CHUNK = 600_000

#: Lower-case ASCII letters; non-ASCII bytes stand for themselves, all else is a space.
LETTER = np.full(256, 32, np.uint8)
LETTER[0x41:0x5B] = np.arange(0x61, 0x7B)
LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
LETTER[0x80:] = np.arange(0x80, 0x100)


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def has_letter(texts: pa.Array) -> np.ndarray:
    """A letter is any character of a Unicode letter category."""
    return pc.match_substring_regex(texts, r"\pL").to_numpy(zero_copy_only=False)


def grams(texts: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each order the hashed n-grams of all texts in a row and the text that each belongs to (as first places)."""
    raw, off = ta.utf8(pc.utf8_lower(texts))
    size = np.diff(off) + 2  # a space before and after each text
    begin = np.concatenate(([0], np.cumsum(size)))
    data = np.full(begin[-1], 32, np.uint32)
    data[np.arange(len(raw)) + np.repeat(2 * np.arange(len(size)) + 1, size - 2)] = LETTER[raw]
    hashed, first = [], []
    for n in ORDERS:
        count = np.maximum(size - n + 1, 0)
        at = np.concatenate(([0], np.cumsum(count)))
        place = np.arange(at[-1]) + np.repeat(begin[:-1] - at[:-1], count)
        x = np.zeros(max(0, len(data) - n + 1), np.uint32)
        for i in range(n):
            x = (x << np.uint32(8)) | data[i : i + len(x)]
        x = (x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)
        x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        hashed.append((x >> np.uint32(32 - HASH_BITS))[place] if len(x) else np.zeros(0, np.uint32))
        first.append(at)
    return hashed, first


def code_matrix(k: int, seed: int = 7) -> np.ndarray:
    """Codewords of +1 and -1, a row for each language: all splits for up to five, else the best of random codes."""
    if k <= 1:
        return np.ones((k, 1), np.int8)
    if k <= 5:
        n = 2 ** (k - 1) - 1
        bits = (np.arange(1, n + 1)[None, :] >> np.arange(k - 1)[:, None]) & 1
        return np.vstack([np.where(bits, 1, -1), np.full(n, -1)]).astype(np.int8)
    rng, n, best, most = np.random.default_rng(seed), int(np.ceil(10 * np.log2(k))), None, -1
    for _ in range(500):
        m = rng.choice(np.array([-1, 1], np.int8), (k, n))
        if (np.abs(m.sum(0)) == k).any():
            continue
        apart = int(((n - m.astype(int) @ m.T.astype(int)) // 2 + n * np.eye(k, dtype=int)).min())
        if apart > most:
            best, most = m, apart
    return best


@dataclass
class Ecoc:
    langs: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # n-gram buckets x bits
    scale: np.ndarray
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit's loss

    def margins(self, texts: pa.Array) -> np.ndarray:
        return margins(texts, self.weights)

    def decode(self, m: np.ndarray) -> np.ndarray:
        """Probability of each language from the loss of its codeword."""
        z = np.clip(m * self.scale + self.bias, -30, 30)
        loss = np.logaddexp(0, -z[:, None, :] * self.code[None, :, :]) @ self.trust
        p = np.exp(loss.min(1, keepdims=True) - loss)
        return p / p.sum(1, keepdims=True)


def margins(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    """The summed log-odds of each bit, divided by the root of the number of n-grams."""
    out = np.zeros((len(texts), weights.shape[1]))
    for lo, hi in ta.chunks(texts, CHUNK):
        hashed, first = grams(texts.slice(lo, hi - lo))
        total = np.zeros(hi - lo)
        for h, at in zip(hashed, first, strict=True):
            filled = np.flatnonzero(np.diff(at))
            if len(filled):
                out[lo + filled] += np.add.reduceat(weights[h], at[filled], axis=0)
            total += np.diff(at)
        out[lo:hi] /= np.sqrt(total + 10)[:, None]
    return out


def luck(*of: Column) -> Column:
    """A number from 0 to 1 by a hash."""
    return F.pmod(F.xxhash64(*of, F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)


def sample(docs: DataFrame, key: str, text: str, lang: str, per_lang: int) -> DataFrame:
    """Labelled rows, about ``per_lang`` of each language at most, chosen by a hash of key and text; written.

    Rows that repeat share their luck. A language that comes out far too large for that, or not at all, is drawn again
    row by row.
    """
    labelled = docs.where(F.col(lang).isNotNull()).select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGS + 1).collect()
    if len(counts) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    if not counts:
        return materialise(labelled.select("lang", "text"), "language-sample")
    share = F.element_at(F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, per_lang / r["n"])))]), F.col("lang"))
    drawn = materialise(labelled.where(luck(F.col("key").cast("string"), F.col("text")) < share).select("lang", "text"), "language-sample")
    got = {r["lang"]: r["n"] for r in drawn.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    odd = [r["lang"] for r in counts if r["n"] > per_lang and not 0 < got.get(r["lang"], 0) <= 2 * per_lang]
    if not odd:
        return drawn
    row = F.monotonically_increasing_id()
    again = labelled.where(F.col("lang").isin(odd)).where(luck(F.col("key").cast("string"), F.col("text"), row) < share).select("lang", "text")
    return materialise(drawn.where(~F.col("lang").isin(odd)).union(again), "language-sample")


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = SAMPLE_PER_LANG) -> Ecoc | None:
    """Fit on the rows given (hold rows out before); None without a labelled text.

    Rows may lack keys or repeat them. What reaches the driver is bounded whatever the languages: weights of n-gram
    buckets and bits, and the margins of at most about CALIBRATE_ROWS rows.
    """
    small_batches(docs.sparkSession)
    rows = sample(docs, key, text, lang, per_lang).coalesce(8)  # a bounded number of texts

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            names = np.array(b.column(0).to_pylist(), object)
            for name in set(names):
                mine = b.column(1).filter(pa.array(names == name))
                got = sums.setdefault(name, np.zeros(1 << HASH_BITS, np.int64))
                for lo, hi in ta.chunks(mine):
                    for h in grams(mine.slice(lo, hi - lo))[0]:
                        got += np.bincount(h, minlength=1 << HASH_BITS)
        for name, got in sums.items():
            at = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(got[at], pa.int64())], ["lang", "bucket", "n"])

    seen = materialise(rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "language-grams")
    totals = {r["lang"]: r["n"] for r in seen.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # MOST_LANGS rows at most
    langs = sorted(totals)
    if not langs:
        return None
    code, number = code_matrix(len(langs)), {x: i for i, x in enumerate(langs)}
    size = np.array([totals[x] for x in langs], float)[:, None]

    def weigh(part: pd.DataFrame) -> pd.DataFrame:
        """The log-odds of each bit in the buckets of one part, which has every language."""
        first = int(part["part"].iloc[0]) * PART_BUCKETS
        counts = np.zeros((len(langs), PART_BUCKETS))
        counts[part["lang"].map(number), part["bucket"] - first] = part["n"]
        return pd.DataFrame({"bucket": np.arange(first, first + PART_BUCKETS), "w": bit_weights(counts, size, code).tolist()})

    parts = seen.withColumn("part", F.floor(F.col("bucket") / PART_BUCKETS).cast("int")).groupBy("part").applyInPandas(weigh, "bucket int, w array<double>").toPandas()
    weights = np.tile(bit_weights(np.zeros((len(langs), 1)), size, code), (1 << HASH_BITS, 1)).astype(np.float32)
    weights[parts["bucket"].to_numpy()] = np.array(parts["w"].tolist(), np.float32)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = margins(b.column(1), weights)
            yield pa.RecordBatch.from_arrays([pa.array([number[x] for x in b.column(0).to_pylist()], pa.int32()), pa.array(m.tolist(), pa.list_(pa.float64()))], ["lang", "m"])

    few = rows.where(F.col("lang").isNotNull() & (luck(F.monotonically_increasing_id()) < min(1.0, CALIBRATE_ROWS / max(1, rows.count()))))
    told = few.mapInArrow(score, "lang int, m array<double>").toPandas()
    m, y = np.array(told["m"].tolist()).reshape(-1, code.shape[1]), code[told["lang"].to_numpy(np.int64)]
    scale, bias, trust = calibrate(m, y)
    return Ecoc(langs, code, weights, scale, bias, trust)


def bit_weights(counts: np.ndarray, size: np.ndarray, code: np.ndarray) -> np.ndarray:
    """For each bucket (column of ``counts``, a row for each language) and bit: how much likelier the n-gram is in the languages of the one sign."""
    rate = (counts + 0.5) / (size + 0.5 * (1 << HASH_BITS))
    side = lambda of: np.log(rate[of].mean(0) if of.any() else np.ones(rate.shape[1]))
    return np.clip(np.stack([side(c == 1) - side(c == -1) for c in code.T], 1), -8, 8)


def calibrate(m: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A logistic scale and bias for each bit, both signs weighted alike, and a weight by how often the bit is right."""
    spread = m.std(0) + 1e-9
    scale, bias = np.ones(m.shape[1]), np.zeros(m.shape[1])
    x = m / spread
    share = np.where(y > 0, 1 / np.maximum(1, (y > 0).sum(0)), 1 / np.maximum(1, (y < 0).sum(0)))
    for _ in range(steps):
        pull = share * y / (1 + np.exp(np.clip(y * (x * scale + bias), -30, 30)))
        scale += 0.5 * ((pull * x).sum(0) - 0.01 * scale)
        bias += 0.5 * pull.sum(0)
    right = (share * (np.sign(x * scale + bias) == y)).sum(0) / np.maximum(1e-9, share.sum(0))
    right = np.clip(right, 0.5, 0.999)
    return scale / spread, bias, np.maximum(0.05, np.log(right / (1 - right)) / np.log(999))


def predict(docs: DataFrame, model: Ecoc | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` with lang_pred, score (its probability), second (the next language) and ambiguous.

    A null text, and one without a letter, is ``und`` with score 0; so is every text without a model.
    """
    small_batches(docs.sparkSession)
    types = dict(docs.select(*keep).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = ta.column(b, "the_text")
            known = has_letter(texts) if model else np.zeros(len(texts), bool)
            lang, score, second, unsure = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts)), np.full(len(texts), None, object), np.ones(len(texts), bool)
            if known.any():
                p = model.decode(model.margins(texts.filter(pa.array(known))))
                order = np.argsort(-p, 1, kind="stable")
                rows = np.arange(len(p))
                names = np.array(model.langs, object)
                best = p[rows, order[:, 0]]
                lang[known], score[known] = names[order[:, 0]], best
                gap = best
                if p.shape[1] > 1:
                    second[known] = names[order[:, 1]]
                    gap = best - p[rows, order[:, 1]]
                unsure[known] = gap < AMBIGUOUS_GAP
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + [pa.array(lang, pa.string()), pa.array(score), pa.array(second, pa.string()), pa.array(unsure)], [*keep, "lang_pred", "score", "second", "ambiguous"])

    schema = ", ".join(f"`{k}` {v}" for k, v in types.items()) + ", lang_pred string, score double, second string, ambiguous boolean"
    return docs.select(*keep, F.col(text).alias("the_text")).mapInArrow(run, schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of ``documents``; learned without the held-out quarter."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    return predict(docs, model).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score", "second", "ambiguous")
