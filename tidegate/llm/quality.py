"""Document quality from a linear-chain conditional random field over lines.

Each non-empty line is labelled good or bad. A line's features (make-up of its characters and words, repetition) and
those of the lines beside it score the labels; the chain's transitions tie neighbouring labels. Forward and backward
passes give the marginal of each line, and marginals weighted by line length, calibrated against the labels of
documents, give the quality of a document.

The labels of lines are latent: all lines of a good document are good, and a bad document holds a bad line at least,
wherever it stands. The field maximises the likelihood of that, so that lines of bad documents which look like those
of good ones are labelled good. It is fitted on a bounded sample: SAMPLE_DOCS labelled documents in expectation, chosen
by a hash of the key. A chain of two labels needs one number a line for each message, the log-odds of good against
bad, so all documents of a batch are passed along together.

Rows are documents by themselves: null keys stay (and are not held out, nor have labels), keys and rows that repeat
give rows that repeat. An empty table gives none; without labels there is no field. Columns that are not named are not
looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm import textarrays as ta
from tidegate.llm.base import materialise, small_batches, table

#: Labelled documents that the field is fitted on, in expectation.
SAMPLE_DOCS = 8000
#: Lines of that sample, in expectation: where it has more, documents are thinned out again.
SAMPLE_LINES = 200_000
PREDICT_AT = 0.3
#: Words of a passage that counts as repeated where it stands twice in a document.
REPEAT_WORDS = 5

#: Classes of bytes: 0 spaces and controls, 1 lower case, 2 upper case, 3 digits, 4 bars, 5 exclamation marks, 6 symbols, 7 punctuation, 8 non-ASCII.
KIND = np.zeros(256, np.int64)
KIND[0x61:0x7B], KIND[0x41:0x5B], KIND[0x30:0x3A], KIND[0x80:] = 1, 2, 3, 8
for _k, _chars in ((4, b"|"), (5, b"!"), (6, b"#$%&*<>{}[]=+~^_@\\/`"), (7, b".,;:'\"?()-")):
    KIND[list(_chars)] = _k
KINDS = 9
OWN = 14
#: Features that a line also takes from the lines before and after it.
SHARED = (2, 4, 5, 6, 8, 9)
FEATURES = OWN + 2 * len(SHARED) + 2


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every non-empty line, its bytes, and the first line of each text (one more entry than texts)."""
    raw, off = ta.utf8(texts)
    n = len(raw)
    if not n:
        return np.zeros((0, FEATURES)), np.zeros(0), np.zeros(len(off), np.int64)
    newline = raw == 10
    opens = np.zeros(n, np.int64)
    opens[off[:-1][off[:-1] < n]] = 1
    opens[1:] |= newline[:-1]
    line = np.cumsum(opens) - 1
    lines = int(line[-1]) + 1
    first = np.flatnonzero(opens)
    doc = np.searchsorted(off, first, side="right") - 1
    made = np.bincount(line * KINDS + KIND[raw], minlength=lines * KINDS).reshape(lines, KINDS).astype(float)
    size = made.sum(1) - np.bincount(line[newline], minlength=lines)
    starts, ends, at = ta.words(raw, off)
    h = ta.span_hashes(raw, starts, ends)
    of = line[starts]
    count = np.bincount(of, minlength=lines).astype(float)
    per = np.maximum(count, 1)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    repeated = repeated_words(h, at)
    letters = np.maximum(made[:, 1] + made[:, 2], 1)
    whole = np.maximum(size, 1)
    last = raw[np.minimum(first + np.maximum(size, 1).astype(np.int64) - 1, n - 1)]
    ends_well = np.isin(last, np.frombuffer(b".!?:\"", np.uint8))
    lengths = np.bincount(of, weights=ends - starts, minlength=lines)
    own = np.stack([
        np.log1p(count), lengths / per / 10, made[:, 2] / letters, made[:, 3] / whole, made[:, 4] / per, made[:, 5] / per, made[:, 6] / per, made[:, 7] / per,
        np.bincount(of, weights=again, minlength=lines) / per, np.bincount(of, weights=repeated, minlength=lines) / per, ends_well, count < 3, made[:, 8] / whole, np.log1p(size) / 5,
    ], 1)
    keep = size > 0
    own, doc, size = own[keep], doc[keep], size[keep]
    begin = np.searchsorted(doc, np.arange(len(off)))
    top, end = np.zeros(len(doc), bool), np.zeros(len(doc), bool)
    top[begin[:-1][np.diff(begin) > 0]] = True
    end[begin[1:][np.diff(begin) > 0] - 1] = True
    beside = own[:, SHARED]
    before, after = np.roll(beside, 1, 0), np.roll(beside, -1, 0)
    before[top], after[end] = beside[top], beside[end]
    return np.hstack([own, before, after, top[:, None], end[:, None]]), size, begin


def repeated_words(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each word is part of a passage of REPEAT_WORDS words that stands twice or more in its text."""
    count = np.diff(at)
    grams, begin = ta.shingles(h, at, REPEAT_WORDS)
    own = grams ^ ta.mix(np.repeat(np.arange(len(count), dtype=np.uint64), np.diff(begin)) + np.uint64(1))
    order = np.argsort(own, kind="stable")
    same = own[order][1:] == own[order][:-1]
    twice = np.zeros(len(own), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    place = np.arange(len(own)) - np.repeat(begin[:-1], np.diff(begin)) + np.repeat(at[:-1], np.diff(begin))
    marks = np.zeros(len(h) + REPEAT_WORDS + 1)
    spot = place[twice]
    np.add.at(marks, spot, 1)
    np.add.at(marks, spot + REPEAT_WORDS, -1)
    return np.cumsum(marks)[: len(h)] > 0


@dataclass
class Field:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    bias: float
    moves: np.ndarray  # score of label to label: [[bad bad, bad good], [good bad, good good]]
    scale: np.ndarray  # calibration of the weighted marginals: bias, log-odds, log length
    prior: float

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.spread) @ self.weights + self.bias


def chains(begin: np.ndarray) -> list[np.ndarray]:
    """Of each step along the chains, the lines that stand there; the longest chains first."""
    size = np.diff(begin)
    order = np.argsort(-size, kind="stable")
    starts, size = begin[:-1][order], size[order]
    alive = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), side="left")
    return [starts[:k] + t for t, k in enumerate(alive)]


def pass_messages(e: np.ndarray, steps: list[np.ndarray], moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of good from the lines before with the line itself, and from the lines after."""
    forward, backward = np.zeros(len(e)), np.zeros(len(e))
    for t, here in enumerate(steps):
        if t == 0:
            forward[here] = e[here]
            continue
        a = forward[steps[t - 1][: len(here)]]
        forward[here] = e[here] + np.logaddexp(moves[0, 1], a + moves[1, 1]) - np.logaddexp(moves[0, 0], a + moves[1, 0])
    for t in range(len(steps) - 2, -1, -1):
        after = steps[t + 1]
        x = e[after] + backward[after]
        backward[steps[t][: len(after)]] = np.logaddexp(moves[1, 0], x + moves[1, 1]) - np.logaddexp(moves[0, 0], x + moves[0, 1])
    return forward, backward


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def all_good(e: np.ndarray, backward: np.ndarray, begin: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """For each document the log of the chance that all its lines are good; 0 without lines."""
    odds = e + backward + moves[1, 1] - moves[1, 0]  # of good after a good line
    first = begin[:-1][np.diff(begin) > 0]
    odds[first] = e[first] + backward[first]
    return np.diff(np.concatenate(([0.0], np.cumsum(-np.logaddexp(0, -odds))))[begin])


def fit_field(x: np.ndarray, size: np.ndarray, begin: np.ndarray, label: np.ndarray, rounds: int = 150, rate: float = 0.05, ridge: float = 1e-3) -> Field:
    """Gradient ascent (Adam) on the likelihood of the documents' labels with latent lines; documents weigh alike.

    Of a good document the gradient is what all-good lines have beyond expectation. Of a bad one, in which all are
    good with the chance p, expectation given a bad line exceeds plain expectation by p / (1 - p) times the opposite.
    """
    lines = np.diff(begin)
    mean, spread = x.mean(0), x.std(0) + 1e-6
    z = (x - mean) / spread
    docs = max(1, int((lines > 0).sum()))
    steps = chains(begin)
    p = np.zeros(z.shape[1] + 5)
    m1, m2 = np.zeros_like(p), np.zeros_like(p)
    for i in range(1, rounds + 1):
        w, bias, moves = p[:-5], p[-5], p[-4:].reshape(2, 2)
        e = z @ w + bias
        f, b = pass_messages(e, steps, moves)
        sure = np.exp(np.minimum(all_good(e, b, begin, moves), -1e-3))
        pull = np.where(label > 0, 1.0, -sure / (1 - sure)) / np.maximum(1, lines)
        weight = np.repeat(pull, lines)
        miss = weight * (1 - sigmoid(f + b))
        g = np.concatenate([z.T @ miss, [miss.sum()], np.zeros(4)]) / docs
        pairs = np.zeros(4)
        for t in range(1, len(steps)):
            here, old = steps[t], steps[t - 1][: len(steps[t])]
            after = e[here] + b[here]
            score = np.stack([moves[0, 0] + 0 * after, moves[0, 1] + after, f[old] + moves[1, 0], f[old] + moves[1, 1] + after], 1)
            share = np.exp(score - score.max(1, keepdims=True))
            share /= share.sum(1, keepdims=True)
            pairs += ((np.array([0.0, 0.0, 0.0, 1.0]) - share) * weight[here][:, None]).sum(0)
        g[-4:] = pairs / docs
        g -= ridge * p
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        p = p + rate * (m1 / (1 - 0.9**i)) / (np.sqrt(m2 / (1 - 0.999**i)) + 1e-8)
        p[-4:] = np.clip(p[-4:], -3, 3)
    field = Field(mean, spread, p[:-5], float(p[-5]), p[-4:].reshape(2, 2), np.array([0.0, 1.0, 0.0]), float(label.mean()) if len(label) else 0.5)
    filled = lines > 0
    if filled.any():
        field.scale = calibrate(raw_quality(field, x, size, begin)[filled], label[filled])
    return field


def line_marginals(field: Field, x: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The chance of each line to be good, given all lines of its document."""
    f, b = pass_messages(field.emissions(x), chains(begin), field.moves)
    return sigmoid(f + b)


def raw_quality(field: Field, x: np.ndarray, size: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For each document a one, the log-odds of its length-weighted share of good lines, and its log length."""
    out = np.zeros((len(begin) - 1, 3))
    filled = np.flatnonzero(np.diff(begin))
    if len(filled):
        at = begin[:-1][filled]
        total = np.add.reduceat(size, at)
        share = np.clip(np.add.reduceat(line_marginals(field, x, begin) * size, at) / total, 1e-4, 1 - 1e-4)
        out[filled] = np.stack([np.ones(len(at)), np.log(share / (1 - share)), np.log1p(total) / 10], 1)
    return out


def calibrate(r: np.ndarray, label: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge."""
    w = np.zeros(r.shape[1])
    for _ in range(rounds):
        p = sigmoid(r @ w)
        g = r.T @ (label - p) - 0.1 * w
        w = w + np.linalg.solve((r * (p * (1 - p) + 1e-6)[:, None]).T @ r + 0.1 * np.eye(len(w)), g)
    return w


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = SAMPLE_DOCS) -> Field | None:
    """Fit on a bounded sample of the labelled documents given (hold rows out before); None without one.

    Of a document's several labels the greatest counts. Labelled keys are drawn first and broadcast (``most`` in
    expectation); if their rows are more than that, since keys repeat, rows are drawn; then rows again down to
    SAMPLE_LINES lines.
    """
    small_batches(docs.sparkSession)
    told = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg((F.max(label) > 0).cast("int").alias("y"))
    share = min(1.0, most / max(1, told.count()))
    luck = lambda *of: F.pmod(F.xxhash64(*of, F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    drawn = materialise(told.where(luck(F.col("key").cast("string")) < share), "quality-keys")
    keys = F.broadcast(drawn)
    number = docs.select(F.col(key).alias("key")).join(keys, "key").count()
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if number > 2 * most:
        rows = rows.where(luck(F.col("key").cast("string"), F.col("text"), F.monotonically_increasing_id()) < most / number)
    rows = rows.join(keys, "key").select("y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = ta.column(b, "text")
            for lo, hi in ta.chunks(texts):
                x, size, begin = line_features(texts.slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(np.diff(begin), pa.int64()), pa.array([x[i:j].astype(np.float32).tobytes() for i, j in zip(begin[:-1], begin[1:])], pa.binary()), pa.array([size[i:j].tobytes() for i, j in zip(begin[:-1], begin[1:])], pa.binary())], ["y", "lines", "x", "size"])

    sample = materialise(rows.mapInArrow(run, "y int, lines long, x binary, size binary"), "quality-sample")
    lines = sample.agg(F.coalesce(F.sum("lines"), F.lit(0))).first()[0]
    got = sample.where(luck(F.monotonically_increasing_id()) < SAMPLE_LINES / max(1, lines)).toPandas()
    if not len(got):
        return None
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(-1, FEATURES).astype(float)
    size = np.frombuffer(b"".join(got["size"]))
    begin = np.concatenate(([0], np.cumsum([len(s) // 8 for s in got["size"]])))
    return fit_field(x, size, begin, got["y"].to_numpy())


def score_quality(docs: DataFrame, field: Field | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score (0 to 1), lines, bad_lines and good: for each line whether it is good. A null or empty text has no
    line and the score of the labels' mean; so has every text without a field, whose lines are all good."""
    small_batches(docs.sparkSession)
    kind = dict(docs.select(F.col(key).alias("key")).dtypes)["key"]
    prior = field.prior if field else 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = ta.column(b, "text")
            for lo, hi in ta.chunks(texts):
                x, size, begin = line_features(texts.slice(lo, hi - lo))
                lines = np.diff(begin)
                score, good = np.full(hi - lo, prior), np.ones(len(x), bool)
                if field is not None and len(x):
                    score = np.where(lines > 0, sigmoid(raw_quality(field, x, size, begin) @ field.scale), prior)
                    good = line_marginals(field, x, begin) >= 0.5
                bad = np.diff(np.concatenate(([0], np.cumsum(~good)))[begin])
                marks = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(good))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(score), pa.array(lines, pa.int64()), pa.array(bad, pa.int64()), marks], ["key", "score", "lines", "bad_lines", "good"])

    return docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, f"key {kind}, score double, lines long, bad_lines long, good array<boolean>").withColumnRenamed("key", key)


def op10_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text of ``documents``; learned without the held-out fifth."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score_quality(docs, fit(docs, labels.where(~held_out())))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"), "lines", "bad_lines")
