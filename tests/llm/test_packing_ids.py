"""Ids joined from units equal those of whole texts; padding of tables of one line a text."""

import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidegate.llm import packing

FILE = P.path("byte_bpe_50k.json")
SIGNS = [" ", " ", " ", "\n", "\r\n", "\t", " ", "᠎", " ", "​", "\x1c", "\x85", "\0", "a", "b", "é", "ɏ", "×", "1", "½", "'s", "'", "'ll", "!", "e.", "x\n", "$$$", ".\n", "À!", "日", "😀", "<|endoftext|>", "<|endo", "text|>"]


@pytest.mark.parametrize("most", [0, packing.MOST_UNITS])
def test_units_give_the_ids_of_whole_texts(monkeypatch, docs, most):
    monkeypatch.setattr(packing, "MOST_UNITS", most)
    bpe, exact = packing.ByteBpe(FILE), Tokenizer.from_file(FILE)
    rng = random.Random(5)
    rows = ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 30))) for _ in range(20000)] + ["", " ", "  ", "\n", "a ", " a", "word " * 50, "x" * 5000]
    rows += [r["text"] or "" for r in docs.collect()]
    for lo in range(0, len(rows), 3000):
        part = rows[lo : lo + 3000]
        for text, got, want in zip(part, bpe.encode(pa.array(part)), exact.encode_batch_fast(part, add_special_tokens=False), strict=True):
            assert list(got) == want.ids, repr(text)
    assert bpe.encode(pa.array([], pa.string())) == []


def test_one_line_texts_leave_little_padding(spark):
    """Every id but the closing ones bears loss, in one partition and in several."""
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randint(1, 3000)))) for i in range(200)]
    for parts in (1, 5):
        got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts))
        sizes = [r["n"] for r in got.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()]
        used = sum(n if n & (n - 1) == 0 else packing.SEQUENCE_TOKENS for n in sizes)
        assert used <= 1.005 * sum(sizes) and max(sizes) <= packing.SEQUENCE_TOKENS
    assert np.mean([n == packing.SEQUENCE_TOKENS or n == packing.MOST_LOSS_TOKENS or n & (n - 1) == 0 for n in sizes]) > 0.5
