"""Vectorised work on the UTF-8 bytes of an Arrow batch of texts: words, hashes, shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at a time; one longer text is handled alone.
CHUNK_BYTES = 2_000_000

U64 = np.uint64
#: An odd base for polynomial hashes modulo 2^64, and multipliers that mix bits.
BASE, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53

#: Bytes that make up words: digits, letters and every byte of a non-ASCII character.
WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[0x30:0x3A] = WORD_BYTE[0x41:0x5B] = WORD_BYTE[0x61:0x7B] = WORD_BYTE[0x80:] = True


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column without nulls (null counts as empty)."""
    got = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(got, "") if got.null_count else got


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts together, and where each text starts (one more entry than texts)."""
    _, offsets, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    off = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes each, or one row."""
    _, off = utf8(texts)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        yield at, min(end, len(texts))
        at = end


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(33))) * U64(MIX_A)
    x = (x ^ (x >> U64(33))) * U64(MIX_B)
    return x ^ (x >> U64(33))


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (bytes), and the number of the first word of each text (one more entry than texts)."""
    inside = WORD_BYTE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = off[(off > 0) & (off < len(raw))]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    n = len(raw)
    inverse = pow(BASE, -1, 1 << 64)
    power, back = np.full(n + 1, BASE, U64), np.full(n + 1, inverse, U64)
    power[0] = back[0] = 1
    np.cumprod(power, out=power)
    np.cumprod(back, out=back)
    total = np.zeros(n + 1, U64)
    np.cumsum((raw.astype(U64) + U64(1)) * power[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(U64))


def shingles(hashes: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each k words in a row of a text, in text order, and where each text's begin; a shorter, non-empty text has one of all its words."""
    n, count = len(hashes), np.diff(at)
    out = np.zeros(n, U64)
    step = 1
    for _ in range(k):
        moved = np.zeros(n, U64)
        if step - 1 < n:
            moved[: n - step + 1] = hashes[step - 1 :]
        out = out * U64(BASE) + moved
        step += 1
    number = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    begin = np.concatenate(([0], np.cumsum(number)))
    place = np.repeat(at[:-1] - begin[:-1], number) + np.arange(begin[-1])
    got = out[place]
    for i in np.flatnonzero((count > 0) & (count < k)):
        x = 0
        for h in hashes[at[i] : at[i + 1]]:
            x = (x * BASE + int(h)) & 0xFFFFFFFFFFFFFFFF
        got[begin[i]] = x
    return mix(got), begin
