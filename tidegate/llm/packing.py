"""Packing by vector bins: sequences under simultaneous limits on tokens, segments and loss-bearing tokens.

Each task packs the documents of its own partition, so nothing is shuffled. Whole sequences are cut from a document
first, where its tokens and its loss allow one; the rest waits in a buffer of bounded size. A sequence is filled from
the buffer by the dot-product heuristic: of the pieces that fit all limits, the one whose demand has the greatest dot
product with what is left of the limits (each dimension divided by its limit). Where no piece fits, one is cut to fill
the sequence. Where the pieces that a sequence may hold cannot fill it, and at the end of a partition, sequences are
of a power of two tokens, which need no padding.

Without a mask the first line of a text of several lines is its prompt and bears no loss, nor does the closing id.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm import textarrays as ta
from tidegate.llm.base import small_batches, table

#: The limits of a sequence: its length, the attention blocks of a batch, and the loss-bearing tokens of a step.
SEQUENCE_TOKENS, MOST_SEGMENTS, MOST_LOSS_TOKENS = 1024, 4, 1020
#: Pieces that wait for a sequence in a task; they are shorter than a sequence.
BUFFER_PIECES = 512
#: Units (see ``ByteBpe``) that a task keeps with their ids.
MOST_UNITS = 500_000
#: White space, or a character that is white space to some versions of Unicode.
LOOSE_CHAR = frozenset(c for c in map(chr, range(0x3001)) if c.isspace() or c == "\u180e").__contains__
#: A space after white space.
LOOSE = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in map(chr, range(0x3001)) if LOOSE_CHAR(c)) + "] "
#: Places between pre-tokens besides those before spaces: a line end after a letter or sign, a sign after a letter or digit.
LINE_END, SIGN = "([!-~À-ɏ])\n", r"([0-9A-Za-zÀ-ÖØ-öø-ɏ])([!-/:-@\[-`{-~])"
#: Bytes of text encoded at a time.
ENCODE_BYTES = 4_000_000
END_ID = 0
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class ByteBpe:
    """Ids of the byte-level BPE in a tokenizers file.

    The model works within pre-tokens: runs of letters, of digits, of signs, each with one space before it, or of
    white space. A pre-token ends before white space that follows no white space, and before a sign that follows a
    letter. So a text is the row of its units between these places: each different unit is encoded once by the library
    and kept in a table of bounded size, and their ids are joined.
    """

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks run in parallel already
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(file)
        words = self.model.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(words.values()) + 1, np.int64)
        for word, i in words.items():  # one character stands for a byte
            self.width[i] = len(word)
        self.added = [x.content for x in self.model.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        """Unit ``known[u]`` has the ids ``flat[begin[known[u]] : begin[known[u] + 1]]``."""
        self.known: dict[str, int] = {}
        self.flat, self.begin = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def learn(self, units: list[str]) -> None:
        """Encode units: those that begin with a space or line end, and end otherwise, in rows that are cut by the bytes of their ids; the others singly."""
        odd = [u[:1] not in (" ", "\n") or LOOSE_CHAR(u[-1]) for u in units]
        units = [u for u, x in zip(units, odd, strict=True) if not x] + [u for u, x in zip(units, odd, strict=True) if x]
        inner = len(units) - sum(odd)
        ids, size = [self.flat], []
        for lo in range(0, inner, 2000):
            row = units[lo : min(inner, lo + 2000)]
            found = np.array(self.model.encode_batch_fast(["".join(row)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.searchsorted(np.cumsum(self.width[found]), np.cumsum([len(u.encode()) for u in row])) + 1
            ids.append(found)
            size.extend(np.diff(ends, prepend=0))
        for e in self.model.encode_batch_fast(units[inner:], add_special_tokens=False):
            ids.append(np.array(e.ids, np.uint32))
            size.append(len(e.ids))
        self.known.update(zip(units, range(len(self.begin) - 1, len(self.begin) - 1 + len(units)), strict=True))
        self.flat = np.concatenate(ids)
        self.begin = np.concatenate((self.begin, self.begin[-1] + np.cumsum(np.array(size, np.int64))))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text. Few texts at a time: a table of more than MOST_UNITS units is begun anew with each call."""
        if len(self.known) > MOST_UNITS:
            self.forget()
        loose = pc.match_substring_regex(texts, LOOSE)
        for x in ("\0", *self.added):
            loose = pc.or_(loose, pc.match_substring(texts, x))
        loose = loose.to_numpy(zero_copy_only=False)
        cut = pc.replace_substring(texts, " ", "\0 ")
        cut = pc.replace_substring_regex(pc.replace_substring_regex(cut, LINE_END, "\\1\0\n"), SIGN, "\\1\0\\2")
        spread = pc.split_pattern(cut, "\0")
        if loose.any():
            spread = pa.array([merged_units(t.as_py()) if odd else x.as_py() for t, x, odd in zip(texts, spread, loose, strict=True)], pa.list_(texts.type))
        told = spread.flatten().dictionary_encode()
        units = told.dictionary.to_pylist()
        if new := [u for u in units if u not in self.known]:
            self.learn(new)
        place = np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))[told.indices.to_numpy()] if units else np.zeros(0, np.int64)
        size = self.begin[place + 1] - self.begin[place]
        ends = np.concatenate(([0], np.cumsum(size)))
        ids = self.flat[np.repeat(self.begin[place] - ends[:-1], size) + np.arange(ends[-1])]
        cuts = ends[np.concatenate(([0], np.cumsum(pc.list_value_length(spread).to_numpy())))]
        return np.split(ids, cuts[1:-1]) if len(texts) else []

    def prompt(self, line: int, ids: np.ndarray) -> int:
        """How many ids begin in the first ``line`` bytes."""
        return int(np.searchsorted(np.cumsum(self.width[ids]), line, side="left")) + 1 if line > 0 else 0


def merged_units(text: str) -> list[str]:
    """Units of a text with a space after white space, a zero character or an added token: cut at spaces after others."""
    if "\0" in text:
        return [text]
    first, *parts = text.replace(" ", "\0 ").split("\0")
    out, now = [], first
    for part in parts:
        if now and not LOOSE_CHAR(now[-1]):
            out.append(now)
            now = part
        else:
            now += part
    return [*out, now]


class VectorPacker:
    """Packs pieces into sequences; ``add`` and ``finish`` yield (document, start, ids, sequence, offset)."""

    def __init__(self, tokens: int, segments: int, loss: int, first_sequence: int = 0, buffer: int = BUFFER_PIECES):
        if min(tokens, segments, loss) < 1:
            raise ValueError("limits must be positive")
        self.limits, self.next, self.buffer = (tokens, segments, loss), first_sequence, buffer
        self.held: list[tuple | None] = [None] * buffer  # document, start, ids, loss mask
        self.tokens = np.zeros(buffer, np.int64)
        self.loss = np.zeros(buffer, np.int64)
        self.lead = np.zeros(buffer, np.int64)  # tokens before the first that bears loss
        self.free = list(range(buffer))[::-1]

    def _put(self, slot: int, piece: tuple | None) -> None:
        self.held[slot] = piece
        self.tokens[slot] = len(piece[2]) if piece else 0
        self.loss[slot] = int(piece[3].sum()) if piece else 0
        self.lead[slot] = (int(piece[3].argmax()) if self.loss[slot] else self.tokens[slot]) if piece else 0
        if piece is None:
            self.free.append(slot)

    def add(self, document, ids: np.ndarray, mask: np.ndarray) -> Iterator[tuple]:
        size, _, most = self.limits
        at = 0
        while len(ids) - at >= size and int(mask[at : at + size].sum()) <= most:
            yield document, at, ids[at : at + size], self.next, 0
            self.next += 1
            at += size
        while at < len(ids):
            end = min(len(ids), at + size - 1)
            end = at + self._cut(mask[at:end], end - at, most)
            self._put(self.free.pop(), (document, at, ids[at:end], mask[at:end]))
            at = end
            if not self.free:
                while len(self.free) < self.buffer // 2:
                    yield from self.fill(size)

    @staticmethod
    def _cut(mask: np.ndarray, tokens: int, loss: int) -> int:
        """How many leading tokens stay within both limits (one at least)."""
        return max(1, min(tokens, int(np.searchsorted(np.cumsum(mask), loss, side="right"))))

    def fill(self, size: int) -> Iterator[tuple]:
        """One sequence of at most ``size`` tokens, or of a power of two where the pieces that it may hold have fewer."""
        total = self.limits
        reach = int(np.sort(self.tokens)[-total[1] :].sum())
        if reach < size:
            size = 1 << reach.bit_length() - 1
        left, offset = [size, total[1], total[2]], 0
        while left[0] > 0 and left[1] > 0:
            waits = self.tokens > 0
            fits = waits & (self.tokens <= left[0]) & (self.loss <= left[2])
            # After the next piece, the segments left must be able to use up the tokens left.
            fits &= self.tokens >= left[0] - (int(np.sort(self.tokens)[1 - left[1] :].sum()) if left[1] > 1 else 0)
            if fits.any():
                score = self.tokens * (left[0] / total[0] ** 2) + left[1] / total[1] ** 2 + self.loss * (left[2] / total[2] ** 2)
                slot = int(np.argmax(np.where(fits, score, -1.0)))
                piece, rest = self.held[slot], None
            elif (waits if left[2] > 0 else self.lead > 0).any():
                slot = int(np.argmax(self.tokens if left[2] > 0 else self.lead))
                document, start, ids, mask = self.held[slot]
                end = self._cut(mask[: left[0]], min(left[0], len(ids)), left[2])
                if int(mask[:end].sum()) > left[2]:
                    break
                piece = (document, start, ids[:end], mask[:end])
                rest = (document, start + end, ids[end:], mask[end:]) if end < len(ids) else None
            else:
                break
            self._put(slot, rest)
            yield piece[0], piece[1], piece[2], self.next, offset
            offset += len(piece[2])
            left = [left[0] - len(piece[2]), left[1] - 1, left[2] - int(piece[3].sum())]
        self.next += offset > 0

    def finish(self) -> Iterator[tuple]:
        while self.tokens.any():
            yield from self.fill(self.limits[0])


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined until they hold ENCODE_BYTES."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.get_total_buffer_size()
        if size >= ENCODE_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", mask: str | None = None, tokens: int = SEQUENCE_TOKENS, segments: int = MOST_SEGMENTS, loss: int = MOST_LOSS_TOKENS) -> DataFrame:
    """A row for each piece. ``mask``: a column with an array of booleans, one for each id, true where it bears loss;
    without it the first of several lines bears none. The closing id bears none. Null texts are empty and give the
    closing id alone."""
    small_batches(docs.sparkSession)
    kind = dict(docs.select(F.col(key).alias("key")).dtypes)["key"]
    cols = [F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")] + ([F.col(mask).alias("mask")] if mask else [])

    def bearing(told: list | None, line: int, ids: np.ndarray, bpe: ByteBpe) -> np.ndarray:
        bears = np.ones(len(ids) + 1, bool)
        bears[-1] = False
        if told is None:
            bears[: bpe.prompt(line, ids)] = False
        elif len(told) != len(ids):
            raise ValueError(f"{len(told)} flags for {len(ids)} ids")
        else:
            bears[:-1] = told
        return bears

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(tokenizer)
        packer = VectorPacker(tokens, segments, loss, TaskContext.get().partitionId() << 40)

        def rows(found: list[tuple], like: pa.DataType) -> pa.RecordBatch:
            values = [[x[0][0] for x in found], [x[1] for x in found], [len(x[2]) for x in found], [zlib.crc32(x[2].astype("<u4").tobytes()) for x in found], [x[0][1] for x in found], [x[3] for x in found], [x[4] for x in found]]
            return pa.RecordBatch.from_arrays([pa.array(v, like if i == 0 else pa.int64()) for i, v in enumerate(values)], ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        key_type = None
        for whole in gathered(batches):
            for lo, hi in ta.chunks(whole.column(1), ENCODE_BYTES):
                b = whole.slice(lo, hi - lo)
                out: list[tuple] = []
                key_type = b.column(0).type
                masks = b.column(2).to_pylist() if mask else [None] * b.num_rows
                lines = pc.find_substring(b.column(1), "\n").to_pylist()
                for k, line, m, ids in zip(b.column(0).to_pylist(), lines, masks, bpe.encode(b.column(1)), strict=True):
                    out.extend(packer.add((k, len(ids) + 1), np.append(ids, np.uint32(END_ID)), bearing(m, line, ids, bpe)))
                if out:
                    yield rows(out, key_type)
        if out := list(packer.finish()):
            yield rows(out, key_type)

    return docs.select(*cols).mapInArrow(run, f"key {kind}, {PIECES}").withColumnRenamed("key", key)


def pack_documents(docs: DataFrame) -> DataFrame:
    """``pack`` with the production tokenizer and limits."""
    import public_tokenizers as P

    return pack(docs, P.path("byte_bpe_50k.json"))


def op9_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of at most 1024 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))
