"""WARC archives as seekable Zstandard bundles.

A bundle is one file: groups of WARC records, each group an independent Zstandard frame, then a footer in a
skippable frame that lists the compressed and plain size of every frame (the public seekable format). The index
maps each record identifier to its bundle, frame and offset in the plain frame, so that one record is read by
decompressing one frame.

Writing is a pass over the partitions; every attempt of a task writes files of its own, and only files named in the
index (committed by Spark with the task's output) are ever read, so retries and lost executors leave no duplicates.
"""

from __future__ import annotations

import io
import struct
import uuid
from collections.abc import Iterable, Iterator
from hashlib import sha1

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm.base import lookup, materialise, scratch, small_batches, table

#: Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC, FOOTER = 0x184D2A5E, 0x8F92EAB1, struct.Struct("<IBI")
#: Plain bytes after which a frame ends, and compressed bytes after which a bundle ends.
FRAME_BYTES, BUNDLE_BYTES = 256 * 1024, 64 * 1024 * 1024
#: Frames that one reading task takes at a time.
FRAMES_A_TASK = 64
#: Tasks of a reading stage at most; beyond, each reads several ranges.
MOST_TASKS = 20_000
#: A payload of fewer bytes is always stored in full.
REVISIT_MIN_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

INDEX = "record_id string, bundle string, frame long, frame_offset long, record_bytes long"


def filesystem(uri: str):
    """The file system of a URI, and the path on it; a plain path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("file:///", "/", 1) if uri.startswith("file:///") else uri)


def record_bytes(record_id: str, kind: str, target: str, payload: bytes, digest: str, length: int, refers_to: str | None) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP headers, which name the length of the payload, but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {' '.join(target.split())}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(plain: bytes, at: int = 0) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """The records from an offset on: the offset, the headers (names in lower case) and the block."""
    while at < len(plain):
        end = plain.index(b"\r\n\r\n", at)
        lines = plain[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at offset {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(head["content-length"])
        yield at, head, plain[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


class BundleWriter:
    """Writes records into one bundle after another under a folder; ``add`` and ``close`` return index rows of closed bundles."""

    def __init__(self, folder: str, prefix: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES):
        self.folder, self.prefix, self.frame_bytes, self.bundle_bytes = folder, prefix, frame_bytes, bundle_bytes
        self.fs, self.path = filesystem(folder)
        self.fs.create_dir(self.path, recursive=True)
        self.number, self.out = 0, None
        self.zstd = zstandard.ZstdCompressor(level=3, write_checksum=True)

    def _open(self) -> None:
        self.name = f"{self.prefix}-{self.number:05d}.warc.zst"
        self.out = self.fs.open_output_stream(f"{self.path}/{self.name}", compression=None)
        self.number += 1
        self.frames: list[tuple[int, int]] = []
        self.rows: list[tuple[str, str, int, int, int]] = []
        self.buffer, self.size, self.written = [], 0, 0

    def add(self, record_id: str, record: bytes) -> list[tuple[str, str, int, int, int]]:
        if self.out is None:
            self._open()
        self.rows.append((record_id, f"{self.folder}/{self.name}", len(self.frames), self.size, len(record)))
        self.buffer.append(record)
        self.size += len(record)
        if self.size >= self.frame_bytes:
            self._end_frame()
        return self.close() if self.written >= self.bundle_bytes else []

    def _end_frame(self) -> None:
        if self.buffer:
            packed = self.zstd.compress(b"".join(self.buffer))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.written += len(packed)
            self.buffer, self.size = [], 0

    def close(self) -> list[tuple[str, str, int, int, int]]:
        if self.out is None:
            return []
        self._end_frame()
        entries = b"".join(struct.pack("<II", *x) for x in self.frames)
        footer = FOOTER.pack(len(self.frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer)
        self.out.close()
        self.out, rows = None, self.rows
        return rows


def seek_table(file, size: int) -> list[tuple[int, int, int]]:
    """From the footer: where each frame begins, its compressed and its plain size."""
    file.seek(size - FOOTER.size)
    n, flags, magic = FOOTER.unpack(file.read(FOOTER.size))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("the bundle has no seek table")
    width = 12 if flags & 0x80 else 8
    file.seek(size - FOOTER.size - n * width)
    raw, at, out = file.read(n * width), 0, []
    for i in range(n):
        packed, plain = struct.unpack_from("<II", raw, i * width)
        out.append((at, packed, plain))
        at += packed
    return out


def read_frames(bundle: str, numbers: Iterable[int]) -> Iterator[tuple[int, bytes]]:
    """The plain bytes of some frames of a bundle; nothing else of it is read but the footer."""
    fs, path = filesystem(bundle)
    with fs.open_input_file(path) as file:
        frames = seek_table(file, file.size())
        unpack = zstandard.ZstdDecompressor()
        for k in numbers:
            at, packed, plain = frames[k]
            file.seek(at)
            got = unpack.decompress(file.read(packed), max_output_size=plain)
            if len(got) != plain:
                raise ValueError(f"frame {k} of {bundle} is cut short")
            yield k, got


def plan_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = REVISIT_MIN_BYTES) -> DataFrame:
    """Rows to write: key, url, payload, digest, length, kind and refers_to.

    Of equal payloads of at least ``min_bytes`` bytes the one with the largest key is the response and the others
    revisit it. Digests of such payloads are counted with a partial aggregate, and those seen twice or more are joined
    back; a digest of very many rows is joined apart. A null key loses to any other.
    """
    rows = pages.select(F.col(key).alias("key"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "length": F.octet_length("payload").cast("long")})
    long, short = rows.where(F.col("length") >= min_bytes), rows.where(F.col("length") < min_bytes)
    counts = long.groupBy("digest").agg(F.max("key").alias("first_key"), F.count("*").alias("n"))
    several = materialise(counts.where("n > 1"), "warc-shared")
    total = several.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    joined = lookup(long, several, "digest", total, "left").drop("n").unionByName(short, allowMissingColumns=True)
    revisit: Column = F.col("first_key").isNotNull() & ~F.col("key").eqNullSafe(F.col("first_key"))
    return joined.select("key", "url", F.when(revisit, F.lit(None)).otherwise(F.col("payload")).alias("payload"), "digest", "length", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("first_key")).alias("refers_to"))


def write_bundles(records: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write the rows of ``plan_records`` as bundles under ``folder``; returns the index (written beside them)."""
    small_batches(records.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        out = BundleWriter(folder, f"part-{task.partitionId():06d}-{uuid.uuid4().hex[:10]}", frame_bytes, bundle_bytes)

        def rows(found):
            names = ["record_id", "bundle", "frame", "frame_offset", "record_bytes"]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], k) for i, k in enumerate(kinds)], names)

        for batch in batches:
            for r in batch.to_pylist():
                name = record_name(r["key"])
                found = out.add(name, record_bytes(name, r["kind"], r["url"], r["payload"] or b"", r["digest"], r["length"], record_name(r["refers_to"])))
                if found:
                    yield rows(found)
        if found := out.close():
            yield rows(found)

    return materialise(records.mapInArrow(write, INDEX), "warc-index")


def record_name(key) -> str:
    return "urn:page:" + ("null" if key is None else str(key))


def key_of(name: str | None) -> int | None:
    tail = (name or "").strip("<>").rpartition(":")[2]
    return None if tail in ("", "null") else int(tail)


def read_bundles(index: DataFrame, frames_a_task: int = FRAMES_A_TASK) -> DataFrame:
    """Read whole archives back, frame by frame through their seek tables, with the digests of what was read.

    Tasks get ranges of frames, so a large bundle is read by many tasks. Columns: key, payload_bytes, payload_digest,
    record_type, refers_to. A response whose payload does not have the digest in its header is an error.
    """
    ranges = index.select("bundle", (F.col("frame") / frames_a_task).cast("long").alias("part"), "frame").groupBy("bundle", "part").agg(F.min("frame").alias("lo"), F.max("frame").alias("hi"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                for _, plain in read_frames(r["bundle"], range(r["lo"], r["hi"] + 1)):
                    yield digest_rows(parse_records(plain))

    # A range is a few bytes that stand for megabytes: so many tasks as ranges, which adaptive execution keeps.
    return ranges.repartition(min(MOST_TASKS, max(1, ranges.count())), "bundle", "part").mapInArrow(read, "key long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def digest_rows(records) -> pa.RecordBatch:
    out: list[tuple] = []
    for _, head, block in records:
        http, _, payload = block.partition(b"\r\n\r\n")
        said = head["warc-payload-digest"].partition(":")[2]
        if head["warc-type"] == "response":
            size, digest = len(payload), sha1(payload).hexdigest()
            if digest != said:
                raise ValueError(f"{head['warc-record-id']}: payload digest {digest}, header {said}")
        else:
            size, digest = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), said
        out.append((key_of(head["warc-record-id"]), size, digest, head["warc-type"], key_of(head.get("warc-refers-to"))))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], ["key", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def fetch(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Random access: the records whose identifiers are in ``wanted`` (column record_id), each by one frame and its offset.

    Columns: record_id, record (the bytes). Identifiers that the index lacks give no row.
    """
    found = materialise(index.join(wanted.select("record_id").distinct(), "record_id", "left_semi"), "warc-wanted")
    tasks = min(MOST_TASKS, max(1, found.select("bundle", "frame").distinct().count() // FRAMES_A_TASK + 1))
    found = found.repartition(tasks, "bundle", "frame").sortWithinPartitions("bundle", "frame")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, plain = None, b""
        for batch in batches:
            got = []
            for r in batch.to_pylist():
                if held != (r["bundle"], r["frame"]):
                    held = (r["bundle"], r["frame"])
                    ((_, plain),) = read_frames(r["bundle"], [r["frame"]])
                got.append((r["record_id"], io.BytesIO(plain).getvalue()[r["frame_offset"] : r["frame_offset"] + r["record_bytes"]]))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.binary())], ["record_id", "record"])

    return found.mapInArrow(read, "record_id string, record binary")


def archive(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write ``pages`` as bundles (into the shared folder unless told otherwise) and return the index."""
    return write_bundles(plan_records(pages, **options), folder or scratch(pages.sparkSession, "warc"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, read back from the archives.

    A null html is an empty payload; equal page_ids are equal records, each read back; an empty table writes no
    archive and returns no row; other columns of the table do not matter.
    """
    back = read_bundles(archive(table(spark, sf_dir, "pages")))
    return back.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest, body FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM g
"""
