"""QUIC payloads: header checks as column functions, and the scan of acknowledgement frames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.operators.series import split_lag
from tidegate.sources.packages import ship

LONG_HEADER, FIXED_BIT, ACK_FRAME = 0x80, 0x40, 0x02


def byte_at(payload: Column, i: int) -> Column:
    """A byte (0 to 255) of a binary column, null beyond its end."""
    return F.conv(F.hex(F.substring(payload, i + 1, 1)), 16, 10).try_cast("int")


def header_kind(payload: Column) -> Column:
    first = F.coalesce(byte_at(payload, 0), F.lit(0))
    return F.when(first.bitwiseAND(FIXED_BIT) == 0, "none").when(first.bitwiseAND(LONG_HEADER) != 0, "long").otherwise("short")


def is_valid(payload: Column) -> Column:
    """The fixed bit is set, and a long header has version 1 or a draft's."""
    version = F.hex(F.substring(payload, 2, 4))
    return (header_kind(payload) == "short") | ((header_kind(payload) == "long") & ((version == "00000001") | F.startswith(version, F.lit("FF0000"))))


def with_sample_payload(packets: DataFrame, frames: Column | int = 1) -> DataFrame:
    """Packets with a QUIC payload made from their fields: by pkt_id a long header, a short one or none, then so many
    acknowledgements of pkt_id as a four-byte number."""
    number = F.lpad(F.hex((F.col("pkt_id") + 0x80000000).cast("long")), 8, "0")
    frame = F.repeat(F.concat(F.lit("02"), number, F.lit("00" * 6)), F.lit(frames) if isinstance(frames, int) else frames)
    long = F.concat(F.lit("C00000000108"), F.lit("11" * 8), F.lit("00" * 6), frame)
    short = F.concat(F.lit("40"), F.lit("11" * 8), F.lit("00" * 4), frame)
    kind = F.col("pkt_id") % 3
    return packets.withColumn("payload", F.unhex(F.when(kind == 0, long).when(kind == 1, short).otherwise(F.lit("00" * 12))))


def scan_acks(payload: bytes) -> tuple[int, int | None]:
    """Acknowledgement frames after the header and the largest number that they acknowledge.

    The number is a variable-length integer (1, 2, 4 or 8 bytes); bytes that are no frame are passed over.
    """
    if len(payload) < 2 or not payload[0] & FIXED_BIT:
        return 0, None
    at = 20 if payload[0] & LONG_HEADER else 13
    found, largest = 0, None
    while at + 1 < len(payload):
        if payload[at] != ACK_FRAME:
            at += 1
            continue
        size = 1 << (payload[at + 1] >> 6)
        raw = payload[at + 1 : at + 1 + size]
        if len(raw) < size:
            break
        value = int.from_bytes(raw, "big") & ((1 << (8 * size - 2)) - 1)
        found, largest = found + 1, value if largest is None else max(largest, value)
        at += 1 + size
    return found, largest


def ack_frames(rows: DataFrame, keep: tuple[str, ...] = ("pkt_id",)) -> DataFrame:
    """The columns to keep, acks and largest of each payload; a scan from byte to byte, by Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [scan_acks(x or b"") for x in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array([n for n, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], [*keep, "acks", "largest"])

    ship(rows.sparkSession)
    kinds = dict(rows.dtypes)
    return rows.select(*keep, "payload").mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keep), "acks long", "largest long"]))


def acknowledgements(rows: DataFrame) -> DataFrame:
    """pkt_id, ts, src_ip and largest (the greatest number acknowledged) of the packets whose payload acknowledges; ``rows`` has payload."""
    return ack_frames(rows, ("pkt_id", "ts", "src_ip")).where("acks > 0")


def acknowledged_jumps(rows: DataFrame) -> DataFrame:
    """pkt_id, ts, src_ip and jump: the largest number acknowledged less that of the source's acknowledgement before."""
    seen = split_lag(acknowledgements(rows), "src_ip", ("ts", "pkt_id"), "largest", F.date_trunc("day", "ts"), "before")
    return seen.select("pkt_id", "ts", "src_ip", (F.col("largest") - F.col("before")).alias("jump"))


def ack_bursts(acks: DataFrame, pane: str = "100 milliseconds", most: int = 100) -> DataFrame:
    """src_ip, pane (its start) and n for each pane in which a source acknowledges more than ``most`` times."""
    return acks.groupBy("src_ip", F.window("ts", pane).alias("p")).agg(F.count("*").alias("n")).where(F.col("n") > most).select("src_ip", F.col("p.start").alias("pane"), "n")
