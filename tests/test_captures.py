"""Capture files of both byte orders and units of time, cut files, foreign files, and captures as a stream."""

import struct

import pytest
from pyspark.sql import functions as F

from tidegate.sources import frames as N
from tidegate.sources.storage import scratch
from tidegate.sources.tables import packets, table

SF = "/root/testdata/sf0.001"


def capture(order, magic, records, cut=0):
    data = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 1) + b"".join(struct.pack(order + "IIII", s, part, len(f), size) + f for s, part, size, f in records)
    return data[: len(data) - cut]


RECORDS = [(1_700_000_000 + i, 123_456 if i % 2 else 999_999_001 % 1_000_000, 60 + i, bytes([i % 256]) * (i % 90)) for i in range(20_000)]


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize(("magic", "unit"), [(N.PCAP_MAGIC, 1), (N.PCAP_MAGIC_NS, 1000)])
def test_kinds_of_files(spark, tmp_path, order, magic, unit):
    (tmp_path / "a.pcap").write_bytes(capture(order, magic, RECORDS))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.pcap").write_bytes(capture(order, magic, RECORDS[:3], cut=1))
    (tmp_path / "c.pcap").write_bytes(capture(order, magic, RECORDS[:4], cut=len(RECORDS[3][3]) + 7))
    (tmp_path / "d.pcap").write_bytes(capture(order, magic, []))
    (tmp_path / "_e.pcap").write_bytes(b"unfinished")
    rows = N.read_captures(spark, f"file://{tmp_path}")
    got = sorted((r["us"], r["ns"], r["pkt_len"], bytes(r["frame"])) for r in rows.collect())
    want = [(s * 1_000_000 + part // unit, part % unit, size, f) for s, part, size, f in [*RECORDS, *RECORDS[:2], *RECORDS[:3]]]
    assert got == sorted(want) and rows.rdd.getNumPartitions() == 4


def test_foreign_and_no_files(spark, tmp_path):
    assert N.read_captures(spark, f"file://{tmp_path}").count() == 0
    (tmp_path / "x.pcap").write_bytes(b"no capture at all, but long enough")
    with pytest.raises(Exception, match="no capture file"):
        N.read_captures(spark, f"file://{tmp_path}").count()


def test_stream_of_captures(spark):
    folder, out, state = (scratch(spark, f"test-cap-{x}") for x in ("in", "out", "state"))
    rows = packets(spark, SF)
    write = lambda part, cond: N.write_captures(N.pack_frames(rows.where(cond)).coalesce(2), f"{folder}/{part}").write.format("noop").mode("overwrite").save()
    write("one", "pkt_id % 2 = 0")
    seen = []
    for more in (lambda: None, lambda: write("two", "pkt_id % 2 = 1"), lambda: None):
        more()
        stream = N.decode_frames(N.stream_captures(spark, folder)).select("us", "src_ip", "proto", "ttl", "pkt_len")
        stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
        seen.append(spark.read.parquet(out).count())
    events = table(spark, SF, "events").count()
    assert seen == [rows.where("pkt_id % 2 = 0").count(), events, events]
    back = spark.read.parquet(out)
    assert back.exceptAll(rows.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "src_ip", "proto", N.time_to_live().cast("int").alias("ttl"), "pkt_len")).count() == 0
