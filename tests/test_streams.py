"""Streams over several batches: first times in any order, windows that close once, state that goes."""

import datetime

from pyspark.sql import functions as F

from tidegate.sources.storage import scratch
from tidegate.sources.tables import table
from tidegate.streaming import windows

SF = "/root/testdata/sf0.001"


def two_files(spark, first, second, **options):
    events = table(spark, SF, "events")
    path = scratch(spark, "two-in")
    for n, cond in enumerate((first, second)):
        events.where(cond).coalesce(1).write.parquet(f"{path}/part={n}")
    return windows.stream_of(spark, f"{path}/part=*", events.schema, maxFilesPerTrigger=1, **options)


def test_first_seen_takes_an_earlier_time_of_a_later_batch(spark):
    stream = two_files(spark, "ts >= TIMESTAMP '2024-01-15 00:00:00'", "ts < TIMESTAMP '2024-01-15 00:00:00'")
    got = {r["src_ip"]: r["first_us"] for r in windows.first_seen(stream, stream.rows, "src_ip", "test-first").collect()}
    from tidegate.sources.tables import packets

    want = {r["src_ip"]: r["us"] for r in packets(spark, SF).groupBy("src_ip").agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("us")).collect()}
    assert got == want


def test_windows_are_written_once_and_state_goes(spark):
    stream = two_files(spark, "ts < TIMESTAMP '2024-01-15 00:00:00'", "ts >= TIMESTAMP '2024-01-15 00:00:00'")
    rows = stream.rows.groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"))
    got = windows.run_available(stream, rows, "test-once").collect()
    assert len({r["w"]["start"] for r in got}) == len(got) == 30 and sum(r["n"] for r in got) == 1000
    assert all(r["w"]["start"] < datetime.datetime(2025, 1, 1) for r in got)
    assert [r["n"] for r in sorted(got, key=lambda r: r["w"]["start"])] == [r["count"] for r in table(spark, SF, "events").groupBy(F.date_trunc("day", "ts").alias("d")).count().orderBy("d").collect()]
