"""Structured Streaming forms of the windowed operators.

Packets are read as a file stream, aggregated by event time under a watermark and written batch by batch; every batch
writes a folder of its own, so that a batch that is run again replaces its own output and nothing else. Windows are
written once, when the watermark has passed them (append mode), and their state is dropped then. A stream that has
ended is closed by a last row in the far future (``close``), which moves the watermark past all windows.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.sources.storage import scratch
from tidegate.sources.tables import packets_of, table

#: The time of the row that ends a stream.
END = datetime.datetime(9000, 1, 1)


@dataclass
class PacketStream:
    """A stream of packets, and the folder in which a row ends it."""

    rows: DataFrame
    end: str
    schema: object = field(repr=False)

    def close(self) -> None:
        spark = self.rows.sparkSession
        last = spark.createDataFrame([tuple(END if f.name == "ts" else None for f in self.schema)], self.schema)
        last.coalesce(1).write.mode("append").parquet(self.end)


def stream_of(spark: SparkSession, path: str, schema, delay: str = "1 hour", **options) -> PacketStream:
    """Packets of the events under a path as a stream with event time ``ts`` and a watermark."""
    end = scratch(spark, "stream-end")
    spark.createDataFrame([], schema).write.parquet(end)
    events = spark.readStream.schema(schema).options(**options).parquet(path).union(spark.readStream.schema(schema).parquet(end))
    rows = packets_of(events).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return PacketStream(rows, end, schema)


def packet_stream(spark: SparkSession, sf_dir: str, delay: str = "1 hour") -> PacketStream:
    """The events table as a stream of packets."""
    return stream_of(spark, f"{sf_dir}/events.parque[t]", table(spark, sf_dir, "events").schema, delay)


def on_time(ts: str = "ts"):
    """Leaves out the row that ends the stream."""
    return F.col(ts) < F.lit(END)


def run_available(stream: PacketStream, df: DataFrame, name: str, mode: str = "append", then: Callable[[DataFrame], DataFrame] | None = None, feeds: Sequence[Callable[[], None]] = (), progress: list | None = None) -> DataFrame:
    """Run ``df``, made from the stream, over what is there; close the stream, run on from the checkpoint, and return what all batches wrote.

    ``feeds`` bring more rows, each before another run. In complete mode (for results of a fixed size) the last batch
    is returned. What the engine reports of its batches is added to ``progress``.
    """
    spark = df.sparkSession
    out, checkpoint = scratch(spark, f"{name}-out"), scratch(spark, f"{name}-state")

    def write(batch: DataFrame, number: int) -> None:
        (then(batch) if then else batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    for feed in (lambda: None, *feeds, stream.close):
        feed()
        running = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        running.awaitTermination()
        if progress is not None:
            progress.extend(running.recentProgress)
    # The folders tell the batches, not this process, which may have begun anew.
    done = spark.read.parquet(out)
    if mode == "complete":
        done = done.join(F.broadcast(done.agg(F.max("batch").alias("batch"))), "batch", "left_semi")
    return done.drop("batch")


def dropped_rows(progress: list) -> int:
    """Rows that came behind the watermark, as the engine counted them at its stateful operators."""
    return sum(int(op.numRowsDroppedByWatermark) for p in progress for op in p.stateOperators)


def first_seen(stream: PacketStream, rows: DataFrame, key: str, name: str, ts: str = "ts") -> DataFrame:
    """The first event time of each key over all batches, in whatever order they come: key, first_us.

    The state is one number for each key. A key is written anew when an earlier time comes in; the least is the result.
    """
    least = rows.where(on_time(ts)).groupBy(key).agg(F.min(F.unix_micros(ts)).alias("first_us"))
    return run_available(stream, least, name, "update").groupBy(key).agg(F.min("first_us").alias("first_us"))
