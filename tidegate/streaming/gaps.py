"""Gaps between detections as keyed state: the last detection of each sensor is kept from batch to batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from tidegate.sources.packages import ship


class GapProcessor(StatefulProcessor):
    """State: the time of a sensor's last detection. Detections of a batch are put in order; those of later batches are later."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", StructType([StructField("at_us", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at = np.sort(np.concatenate([b["at_us"].to_numpy(np.int64) for b in rows]))
        known = self.last.exists()
        before = np.concatenate(([self.last.get()[0] if known else 0], at[:-1]))
        self.last.update((int(at[-1]),))
        gap = pd.Series(at - before, dtype="Int64")
        if not known:
            gap.iloc[0] = pd.NA
        yield pd.DataFrame({"sensor": key[0], "at_us": at, "gap_us": gap})

    def close(self) -> None:
        pass


def detection_gaps(detections: DataFrame) -> DataFrame:
    """sensor, at_us, gap_us (null for a sensor's first) of a stream of detections (sensor, at_us) whose batches are in order of time, as closed windows are."""
    spark = detections.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = dict(detections.dtypes)["sensor"]
    return detections.select("sensor", "at_us", *[x for x in detections.columns if x not in ("sensor", "at_us")]).groupBy("sensor").transformWithStateInPandas(GapProcessor(), f"sensor {kind}, at_us long, gap_us long", "Append", "None")
