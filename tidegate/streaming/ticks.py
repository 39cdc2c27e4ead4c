"""Early alerts of a stream: the panes of a running window as keyed state, evaluated again with every batch.

The state of a (key, window) is its table of pane counters, a fixed number of rows. Each batch adds its packets to
their panes, late ones too as long as the watermark lets them in, and the sums along the panes are evaluated anew: at
once when the rule fires first, and again if late packets move the first pane, a row goes out. An event timer ends the
window: it gives the final row and drops the state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from tidegate.operators.ticks import micros, placed
from tidegate.sources.packages import ship

#: What ``fires`` gets: for each sum its running values, one for each pane of a window; it returns a flag for each.
Fires = Callable[[dict[str, np.ndarray]], np.ndarray]


class PaneProcessor(StatefulProcessor):
    def __init__(self, sums: tuple[str, ...], window_us: int, pane_us: int, fires: Fires):
        self.sums, self.window_us, self.pane_us, self.fires = sums, window_us, pane_us, fires

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.panes = handle.getValueState("panes", StructType([StructField("counts", BinaryType())]))
        self.latch = handle.getValueState("latch", StructType([StructField("pane", LongType())]))

    def _counts(self) -> np.ndarray:
        shape = (self.window_us // self.pane_us, len(self.sums))
        return np.frombuffer(self.panes.get()[0], np.int64).reshape(shape).copy() if self.panes.exists() else np.zeros(shape, np.int64)

    def _first(self, counts: np.ndarray) -> tuple[int, np.ndarray] | None:
        upto = counts.cumsum(0)
        # Panes without packets of their own are no ticks.
        hit = np.flatnonzero(self.fires({k: upto[:, i] for i, k in enumerate(self.sums)}) & counts.any(1))
        return (int(hit[0]), upto[hit[0]]) if len(hit) else None

    def _row(self, key: tuple, found: tuple[int, np.ndarray] | None, final: bool) -> pd.DataFrame:
        *names, win = key
        row = dict(enumerate(names)) | {"win": win, "pane": None if found is None else win + found[0] * self.pane_us} | {k: 0 if found is None else int(found[1][i]) for i, k in enumerate(self.sums)} | {"final": final}
        return pd.DataFrame({k: [v] for k, v in row.items()}).astype({"pane": "Int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        counts, new = self._counts(), not self.panes.exists()
        for batch in rows:
            at = ((batch["pane"].to_numpy(np.int64) - key[-1]) // self.pane_us).astype(np.int64)
            for i, k in enumerate(self.sums):
                np.add.at(counts[:, i], at, batch[k].to_numpy(np.int64))
        self.panes.update((counts.tobytes(),))
        if new:
            self.handle.registerTimer((key[-1] + self.window_us) // 1000)
        found = self._first(counts)
        pane = -1 if found is None else found[0]
        if pane != (self.latch.get()[0] if self.latch.exists() else -1):
            self.latch.update((pane,))
            yield self._row(key, found, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._row(key, self._first(self._counts()), True)
        self.panes.clear()
        self.latch.clear()

    def close(self) -> None:
        pass


def early_alerts(rows: DataFrame, window: str, pane: str, sums: dict, fires: Fires, keys: tuple[str, ...] = (), ts: str = "ts") -> DataFrame:
    """Of a stream with a watermark on ``ts``: keys, win, pane (first at which the rule fires, or null), the sums then, final.

    Rows that are not final come as soon as a batch shows a first pane, or another one; for each window one row is final.
    """
    spark = rows.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    narrow = placed(rows, window, pane, ts).select(ts, *keys, "win", "pane", *[v.cast("long").alias(k) for k, v in sums.items()])
    kinds = dict(narrow.dtypes)
    names = {k: f"key_{i}" for i, k in enumerate(keys)}
    out = ", ".join([*(f"`{i}` {kinds[k]}" for i, k in enumerate(names)), "win long, pane long", *(f"{k} long" for k in sums), "final boolean"])
    processor = PaneProcessor(tuple(sums), micros(window), micros(pane), fires)
    found = narrow.groupBy(*keys, "win").transformWithStateInPandas(processor, out, "Update", "EventTime")
    return found.select(*[F.col(f"`{i}`").alias(k) for i, k in enumerate(keys)], "win", "pane", *sums, "final")
