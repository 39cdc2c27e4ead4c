"""Evaluation inside a running window: panes, sums over a window's panes so far, and the first pane at which a rule fires.

A window (seconds to minutes) is cut into panes (ticks). Packets are aggregated to panes, partially in each task, and
only panes are summed up along their window: a fixed number of rows for each key and window, whatever the traffic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def micros(length: str) -> int:
    """Microseconds of a length like '100 milliseconds'."""
    units = {"millisecond": 1000, "second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 86400 * 10**6}
    number, unit = length.split()
    return int(number) * units[unit.rstrip("s")]


def placed(rows: DataFrame, window: str, pane: str, ts: str = "ts") -> DataFrame:
    """Rows with win, the start of their window, and pane, the start of their pane (microseconds)."""
    if micros(window) % micros(pane):
        raise ValueError("a window is a whole number of panes")
    at = F.unix_micros(c(ts).cast("timestamp"))
    return rows.withColumns({"win": at - F.pmod(at, F.lit(micros(window))), "pane": at - F.pmod(at, F.lit(micros(pane)))})


def running_panes(rows: DataFrame, window: str, pane: str, sums: dict[str, Column], keys: tuple[str, ...] = (), ts: str = "ts") -> DataFrame:
    """keys, win, pane and each sum over the window up to and with the pane."""
    panes = placed(rows, window, pane, ts).groupBy(*keys, "win", "pane").agg(*[F.sum(v).alias(k) for k, v in sums.items()])
    upto = Window.partitionBy(*keys, "win").orderBy("pane")
    return panes.select(*keys, "win", "pane", *[F.sum(k).over(upto).alias(k) for k in sums])


def first_crossing(rows: DataFrame, window: str, pane: str, sums: dict[str, Column], fires: Column, keys: tuple[str, ...] = (), ts: str = "ts") -> DataFrame:
    """For each window in which the rule fires at the end of a pane: keys, win, pane (the first such) and the sums then.

    ``fires`` is a condition over the sums. Windows in which it never holds are left out.
    """
    held = running_panes(rows, window, pane, sums, keys, ts).where(fires)
    first = held.groupBy(*keys, "win").agg(F.min_by(F.struct("pane", *sums), "pane").alias("first"))
    return first.select(*keys, "win", "first.pane", *[f"first.{k}" for k in sums])
