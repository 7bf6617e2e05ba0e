"""Voice activity as a stream with event time: rows in any order up to a lateness, open stretches closed by a timer.

Needs the RocksDB state store (use_state_store). State of a key: the rows that the watermark hasn't passed yet, and the open stretch as three numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import ship_package

SEGMENTS = "key long, begin timestamp, end timestamp, n long, closed_by string"


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class ActivitySegments(StatefulProcessor):
    """Over ``on`` starts a stretch, under ``off`` ends it, and so does a pause of more than ``pause_ms`` after its last row.

    Rows wait until the watermark has passed them and are then taken in order of time, so the result doesn't depend on
    the order in which they come. A timer at the earliest waiting row, or at the end of the pause, wakes the key up where no row does. A key without waiting rows and without an open stretch
    keeps no state.
    """

    def __init__(self, on: float, off: float, pause_ms: int):
        self.on, self.off, self.pause = on, off, pause_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "begin long, last long, n long")
        self.waiting = handle.getListState("waiting", "ts long, value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = []
        for pdf in rows:
            pdf = pdf[pdf["ts"].notna() & pdf["value"].notna()]
            fresh += list(zip((pdf["ts"].astype("datetime64[us]").astype("int64") // 1000).tolist(), pdf["value"].tolist(), strict=True))
        yield self.advance(key, fresh, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self.advance(key, [], timerValues.getCurrentWatermarkInMs())

    def advance(self, key, fresh: list[tuple[int, float]], watermark: int) -> pd.DataFrame:
        """Takes in what the watermark has passed, and says when to wake up next."""
        held = (list(self.waiting.get()) if self.waiting.exists() else []) + fresh
        ready = sorted((ts, value) for ts, value in held if ts < watermark)
        later = [(ts, value) for ts, value in held if ts >= watermark]
        begin, last, n = self.open.get() if self.open.exists() else (0, 0, 0)
        out = []

        def close(by: str) -> None:
            nonlocal n
            out.append((key[0], pd.Timestamp(begin, unit="ms"), pd.Timestamp(last, unit="ms"), n, by))
            n = 0

        for ts, value in ready:
            if n and ts - last > self.pause:
                close("pause")
            if n and value < self.off:
                close("value")
            elif n or value > self.on:
                begin, last, n = (begin if n else ts), ts, n + 1
        if n and watermark - last > self.pause:  # no row up to the watermark can go on from here
            close("timer")
        self.waiting.put(later) if later else self.waiting.clear()
        self.open.update((begin, last, n)) if n else self.open.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        wake = [min(ts for ts, _ in later) + 1] if later else []
        wake += [last + self.pause + 1] if n else []
        if wake:
            self.handle.registerTimer(max(min(wake), watermark + 1))
        return pd.DataFrame(out, columns=["key", "begin", "end", "n", "closed_by"])

    def close(self) -> None:
        pass


def voice_segments(events: DataFrame, on: float, off: float, pause_ms: int, late: str = "10 minutes") -> DataFrame:
    """key, begin, end, n, closed_by (value, pause or timer) of the active stretches of a stream of key, ts, value.

    Rows that come later than ``late`` behind the latest time seen are left out by the watermark; the query's progress counts them
    (numRowsDroppedByWatermark). Rows without a time or a value count nowhere.
    """
    ship_package(events.sparkSession)
    rows = events.withWatermark("ts", late).groupBy("key")
    return rows.transformWithStateInPandas(ActivitySegments(on, off, pause_ms), SEGMENTS, "append", "EventTime")
