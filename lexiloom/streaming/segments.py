"""Streaming forms of the interval operators (events: ts, key, label, value)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def new_utterances(spark: SparkSession, root: str, files_at_once: int = 1000) -> DataFrame:
    """path, speaker (the folder), text of transcripts as they arrive below a folder; each file is read once."""
    lines = spark.readStream.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_at_once)
    rows = lines.option("pathGlobFilter", "*.{lab,txt}").text(root, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    return rows.select("path", F.element_at(F.split("path", "/"), -2).alias("speaker"), F.trim(F.regexp_replace("value", r"\s+", " ")).alias("text"))


def window_counts(events: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """start, label, n, total of each tumbling window; rows later than ``late`` are left out."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width), "label")
    return rows.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "label", "n", "total")


def sessions(events: DataFrame, pause: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """key, begin, end, n of stretches without a pause: a new one starts when the gap is over the pause."""
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", pause).alias("s"), "key")
    return rows.agg(F.count("*").alias("n")).select("key", F.col("s.start").alias("begin"), F.col("s.end").alias("end"), "n")


def active_segments(events: DataFrame, on: float, off: float) -> DataFrame:
    """key, begin, end, n of active stretches: over ``on`` starts one, under ``off`` ends it.

    State of a key: the open stretch (begin, last, n). A closed stretch is emitted with the batch that
    closes it. Rows of a batch are taken in order of time.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        begin, last, n = state.get if state.exists else (None, None, 0)
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        out = []
        for ts, value in zip(rows["ts"], rows["value"], strict=True):
            if n and value < off:
                out.append((key[0], pd.Timestamp(begin), pd.Timestamp(last), n))
                begin, last, n = None, None, 0
            elif n or value > on:
                begin, last, n = (begin if n else ts.value), ts.value, n + 1
        if n:
            state.update((begin, last, n))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["key", "begin", "end", "n"])

    return events.groupBy("key").applyInPandasWithState(
        update, "key long, begin timestamp, end timestamp, n long", "begin long, last long, n long", "append", GroupStateTimeout.NoTimeout
    )
