"""Structured Streaming: quotas, sessions, duplicates, overlapping windows, stitched transcripts.

Each operator is one function of a DataFrame, so the batch result and the stream's agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LATE = "1 hour"


def read_events(spark: SparkSession, folder: str, schema, pattern: str = "events.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def watermarked(df: DataFrame, at: str = "ts", late: str = LATE) -> DataFrame:
    return df.withWatermark(at, late)


def quota(df: DataFrame, key: str = "user_id", at: str = "ts", width: str = "1 hour", cap: int = 3) -> DataFrame:
    """key, start, n, over: fixed windows and whether they exceed the cap."""
    n = df.groupBy(key, F.window(at, width).alias("w")).agg(F.count("*").alias("n"))
    return n.select(key, F.col("w.start").alias("start"), "n", (F.col("n") > cap).alias("over"))


def user_sessions(df: DataFrame, key: str = "user_id", at: str = "ts", gap: str = "60 minutes") -> DataFrame:
    """key, start, end, n of activity without a pause longer than the gap."""
    s = df.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def overlapping(df: DataFrame, at: str = "ts", width: str = "600 seconds", step: str = "598 seconds") -> DataFrame:
    """start, n of windows that overlap by two seconds."""
    w = df.groupBy(F.window(at, width, step).alias("w")).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), "n")


def owned_window(start, end, width: float = 600.0, step: float = 598.0):
    """The number of the window that holds a word's midpoint: each word belongs to one window."""
    return F.floor((start + end) / 2 / step).cast("long")


def first_of_each(df: DataFrame, key: str, at: str = "ts", late: str = LATE) -> DataFrame:
    """One row a key; on a stream the state of a key ends with the watermark."""
    return df.withWatermark(at, late).dropDuplicatesWithinWatermark([key]) if df.isStreaming else df.dropDuplicates([key])


STITCH_OUT = "key string, part long, text string"
STITCH_STATE = "tail string, parts long"


def stitch_words(tail: list[str], new: list[str], look: int = 70) -> list[str]:
    """The words of `new` that come after what `tail` already says: after the last 3-gram that both
    have within `look` words of the seam; all of them if there is none."""
    end, place = tail[-look:], {}
    for i in range(min(len(new), look) - 2):
        place[tuple(new[i : i + 3])] = i
    for j in range(len(end) - 3, -1, -1):
        i = place.get(tuple(end[j : j + 3]))
        if i is not None:
            return new[i + 3 + (len(end) - 3 - j) :]
    return new


def _stitch(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    tail, parts = state.get if state.exists else ("", 0)
    rows = []
    for pdf in frames:
        for text in pdf.sort_values("part")["text"]:
            fresh = stitch_words(tail.split(), (text or "").split())
            rows.append((str(key[0]), parts, " ".join(fresh)))
            tail = " ".join((tail.split() + fresh)[-200:])
            parts += 1
    state.update((tail, parts))
    yield pd.DataFrame(rows, columns=["key", "part", "text"])


def stitched(df: DataFrame, key: str = "key") -> DataFrame:
    """key, part, text of overlapping transcript parts, each without what the part before said.

    A stateful operator: a key's state is its last 200 words, however long the transcript."""
    return df.groupBy(key).applyInPandasWithState(_stitch, STITCH_OUT, STITCH_STATE, "append", "NoTimeout")


def late_events(df: DataFrame, at: str, arrived: str, late_seconds: float = 3600.0) -> DataFrame:
    """Rows that a watermark of that width would drop: kept aside, never lost."""
    return df.filter(F.col(arrived).cast("double") - F.col(at).cast("double") > late_seconds)
