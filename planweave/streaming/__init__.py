"""Streaming helpers: watermarked windows and deduplication, and change data capture (see cdc)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_time(df: DataFrame, column: str) -> DataFrame:
    """The column as a timestamp with time zone, which watermarks need."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def tumbling(df: DataFrame, time: str, width: str, late: str, *keys: str, slide: str | None = None):
    """Grouped by windows of event time; rows later than the watermark are dropped from state."""
    return event_time(df, time).withWatermark(time, late).groupBy(F.window(time, width, slide), *keys)


def sessions(df: DataFrame, time: str, gap: str, late: str, *keys: str):
    return event_time(df, time).withWatermark(time, late).groupBy(F.session_window(time, gap), *keys)


def dedup_within(df: DataFrame, time: str, late: str, *keys: str) -> DataFrame:
    """The first row of each key as long as its watermark lasts, so that state stays bounded."""
    return event_time(df, time).withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))
