"""Streaming: link counts and activity of detections as they arrive, with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, time: str, late: str) -> DataFrame:
    """A stream with its watermark, on zoned timestamps; tables have no late rows."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events


def windowed_activity(events: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "1 hour", time: str = "ts", key: str = "user_id", value: str = "value") -> DataFrame:
    """(window_start, key, n, total) of tumbling or sliding windows; works on streams and on tables alike."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    out = _timed(events, time, late).groupBy(window.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), key, "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour", time: str = "ts", key: str = "user_id") -> DataFrame:
    """(session_start, session_end, key, n): runs of detections without a longer pause than gap."""
    out = _timed(events, time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, "n")
