"""Entities that are active while they are seen: session windows in a stream, and the same result in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, ts: str, gap: str, *, late: str = "0 seconds") -> DataFrame:
    """key, first, last_end, n: an entity stays active until nothing is seen of it for the gap. Streams emit a session once
    the watermark has passed it; later rows are dropped by it; streaming.epochs refuses them instead."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("first"), F.col("session_window.end").alias("last_end"), "n")


def spaced(events: DataFrame, key: str, ts: str, seconds: float) -> DataFrame:
    """Batch form of the input gate: rows whose stamp is at least so much after the one before them."""
    before = F.lag(ts).over(Window.partitionBy(key).orderBy(ts))
    return events.withColumn("_before", before).where(F.col("_before").isNull() | (F.col(ts).cast("double") - F.col("_before").cast("double") >= seconds)).drop("_before")
