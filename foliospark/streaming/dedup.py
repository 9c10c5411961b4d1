"""Streams of uploads and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_deliveries(uploads: DataFrame, time: str = "ingested_at", key: str = "upload_id", within: str = "30 days") -> DataFrame:
    """Uploads without redelivered rows; state older than ``within`` is dropped."""
    return uploads.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def windowed(events: DataFrame, time: str, by: str, value: str, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of a stream by window and key, late rows within ``late``."""
    return events.withWatermark(time, late).groupBy(F.window(time, length), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")
