"""Streams: people recognised as faces arrive, and counts per window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .people import recognised  # noqa: F401


def windowed_counts(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Events (ts, kind) per window and kind; rows later than `late` behind the newest are dropped."""
    over = F.window("ts", window, slide) if slide else F.window("ts", window)
    return events.withWatermark("ts", late).groupBy(over, "kind").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "kind", "n")
