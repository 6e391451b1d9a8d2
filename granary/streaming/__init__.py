"""Streaming form of the sessions operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions_by_gap(events: DataFrame, camera: str, time: str, minutes: int, late: str = "1 day") -> DataFrame:
    """(camera, begin, n) of sessions that close after a gap; a gap of exactly so many minutes stays, as in a batch."""
    gap = F.session_window(time, f"{minutes * 60} seconds 1 microsecond")
    return events.withWatermark(time, late).groupBy(F.col(camera), gap.alias("w")).agg(F.count("*").alias("n")).select(camera, F.col("w.start").alias("begin"), "n")
