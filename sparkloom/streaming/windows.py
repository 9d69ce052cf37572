"""Sliding-window labels over a stream of events (an extension; batch windows start at each time line's own zero, these at the epoch)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_counts(events: DataFrame, *, time: str = "ts", keys: tuple[str, ...] = ("event_type",), size: str = "30 seconds", step: str = "15 seconds", late: str = "1 minute") -> DataFrame:
    """Events and their summed value in sliding windows, with a watermark that bounds the state."""
    return (
        events.withWatermark(time, late)
        .groupBy(F.window(time, size, step).alias("w"), *keys)
        .agg(F.count("*").alias("n"), F.sum("value").alias("value"))
        .select(F.col("w.start").alias("t_start"), F.col("w.end").alias("t_end"), *keys, "n", "value")
    )


def first_of_id(events: DataFrame, identifier: str, *, time: str = "ts", late: str = "1 minute") -> DataFrame:
    """Each id once within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([identifier])
