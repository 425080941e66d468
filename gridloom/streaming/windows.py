"""Windowed statistics over streams of time and cell rows. The plans are the same for batch tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import nan


def windowed(df: DataFrame, cells: Sequence[str], items: Sequence[str], *, size: str, slide: str | None = None, lateness: str = "1 hour", how: str = "nanmean", time: str = "time") -> DataFrame:
    """An aggregate of every item for each window and cell. Rows later than ``lateness`` are left out of a stream."""
    stamped = df.withColumn("_time", F.col(time).cast("timestamp"))
    if df.isStreaming:
        stamped = stamped.withWatermark("_time", lateness)
    agg = nan.AGGREGATES[how]
    grouped = stamped.groupBy(F.window("_time", size, slide), *cells).agg(*(agg(F.col(i)).alias(i) for i in items))
    return grouped.select(F.col("window.start").cast("timestamp_ntz").alias("start"), *cells, *items)


def without_repeats(df: DataFrame, keys: Sequence[str], *, lateness: str = "1 hour", time: str = "time") -> DataFrame:
    """The first row of each key; state is dropped once the watermark has passed."""
    if not df.isStreaming:
        return df.dropDuplicates(list(keys))
    stamped = df.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", lateness)
    return stamped.dropDuplicatesWithinWatermark(list(keys)).drop("_time")
