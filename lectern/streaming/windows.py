"""Windowed counts over an event stream: an addition, for tables that arrive bit by bit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling(events: DataFrame, time: str, length: str, late: str, keys: list[str], value: str) -> DataFrame:
    """Counts and sums by window and key; rows later than ``late`` are left out, as the state has been given up by then."""
    w = F.window(time, length)
    return events.withWatermark(time, late).groupBy(w, *keys).agg(F.count("*").alias("n"), F.round(F.sum(value), 6).alias("total")).select(F.col("window.start").alias("window_start"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, late: str, keys: list[str]) -> DataFrame:
    w = F.session_window(time, gap)
    return events.withWatermark(time, late).groupBy(w, *keys).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *keys, "n")


def first_seen(events: DataFrame, time: str, late: str, keys: list[str]) -> DataFrame:
    """Rows without later copies of the same keys within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
