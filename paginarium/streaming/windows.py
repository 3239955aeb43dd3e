"""Windowed counts and first-seen documents, on tables and on streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def counted(events: DataFrame, minutes: int = 5, late: str | None = None) -> DataFrame:
    """(window_start, event_type, n) in tumbling windows; ``late`` bounds the lateness of a stream."""
    at = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        at = at.withWatermark("ts", late)
    grouped = at.groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.unix_timestamp("w.start").alias("window_start"), "event_type", "n")


def stream_of(spark: SparkSession, folder: str, like: DataFrame, files_per_trigger: int = 1) -> DataFrame:
    """The Parquet files that arrive in a folder."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def first_seen(documents: DataFrame, time: str, late: str) -> DataFrame:
    """A stream's documents without those whose bytes came before, within the watermark."""
    hashed = documents.withColumn("sha256", F.sha2("text", 256)).withWatermark(time, late)
    return hashed.dropDuplicatesWithinWatermark(["sha256"])
