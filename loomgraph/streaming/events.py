"""Streams of events: keyed deduplication and windowed counts, usable on a batch or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A parquet folder as a stream; its schema is read once from the files."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def unique_events(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Each event_id once; on a stream the state of an id is dropped once the watermark has passed it."""
    if events.isStreaming:
        return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])


def window_counts(events: DataFrame, width: str = "1 day", lateness: str | None = None) -> DataFrame:
    """Events and the sum of values (in hundredths) a window and type; lateness sets a watermark where none is set."""
    rows = events.withWatermark("ts", lateness) if lateness and events.isStreaming else events
    cents = F.round(F.col("value") * 100).cast("long")
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(
        F.count("*").alias("n_events"), F.sum(cents).alias("cents")).select(
        F.col("w.start").alias("window_start"), "event_type", "n_events", "cents")
