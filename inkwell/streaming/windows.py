"""Structured Streaming over events, beyond what the batch library needs: the same transformation serves a stream and a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LATE, WIDTH = "10 minutes", "1 hour"


def hourly(events: DataFrame) -> DataFrame:
    """Events and their value by hour and type; on a stream, those later than the watermark are dropped."""
    marked = events.withWatermark("ts", LATE) if events.isStreaming else events
    out = marked.groupBy(F.window("ts", WIDTH).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return out.select(F.col("w.start").alias("hour"), "event_type", "n", F.round("value", 4).alias("value"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Runs of a user's events with no gap longer than that."""
    marked = events.withWatermark("ts", LATE) if events.isStreaming else events
    out = marked.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("s.start").alias("begin"), F.col("s.end").alias("end"), "n")


def stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of Parquet files."""
    return spark.readStream.schema(schema).parquet(path)
