"""Streams: statements from arriving files, and event windows with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import sql_type
from ..operators.scanner import scan_files


def arriving_statements(spark: SparkSession, path: str) -> DataFrame:
    """Typed statements of each new source file in a folder; scanning and typing are stateless, so they run unchanged."""
    files = spark.readStream.schema("value string").option("wholetext", True).format("text").load(path).select(F.col("_metadata.file_path").alias("file_id"), F.col("value").alias("content"))
    return scan_files(files, "sql").withColumn("sql_type", sql_type(F.col("raw")))


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events and their values by type and window; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a user's events, closed by a gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), "user_id", "n")
