"""Telemetry as a stream: windowed peaks, sessions and latest status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def telemetry(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The events of a folder of Parquet files, as they arrive, with a zoned time."""
    reader = spark.readStream.schema(EVENTS)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_peaks(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Count and peak of each gpu in tumbling or sliding windows; rows later than ``late`` are dropped by the watermark."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    grouped = events.withWatermark("ts", late).groupBy(window.alias("w"), (F.col("user_id") % 2).alias("gpu"))
    return grouped.agg(F.count("*").alias("samples"), F.max("value").alias("peak")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "gpu", "samples", "peak")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of each user: events no further apart than the gap."""
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return grouped.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_to_table(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Drain what has arrived into a Parquet table, exactly once, and stop."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
