"""Structured Streaming over event files: windowed aggregates with watermarks, sessions and incremental days."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, path: str, max_files: int = 16) -> DataFrame:
    """A stream of event files."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", max_files).parquet(path)


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type; rows later than the watermark are left out."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions by user: bursts of events with less than a gap between them."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def run_available(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Processes what is there and stops: a batch job that remembers what it has done."""
    return df.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def gate(spark: SparkSession, manifest: str, day: str, done: DataFrame | None = None) -> bool:
    """Whether a day may run: its manifest row is published and no done marker is there."""
    ready = not spark.read.json(manifest).where((F.col("trade_date") == day) & (F.col("status") == "published")).isEmpty()
    return ready and (done is None or done.where(F.col("trade_date") == day).isEmpty())
