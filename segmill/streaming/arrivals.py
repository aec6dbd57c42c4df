"""Incremental arrival of per-creator files with Structured Streaming.

The batch operators have no streaming counterpart to match; this runs the parts that fit a stream:
new files are read once, repeated segments are dropped within a watermark, and baselines or claims
are kept up to date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arrivals(spark: SparkSession, path: str, ddl: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_seen(stream: DataFrame, key: str = "segment_id", at: str = "extracted_at", delay: str = "2 hours") -> DataFrame:
    """Rows whose key did not come before within the watermark."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def heartbeats(stream: DataFrame, at: str = "ts", by: str = "creator_id", delay: str = "2 hours", window: str = "1 hour") -> DataFrame:
    """Heartbeats and events in windows of event time, late ones up to the delay."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, window), by).agg(F.count(F.lit(1)).alias("n"), F.max(at).alias("last_seen"))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """All that has arrived, then stop; running it again takes up what came since."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
