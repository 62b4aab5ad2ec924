"""Streams of timings, logs and incremental extracts.

State is bounded by watermarks: sums per window and deduplication keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timings(records: DataFrame, delay: str = "10 minutes", window: str = "1 hour", floor: float = 0.001) -> DataFrame:
    """Seconds per window, session and component; records at or below the floor are dropped."""
    kept = records.where(F.col("seconds") > floor).withWatermark("ts", delay)
    return kept.groupBy(F.window("ts", window).alias("w"), "session", "component").agg(F.sum("seconds").alias("seconds")).select(F.col("w.start").alias("start"), "session", "component", "seconds")


def log_counts(records: DataFrame, delay: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Records per window and level; later records than the watermark are dropped (and counted in the progress)."""
    counted = records.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), "level").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), "level", "n")


def session_timings(records: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Seconds per burst of a session's activity."""
    kept = records.withWatermark("ts", delay)
    return kept.groupBy(F.session_window("ts", gap).alias("w"), "session").agg(F.sum("seconds").alias("seconds")).select(F.col("w.start").alias("start"), "session", "seconds")


def fresh_primitives(extracts: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first arrival of every (type, id); repeats inside the watermark go."""
    return extracts.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["type", "id"])


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into a Parquet table and read it; restarts go on from the checkpoint."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
