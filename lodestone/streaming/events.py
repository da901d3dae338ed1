"""Streams of events: windowed counts with late data, sessions, and request logs that feed the query statistics.

An extension: the engine's own inputs are tables. Every function takes and gives a streaming (or static) DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """start, event_type, n, total: tumbling windows, sliding ones with `slide`; events later than `late` are left out."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    grouped = events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, start, end, n of runs of events without a longer gap."""
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def first_of_each(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events without repeats of an event_id within the time that is waited for late data."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """All that is there, as Parquet; a later run goes on from the checkpoint."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
