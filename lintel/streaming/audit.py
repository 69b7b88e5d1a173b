"""The audit log as a stream: tumbling, sliding and session counts, and a first-seen filter of contents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.functions.code import micros

HOUR, STEP, GAP = "1 hour", "30 minutes", "30 minutes"


def hourly(events: DataFrame, length: str = HOUR, slide: str | None = None) -> DataFrame:
    """Counts per window and event_type; works on a stream with a watermark as on a table."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = GAP) -> DataFrame:
    return events.groupBy(F.session_window("ts", gap).alias("w"), "event_type", "user_id").agg(F.count("*").alias("n"))


def windows(events: DataFrame) -> DataFrame:
    """All three kinds in one table: kind, event_type, start_us, n."""
    shaped = lambda rows, kind: rows.select(F.lit(kind).alias("kind"), "event_type", micros(F.col("w.start")).alias("start_us"), "n")
    return shaped(hourly(events), "hour").union(shaped(hourly(events, HOUR, STEP), "slide")).union(shaped(sessions(events), "session"))


def stream_windows(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """hourly() of a stream; rows later than delay are dropped."""
    return hourly(events.withWatermark("ts", delay))


def first_seen(texts: DataFrame, delay: str = "1 day") -> DataFrame:
    """Rows of a stream (ts, text) whose content hasn't been seen within delay: the incremental scan's filter."""
    return texts.withColumn("sha", F.sha2("text", 256)).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["sha"])


def running_counts(stream: DataFrame, path: str, checkpoint: str):
    """Append finished windows to a parquet folder; returns the query."""
    return stream_windows(stream).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).start()
