"""Streams of feedback, files and events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sessions import rating

FEEDBACK = (
    "feedback_id string, query string, rating string, answer string, comment string, correct_answer string, correct_source_ids array<string>, "
    "retrieved_source_ids array<string>, user_id string, tenant_id string, session_id string, trace_id string, created_at timestamp"
)


def feedback_stream(spark: SparkSession, path: str, watermark: str = "1 hour") -> DataFrame:
    """Feedback appended as JSON lines, ratings normalised, one row per feedback_id within the watermark."""
    raw = spark.readStream.schema(FEEDBACK).json(path)
    return raw.withColumn("rating", rating(F.col("rating"))).withWatermark("created_at", watermark).dropDuplicatesWithinWatermark(["feedback_id"])


def rating_windows(feedback: DataFrame, width: str = "1 day") -> DataFrame:
    """Counts per window, tenant and rating; late rows within the watermark still count."""
    return feedback.groupBy(F.window("created_at", width).alias("w"), "tenant_id", "rating").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "tenant_id", "rating", "n")


def index_stream(spark: SparkSession, path: str, checkpoint: str, handle: Callable[[DataFrame, int], None], glob: str = "*"):
    """New files below path to handle(batch, epoch) once each; starts and returns the query, which ends when all files are read."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, width: str = "1 day", watermark: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) of tumbling windows over events (ts, event_type, value), batch or stream."""
    # a watermark needs an instant; times without a zone are taken in the session's
    kept = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark) if events.isStreaming else events
    counted = kept.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 10000).cast("bigint")).alias("t"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n", F.round(F.col("t") / 10000, 4).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, end, n) of sessions that a pause of gap ends."""
    s = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
