"""Structured Streaming form of the daily activity operators (Q02, Q24).

Sessions arrive as ``events`` files.  Daily active users must be exact, and a
streaming ``count(distinct)`` is not supported, so activity is aggregated in two
chained event-time stages: first one row per (day, viewer) with its sessions
and minutes, then per day the number of those rows (= distinct viewers) and
their sums.  Both stages are windowed on event time behind a watermark, so
state for a day is dropped once the watermark passes it and late rows beyond
the delay are discarded.  Output is append-only: a day is emitted once, final.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.bindings import bind_events

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


def read_event_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(EVENTS_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def _event_time(sessions: DataFrame) -> DataFrame:
    """Watermarks need TIMESTAMP: the wall-clock watch time is read in the session
    zone (UTC in this library), so 1-day windows are calendar days."""
    return sessions.withColumn("event_time", F.col("watch_time").cast("timestamp"))


def daily_activity(sessions: DataFrame, delay: str = "1 day") -> DataFrame:
    """Per day: exact distinct viewers, sessions and hours (streaming or batch input)."""
    per_viewer = (_event_time(sessions).withWatermark("event_time", delay)
                  .groupBy(F.window("event_time", "1 day").alias("day"), "user_id")
                  .agg(F.count(F.lit(1)).alias("sessions"), F.sum("watch_duration").alias("minutes")))
    per_day = (per_viewer.groupBy(F.window(F.window_time("day"), "1 day").alias("w"))
               .agg(F.count(F.lit(1)).alias("dau"), F.sum("sessions").alias("sessions"),
                    F.sum("minutes").alias("minutes")))
    return per_day.select(F.to_date(F.col("w.start").cast("timestamp_ntz")).alias("watch_date"), "dau", "sessions",
                          (F.col("minutes").cast("double") / 60.0).alias("watch_hours"))


def hourly_sessions(sessions: DataFrame, delay: str = "1 day") -> DataFrame:
    """Per clock hour window: sessions and hours (the streaming Q24 input, per day)."""
    return (_event_time(sessions).withWatermark("event_time", delay)
            .groupBy(F.window("event_time", "1 hour").alias("w"))
            .agg(F.count(F.lit(1)).alias("sessions"), F.sum("watch_duration").alias("minutes"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("hour_start"), "sessions",
                    (F.col("minutes").cast("double") / 60.0).alias("watch_hours")))


def run_daily_activity(spark: SparkSession, events_path: str, out_path: str, checkpoint_path: str,
                       delay: str = "1 day", available_now: bool = True):
    """Start the daily activity stream: event files -> Parquet, with a checkpoint for recovery.

    With ``available_now`` the query processes what is present and stops (restart
    resumes from the checkpoint).  Returns the StreamingQuery.
    """
    stream = daily_activity(bind_events(read_event_stream(spark, events_path)), delay)
    writer = (stream.writeStream.format("parquet").outputMode("append")
              .option("path", out_path).option("checkpointLocation", checkpoint_path))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
