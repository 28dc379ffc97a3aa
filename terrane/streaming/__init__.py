"""Streams of events; an extension of the panel operators for data that still arrives."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    """The table as a stream of files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet").parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """window_start, event_type, events, total in event time; state older than the watermark is dropped."""
    window = F.window("ts", length)
    found = events.withWatermark("ts", late).groupBy(window, "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return found.select(F.col("window.start").alias("window_start"), "event_type", "events", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, started, ended, events: runs of a user's events with no gap."""
    window = F.session_window("ts", gap)
    found = events.withWatermark("ts", late).groupBy(window, "user_id").agg(F.count("*").alias("events"))
    return found.select("user_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "events")


def drained(stream: DataFrame, base: str) -> DataFrame:
    """What a stream has finished over all that is there now, through a file sink under base (a shared folder).

    Append mode: a window or session is written once, when the watermark has passed its end, and its state is dropped then; those
    that are still open stay in the checkpoint for the next run.
    """
    path = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out")
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")
