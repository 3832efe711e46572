"""Operating time and windows over the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from motorlake import config
from motorlake.operators.slots import stitched_sessions


def telemetry_1m(events: DataFrame, watermark: str | None = None) -> DataFrame:
    """Pings and mean readings per vehicle and minute; a watermark bounds a stream's state by event time."""
    if watermark is not None:
        events = events.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", watermark)
    return events.groupBy(F.window("timestamp", "1 minute"), "vehicle_id").agg(
        F.count("*").alias("pings"), F.max("temperature").alias("max_temperature"), F.max("vibration").alias("max_vibration")
    ).select(F.col("window.start").alias("minute_start"), "vehicle_id", "pings", "max_temperature", "max_vibration")


def trip_sessions(events: DataFrame, gap_seconds: int = config.SESSION_GAP_SECONDS) -> DataFrame:
    """Trips: readings of a vehicle less than the gap apart."""
    return stitched_sessions(events, "vehicle_id", "timestamp", gap_seconds).select(
        "vehicle_id", F.col("first").alias("first_ping"), F.col("last").alias("last_ping"), F.col("rows").alias("pings")
    )
