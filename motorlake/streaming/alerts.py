"""Scoring and alerting on the event stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from motorlake import config
from motorlake.learning.iforest import IsolationForest


def stream_features(events: DataFrame) -> DataFrame:
    """Fixed centring, as no statistic of the whole stream exists."""
    scaled = {
        f"norm_{c}": (F.col(c).cast("double") - centre) / width for c, (centre, width) in config.STREAM_CENTRES.items()
    }
    return events.withColumns(
        {**scaled, "vibration_per_rpm": F.col("vibration").cast("double") / (F.col("rpm") + 1.0)}
    )


def flagged_features(anomalous: Column) -> Column:
    """The readings outside their usual range, only for anomalous events."""
    low, high = config.STREAM_TEMPERATURE_FLAG
    t, v = F.col("temperature").cast("double"), F.col("vibration").cast("double")
    out_of_range = F.create_map(
        F.lit("temperature"), F.when((t > high) | (t < low), t), F.lit("vibration"), F.when(v > config.STREAM_VIBRATION_FLAG, v)
    )
    kept = F.map_filter(out_of_range, lambda _, x: x.isNotNull())
    return F.when(anomalous, kept).otherwise(F.create_map().cast("map<string,double>"))


def score_stream(events: DataFrame, forest: IsolationForest, threshold: float | None = None) -> DataFrame:
    """Scores kept unrounded for the rules, rounded for display."""
    limit = forest.threshold if threshold is None else threshold
    scored = stream_features(events).withColumn("anomaly_score", forest.score())
    return scored.withColumn("is_anomaly", F.col("anomaly_score") >= limit).withColumns(
        {
            "anomaly_score_shown": F.round("anomaly_score", 4),
            "anomalous_features": flagged_features(F.col("is_anomaly")),
            "decision_threshold": F.lit(round(limit, 4)),
        }
    )
