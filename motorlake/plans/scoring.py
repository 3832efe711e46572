"""Batch scoring: prediction tables in the shape the alert rules and reports read."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, functions as F

from motorlake import config
from motorlake.learning import forests
from motorlake.learning.iforest import IsolationForest
from motorlake.learning.metrics import risk_tier
from motorlake.operators.cumulative import fractional_rank
from motorlake.plans.features import calendar_features
from motorlake.session import settle


def stable_id(*columns) -> Column:
    """Id from the row's own key, so that scoring again gives the same rows."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]))


def _values(columns: list[str]) -> Column:
    return F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("double"))])


def _none() -> Column:
    return F.create_map().cast("map<string,double>")


def failure_predictions(model: PipelineModel, cohort: DataFrame, version: str, created_at: str) -> DataFrame:
    scored = forests.score_failure_risk(model, cohort)
    return scored.select(
        stable_id("vehicle_id", "cutoff_date").alias("prediction_id"),
        "vehicle_id",
        "cutoff_date",
        "risk_score",
        risk_tier(F.col("risk_score")).alias("risk_tier"),
        _values(config.FAILURE_FEATURES).alias("top_features"),
        F.lit(version).alias("model_version"),
        F.lit(created_at).alias("created_at"),
    )


def sensor_anomalies(forest: IsolationForest, readings: DataFrame, version: str, detected_at: str) -> DataFrame:
    """Predictions of all readings.

    All unregistered vehicles are one unknown member, so two of their readings at one time have the same
    ``anomaly_id``; ``prediction_id`` also holds the reading's own id and is unique.
    """
    scored = readings.withColumn("anomaly_score", forest.score()).withColumn(
        "is_anomaly", F.col("anomaly_score") >= forest.threshold
    )
    return scored.select(
        stable_id("vehicle_id", "timestamp").alias("anomaly_id"),
        stable_id("vehicle_id", "timestamp", "telemetry_fact_id").alias("prediction_id"),
        "vehicle_id",
        F.col("timestamp").alias("window_timestamp"),
        "anomaly_score",
        "is_anomaly",
        F.when(F.col("is_anomaly"), _values(["rpm", "temperature", "vibration"])).otherwise(_none()).alias("anomalous_features"),
        F.lit(version).alias("model_version"),
        F.lit(detected_at).alias("detected_at"),
    )


def forecast_grid(series: DataFrame, origin: str, horizon: int = config.HORIZON_DAYS) -> DataFrame:
    """Per dealer the last features up to the origin, repeated for the coming days.

    Lags stay as they were on the last day; the calendar is that of the forecast day.
    """
    start = F.lit(origin).cast("date")
    kept = ["lag_7", "lag_14", "mean_prev_7"]
    last = (
        series.where(F.col("visit_date") <= start)
        .groupBy("dealer_id")
        .agg(F.max_by(F.struct(*kept), "visit_date").alias("x"))
        .select("dealer_id", "x.*")
    )
    days = last.withColumn(
        "forecast_date", F.explode(F.sequence(F.date_add(start, 1), F.date_add(start, horizon)))
    )
    return calendar_features(days, "forecast_date")


def demand_forecasts(
    model: PipelineModel, series: DataFrame, origin: str, path: str, version: str, generated_at: str
) -> DataFrame:
    predicted = forests.predict_interval(model, forecast_grid(series, origin), path)
    return predicted.select(
        stable_id("dealer_id", "forecast_date").alias("forecast_id"),
        "dealer_id",
        "forecast_date",
        "predicted_volume",
        "lower_bound_80",
        "upper_bound_80",
        F.lit(version).alias("model_version"),
        F.lit(generated_at).alias("generated_at"),
    )


def claim_anomalies(ranked: DataFrame, version: str, flagged_at: str, score: str = "anomaly_score") -> DataFrame:
    """Prediction rows from claims that carry their outlier rank."""
    reasons = F.create_map(
        F.lit("median_ratio"), F.col("median_ratio"), F.lit("iqr_distance"), F.col("iqr_distance")
    )
    return ranked.select(
        stable_id("claim_id").alias("anomaly_id"),
        "claim_id",
        F.lit(None).cast("string").alias("dealer_id"),
        "component_id",
        F.col("claim_amount").cast("decimal(12,2)").alias("claim_amount"),
        F.col(score).alias("anomaly_score"),
        F.when(F.col(score) >= config.TRIAGE_RANK, reasons).otherwise(_none()).alias("outlier_reasons"),
        F.lit(version).alias("model_version"),
        F.lit(flagged_at).alias("flagged_at"),
    )


def score_claims(forest: IsolationForest, claims: DataFrame, version: str, flagged_at: str) -> DataFrame:
    """Claims ranked by how isolated they are: 0 most nominal, 1 most extreme."""
    # written once: the rank joins scores back by value, so each must be computed only once
    raw = settle(claims.withColumn("_isolation", -forest.raw_score()), "isolation")
    return claim_anomalies(fractional_rank(raw, "_isolation", "anomaly_score"), version, flagged_at)
