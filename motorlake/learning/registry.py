"""Model registry: one row per model and version, and the governed threshold in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from motorlake.plans.dimensions import upsert

SCHEMA = (
    "model_id string, model_version string, trained_at string, training_data_hash string, "
    "feature_names array<string>, hyperparameters map<string,double>, metrics map<string,double>, "
    "artifact_path string, created_at string"
)


def empty_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def entry(
    spark: SparkSession,
    model_id: str,
    version: str,
    trained_at: str,
    data_hash: str,
    features: list[str],
    hyperparameters: dict[str, float],
    metrics: dict[str, float],
    path: str,
) -> DataFrame:
    row = (model_id, version, trained_at, data_hash, features, hyperparameters, metrics, path, trained_at)
    return spark.createDataFrame([row], SCHEMA)


def register(registry: DataFrame, new: DataFrame) -> DataFrame:
    """Add the model; a known (id, version) only gets new metrics and artifact path."""
    fixed = ["trained_at", "training_data_hash", "feature_names", "hyperparameters", "created_at"]
    return upsert(registry, new, ["model_id", "model_version"], keep=fixed)


def load_threshold(registry: DataFrame, model_id: str, version: str, name: str = "calibrated_threshold") -> float:
    """The threshold on record.  A missing model, version or number is an error, not a default."""
    found = (
        registry.where((F.col("model_id") == model_id) & (F.col("model_version") == version))
        .select(F.try_element_at("hyperparameters", F.lit(name)).alias("t"))
        .take(2)
    )
    if len(found) != 1:
        raise LookupError(f"{len(found)} registry rows for {model_id} {version}")
    value = found[0]["t"]
    if value is None or value != value:
        raise ValueError(f"no numeric {name} on record for {model_id} {version}")
    return float(value)
