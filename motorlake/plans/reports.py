"""Report queries: filtered pages with totals, details, search and overview numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from motorlake.functions.text import mentions


def page(
    df: DataFrame, filters: list[Column], order: list[Column], limit: int = 50, offset: int = 0
) -> DataFrame:
    """One page with ``total_count``, the size of the whole filtered result.

    The total is a separate aggregate, not a window over all rows, so only the top
    ``offset + limit`` rows are ever sorted.  A page past the end has no rows.
    """
    hit = df
    for f in filters:
        hit = hit.where(f)
    total = hit.agg(F.count("*").alias("n")).scalar()
    return hit.orderBy(*order).offset(offset).limit(limit).withColumn("total_count", total)


def _fleet(vehicles: DataFrame, models: DataFrame, dealers: DataFrame) -> DataFrame:
    d = dealers.select(
        F.col("dealer_key").alias("selling_dealer_key"), F.col("dealer_name").alias("selling_dealer_name"),
        F.col("dealer_id").alias("selling_dealer_id"),
    )
    return vehicles.join(models, "model_key", "left").join(d, "selling_dealer_key", "left")


def vehicle_page(vehicles, models, dealers, status: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    rows = _fleet(vehicles, models, dealers).select(
        "vehicle_id", "variant", "manufacture_year", "manufacture_date", "status", "model_name", "vehicle_class",
        "selling_dealer_name",
    )
    return page(rows, [F.col("status") == status] if status else [], [F.asc("vehicle_id")], limit, offset)


def vehicle_detail(vehicles, models, dealers, vehicle_id: str) -> DataFrame:
    return _fleet(vehicles.where(F.col("vehicle_id") == vehicle_id), models, dealers).select(
        "vehicle_id", "variant", "manufacture_year", "manufacture_date", "status", "model_name", "vehicle_class",
        "powertrain_type", "curb_weight_kg", "selling_dealer_id", "selling_dealer_name",
    )


def diagnostic_history(diagnostics: DataFrame, vehicle_id: str, severity: str | None = None, limit: int = 50) -> DataFrame:
    rows = diagnostics.where(F.col("vehicle_id") == vehicle_id)
    if severity:
        rows = rows.where(F.upper("severity") == severity.upper())
    return rows.orderBy(F.desc("timestamp"), "diagnostic_id").limit(limit)


def risk_page(predictions, tier: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    order = [F.desc("risk_score"), F.asc("vehicle_id"), F.asc("cutoff_date")]
    return page(predictions, [F.col("risk_tier") == tier] if tier else [], order, limit, offset)


def anomaly_page(anomalies, is_anomaly: bool | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    order = [F.desc("window_timestamp"), F.asc("vehicle_id")]
    filters = [] if is_anomaly is None else [F.col("is_anomaly") == is_anomaly]
    return page(anomalies, filters, order, limit, offset)


def forecast_page(forecasts, dealer_id: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    order = [F.asc("forecast_date"), F.asc("dealer_id")]
    return page(forecasts, [F.col("dealer_id") == dealer_id] if dealer_id else [], order, limit, offset)


def claim_page(claims, dealer_id: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    order = [F.desc("anomaly_score"), F.asc("claim_id")]
    return page(claims, [F.col("dealer_id") == dealer_id] if dealer_id else [], order, limit, offset)


def action_page(
    log, rule: str | None = None, entity_type: str | None = None, status: str | None = None,
    limit: int = 50, offset: int = 0,
) -> DataFrame:
    wanted = {"rule_id": rule, "entity_type": entity_type, "delivery_status": status}
    filters = [F.col(c) == v for c, v in wanted.items() if v]
    return page(log, filters, [F.desc("trigger_timestamp"), F.asc("idempotency_key")], limit, offset)


def fleet_overview(vehicles, predictions, anomalies, claims, log) -> DataFrame:
    """Five aggregates on one row, each a scalar of its own table."""
    def count(df: DataFrame) -> Column:
        return df.agg(F.count("*").alias("n")).scalar()

    registered = vehicles.where(F.col("vehicle_key") > 0).select("vehicle_id").distinct()
    return log.agg(F.count("*").alias("actions_logged"), F.max("created_at").alias("last_action")).withColumns(
        {
            "total_vehicles": count(registered),
            "critical_risk": count(predictions.where(F.col("risk_tier") == "CRITICAL")),
            "sensor_anomalies": count(anomalies.where("is_anomaly")),
            "warranty_outliers": count(claims),
        }
    )


def search_vehicles(vehicles, models, dealers, term: str) -> DataFrame:
    """Free-text search over five columns; the unknown member is never shown."""
    columns = ["vehicle_id", "model_name", "variant", "vehicle_class", "selling_dealer_name"]
    rows = _fleet(vehicles, models, dealers).where(F.col("vehicle_id") != "UNKNOWN_VH")
    return rows.where(mentions(term, *columns)).select(*columns)


def search_claims(claims: DataFrame, term: str) -> DataFrame:
    return claims.where(mentions(term, "claim_id"))


def tier_distribution(predictions: DataFrame) -> DataFrame:
    """Predictions per tier, zero where a tier has none."""
    tiers = predictions.sparkSession.createDataFrame(
        [(t,) for t in ("CRITICAL", "HIGH", "MEDIUM", "LOW")], "risk_tier string"
    )
    counted = predictions.groupBy("risk_tier").agg(F.count("*").alias("vehicles"))
    return tiers.join(counted, "risk_tier", "left").na.fill({"vehicles": 0})


def model_status(registry: DataFrame) -> DataFrame:
    """One line per registered model from the registry itself."""
    return registry.select(
        "model_id", "model_version", "trained_at", F.size("feature_names").alias("feature_count"),
        F.to_json("metrics").alias("metrics"), "artifact_path",
    )
