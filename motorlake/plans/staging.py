"""Staging projections: the columns models read from each warehouse table."""

from __future__ import annotations

from pyspark.sql import DataFrame

# ---- fixed values: staged columns per table --------------------------------
COLUMNS = {
    "dim_date": [
        "date_key", "calendar_date", "day_of_week", "day_name", "day_of_month", "day_of_year", "week_of_year",
        "month_number", "month_name", "quarter", "year", "is_weekend",
    ],
    "dim_model": [
        "model_key", "model_name", "vehicle_class", "powertrain_type", "fuel_capacity_or_kwh", "curb_weight_kg",
    ],
    "dim_dealer": [
        "dealer_key", "dealer_id", "dealer_name", "city", "state", "region", "tier",
    ],
    "dim_customer": [
        "customer_key", "customer_id", "customer_name", "email", "phone", "address", "city", "state", "created_at",
    ],
    "dim_component": [
        "component_key", "component_name", "category", "expected_lifespan_km", "warranty_period_months",
    ],
    "dim_vehicle": [
        "vehicle_key", "vehicle_id", "model_key", "customer_key", "selling_dealer_key", "variant",
        "manufacture_date", "manufacture_year", "status",
    ],
    "fact_telemetry": [
        "telemetry_fact_id", "vehicle_key", "date_key", "timestamp", "rpm", "temperature", "battery", "vibration",
        "_silver_batch_id", "_loaded_at",
    ],
    "fact_service": [
        "service_fact_id", "service_id", "vehicle_key", "dealer_key", "date_key", "visit_date", "issue", "cost",
        "_silver_batch_id", "_loaded_at",
    ],
    "fact_warranty": [
        "warranty_fact_id", "claim_id", "vehicle_key", "component_key", "date_key", "claim_date", "amount",
        "_silver_batch_id", "_loaded_at",
    ],
    "fact_parts": [
        "parts_fact_id", "part_id", "dealer_key", "component_key", "date_key", "snapshot_date", "stock",
        "lead_time", "_silver_batch_id", "_loaded_at",
    ],
    "diagnostics": [
        "diagnostic_id", "vehicle_id", "timestamp", "dtc_code", "component", "severity", "_source_file",
        "_bronze_batch_id", "_silver_batch_id", "_staging_loaded_at",
    ],
}


def stage(df: DataFrame, name: str) -> DataFrame:
    """The staged form of a warehouse table; only the diagnostic code is renamed."""
    if name == "diagnostics":
        df = df.withColumnRenamed("code", "dtc_code")
    return df.select(*COLUMNS[name])
