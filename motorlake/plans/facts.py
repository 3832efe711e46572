"""Fact tables: resolved keys, fail-fast bounds, idempotent loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from motorlake.functions.text import date_key, iso_seconds
from motorlake.operators.dedup import latest_rows
from motorlake.operators.quality import assert_bounds, telemetry_bounds
from motorlake.plans.dimensions import lookup, upsert
from motorlake.session import settle


def resolve_telemetry(silver: DataFrame, dim_vehicle: DataFrame) -> DataFrame:
    keyed = lookup(silver, dim_vehicle, "vehicle_id", "vehicle_id", "vehicle_key")
    shaped = keyed.select(
        "vehicle_key",
        date_key(F.col("timestamp")).alias("date_key"),
        "timestamp",
        F.col("rpm").cast("int").alias("rpm"),
        F.col("temperature").cast("decimal(5,2)").alias("temperature"),
        F.col("battery").cast("decimal(4,2)").alias("battery"),
        F.col("vibration").cast("decimal(6,3)").alias("vibration"),
        "_silver_batch_id",
    )
    return assert_bounds(shaped, telemetry_bounds())


def new_telemetry(resolved: DataFrame, fact: DataFrame) -> DataFrame:
    """Readings whose (vehicle, time) the fact does not hold.  Copies inside one batch stay.

    The time is part of the key, so only the folders of the batch's own days are read.
    """
    low, high = (resolved.agg(f("date_key").alias("d")).scalar() for f in (F.min, F.max))
    fact = fact.where((F.col("date_key") >= low) & (F.col("date_key") <= high))
    return resolved.join(fact.select("vehicle_key", "timestamp"), ["vehicle_key", "timestamp"], "left_anti")


def resolve_service(silver: DataFrame, dim_vehicle: DataFrame, dim_dealer: DataFrame) -> DataFrame:
    keyed = lookup(silver, dim_vehicle, "vehicle_id", "vehicle_id", "vehicle_key")
    keyed = lookup(keyed, dim_dealer, "dealer_id", "dealer_id", "dealer_key")
    day = F.col("visit_date").cast("date")
    shaped = keyed.select(
        "service_id", "vehicle_key", "dealer_key", date_key(day).alias("date_key"), day.alias("visit_date"),
        "issue", F.col("cost").cast("decimal(10,2)").alias("cost"), "_silver_batch_id",
    )
    return assert_bounds(shaped, {"cost": F.col("cost") >= 0})


def resolve_warranty(silver: DataFrame, dim_vehicle: DataFrame, dim_component: DataFrame) -> DataFrame:
    """The component is found by its name."""
    keyed = lookup(silver, dim_vehicle, "vehicle_id", "vehicle_id", "vehicle_key")
    keyed = lookup(keyed, dim_component, "component", "component_name", "component_key")
    day = F.col("claim_date").cast("date")
    shaped = keyed.select(
        "claim_id", "vehicle_key", "component_key", date_key(day).alias("date_key"), day.alias("claim_date"),
        F.col("amount").cast("decimal(10,2)").alias("amount"), "_silver_batch_id",
    )
    return assert_bounds(shaped, {"amount": F.col("amount") > 0})


def resolve_parts(silver: DataFrame, part_lookup: DataFrame, dim_dealer: DataFrame) -> DataFrame:
    keyed = lookup(silver, part_lookup, "part_id", "part_id", "component_key")
    keyed = lookup(keyed, dim_dealer, "dealer_id", "dealer_id", "dealer_key")
    day = F.col("snapshot_date").cast("date")
    shaped = keyed.select(
        "part_id", "dealer_key", "component_key", date_key(day).alias("date_key"), day.alias("snapshot_date"),
        F.col("stock").cast("int").alias("stock"), F.col("lead_time").cast("int").alias("lead_time"),
        "_silver_batch_id",
    )
    return assert_bounds(shaped, {"stock": F.col("stock") >= 0, "lead_time": F.col("lead_time") >= 1})


FACT_KEYS = {
    "fact_service": ["service_id"],
    "fact_warranty": ["claim_id"],
    "fact_parts": ["part_id", "dealer_key", "date_key"],
}
FACT_IDS = {
    "fact_telemetry": "telemetry_fact_id",
    "fact_service": "service_fact_id",
    "fact_warranty": "warranty_fact_id",
    "fact_parts": "parts_fact_id",
}


def one_per_key(resolved: DataFrame, name: str) -> DataFrame:
    """One row for each business key of the fact, the largest by all columns.

    Parts are unique by dealer id, but the fact's key has the dealer's surrogate, and all unknown
    dealers share one.
    """
    keys = FACT_KEYS[name]
    lead = [c for c in ("snapshot_date", "visit_date", "claim_date") if c in resolved.columns]
    return latest_rows(resolved, keys, lead) if name == "fact_parts" else resolved


def by_time(df: DataFrame) -> DataFrame:
    """Readings ranged by day, vehicle and time: files cover narrow spans, so scans of a period
    skip the rest, and a busy day or vehicle is spread over several files."""
    order = ["date_key", "vehicle_key", "timestamp"]
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def number_rows(df: DataFrame, name: str, start: int = 0) -> DataFrame:
    """Unique, not dense, fact ids above ``start``.  No shuffle; fixed when the rows are written."""
    return df.withColumn(FACT_IDS[name], F.monotonically_increasing_id() + F.lit(start + 1))


def merge_fact(fact: DataFrame, resolved: DataFrame, name: str) -> DataFrame:
    """Latest attributes win on the business key; ids of existing rows stay."""
    top = fact.agg(F.coalesce(F.max(FACT_IDS[name]), F.lit(0)).alias("m")).first()["m"]
    # Stored, as the upsert reads it twice.
    source = settle(number_rows(one_per_key(resolved, name), name, top), "source", codec="zstd")
    return upsert(fact, source, FACT_KEYS[name], keep=[FACT_IDS[name]])


def diagnostics_bridge(silver: DataFrame, loaded_at: str | None = None) -> DataFrame:
    """Diagnostics with a deterministic id: md5 of vehicle, ISO time and code."""
    rows = silver.withColumn(
        "diagnostic_id",
        F.md5(F.concat_ws("|", "vehicle_id", iso_seconds(F.col("timestamp")), "code")),
    )
    if loaded_at:
        rows = rows.withColumn("_staging_loaded_at", F.lit(loaded_at))
    lead = ["diagnostic_id", "vehicle_id", "timestamp", "code", "component", "severity"]
    return rows.select(*lead, *[c for c in rows.columns if c not in lead])


def merge_bridge(bridge: DataFrame, fresh: DataFrame) -> DataFrame:
    """Another load of the bridge: component, severity and silver lineage are renewed, the first sighting stays."""
    renewed = {"component", "severity", "_silver_processed_at", "_silver_batch_id", "_staging_loaded_at"}
    lead = [c for c in ("timestamp", "code") if c in fresh.columns]
    one = latest_rows(fresh, ["diagnostic_id"], lead)
    return upsert(bridge, one.select(*bridge.columns), ["diagnostic_id"], keep=[c for c in bridge.columns if c not in renewed | {"diagnostic_id"}])
