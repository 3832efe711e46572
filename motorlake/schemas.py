"""Schemas of the raw sets and of the event payloads."""

from __future__ import annotations

from pyspark.sql import types as T

RAW = {
    "vehicles": "vehicle_id string, model string, variant string, manufacture_date date, dealer_id string",
    "telemetry": "vehicle_id string, timestamp timestamp_ntz, rpm int, temperature decimal(5,2), "
    "battery decimal(4,2), vibration decimal(6,3)",
    "diagnostics": "vehicle_id string, timestamp timestamp_ntz, code string, component string, severity string",
    "service": "service_id string, vehicle_id string, dealer_id string, visit_date date, issue string, "
    "cost decimal(10,2)",
    "warranty": "claim_id string, vehicle_id string, component string, claim_date date, amount decimal(10,2)",
    "parts": "part_id string, dealer_id string, stock int, lead_time int",
    "dealers": "dealer_id string, name string, region string, city string, bays int",
    "components": "part_id string, name string, category string, lifespan_km int, base_cost double, "
    "lead_time_days int",
    "customers": "customer_id string, customer_name string, segment string, region string",
    "vehicle_customer_map": "vehicle_id string, customer_id string, registration_date date",
}


def raw_schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(RAW[name])


def raw_text_schema(name: str) -> T.StructType:
    """The same columns, all as text: nothing is lost before the cleaning rules see it."""
    return T.StructType([T.StructField(f.name, T.StringType()) for f in raw_schema(name)])
