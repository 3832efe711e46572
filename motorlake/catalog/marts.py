"""Registered model and mart queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from motorlake.catalog.registry import query
from motorlake.catalog.sql import DAY, SESSION_COLUMNS, STAMP, sql
from motorlake.functions.text import row_key
from motorlake.plans import models, staging
from motorlake.plans.warehouse import open_warehouse

_WIDE = {"gap_seconds": 21600, "vibration_limit": 15.0, "temperature_limit": 158.0, "battery_limits": (9.5, 15.8)}


@query("e1_trip_sessions", sql(f"SELECT vehicle_key, date_key, {SESSION_COLUMNS} FROM sess"))
def e1(spark, sf_dir):
    """Operating time and alerts per vehicle-day with the standard limits."""
    return models.trip_sessions(open_warehouse(spark, sf_dir).table("fact_telemetry"))


@query("e1_trip_sessions_wide", sql(f"SELECT vehicle_key, date_key, {SESSION_COLUMNS} FROM sess_wide"))
def e1_wide(spark, sf_dir):
    """The same with a six-hour gap and raised limits."""
    return models.trip_sessions(open_warehouse(spark, sf_dir).table("fact_telemetry"), **_WIDE)


def _diagnostics(w):
    return staging.stage(w.table("silver_diagnostics"), "diagnostics")


@query(
    "e2_resolve_diagnostics",
    sql(f"""SELECT diagnostic_id, vehicle_id, vehicle_key, model_key, component_key, CAST(strftime(ts, '%Y%m%d') AS INT) AS date_key, month_key,
{STAMP.format('ts')} AS timestamp, code AS dtc_code, component AS component_name, severity,
CASE WHEN severity = 'CRITICAL' THEN 1 ELSE 0 END AS is_critical_dtc, CASE WHEN severity = 'HIGH' THEN 1 ELSE 0 END AS is_high_dtc FROM diag_resolved"""),
)
def e2(spark, sf_dir):
    w = open_warehouse(spark, sf_dir)
    return models.resolve_diagnostics(_diagnostics(w), w.table("dim_vehicle"), w.table("dim_component"))


@query("e3_diagnostics_monthly", sql("SELECT * FROM diag_month"))
def e3(spark, sf_dir):
    return models.diagnostics_monthly(e2(spark, sf_dir))


@query(
    "e4_warranty_monthly",
    sql("SELECT component_key, model_key, month_key, warranty_claim_count, total_cents / 100.0 AS total_warranty_amount, avg_warranty_claim_amount FROM wrn_month"),
)
def e4(spark, sf_dir):
    w = open_warehouse(spark, sf_dir)
    return models.warranty_monthly(w.table("fact_warranty"), w.table("dim_vehicle"))


def _failures(w):
    return models.component_failures(
        _diagnostics(w), w.table("fact_warranty"), w.table("dim_vehicle"), w.table("dim_component")
    )


@query(
    "e5_component_failures",
    sql("SELECT * EXCLUDE (total_cents), total_cents / 100.0 AS total_warranty_amount FROM failures"),
)
def e5(spark, sf_dir):
    return _failures(open_warehouse(spark, sf_dir))


@query(
    "e6_service_monthly",
    sql("SELECT * EXCLUDE (revenue_cents), revenue_cents / 100.0 AS total_service_revenue FROM srv_month"),
)
def e6(spark, sf_dir):
    return models.service_monthly(open_warehouse(spark, sf_dir).table("fact_service"))


@query("e7_parts_monthly", sql("SELECT * FROM prt_month"))
def e7(spark, sf_dir):
    return models.parts_monthly(open_warehouse(spark, sf_dir).table("fact_parts"))


@query("e8_dealer_rollup", sql("SELECT * FROM rollup"))
def e8(spark, sf_dir):
    w = open_warehouse(spark, sf_dir)
    return models.dealer_rollup(w.table("fact_service"), w.table("fact_parts"))


def _health_sql(block):
    return sql(f"""SELECT md5(vehicle_key || '|' || date_key) AS vehicle_health_pk, vehicle_key, date_key, {DAY.format('calendar_date')} AS calendar_date,
d.year, month_number, month_name, is_weekend, v.vehicle_id, variant, manufacture_year, v.status AS vehicle_status, model_name, vehicle_class,
powertrain_type, customer_id, customer_name, c.city AS customer_city, c.state AS customer_state, dealer_name AS selling_dealer_name,
r.region AS selling_dealer_region, {SESSION_COLUMNS},
CASE WHEN temp_alerts > 0 OR vib_alerts > 3 OR bat_alerts > 3 THEN 'CRITICAL' WHEN vib_alerts > 0 OR bat_alerts > 0 THEN 'WARNING' ELSE 'HEALTHY' END AS health_status
FROM {block} JOIN dim_date d USING (date_key) JOIN dim_vehicle v USING (vehicle_key) JOIN dim_model m USING (model_key)
JOIN dim_customer c USING (customer_key) JOIN dim_dealer r ON v.selling_dealer_key = r.dealer_key""")


def _health(w, **limits):
    return models.vehicle_health_daily(
        models.trip_sessions(w.table("fact_telemetry"), **limits),
        *[w.table(f"dim_{x}") for x in ("date", "vehicle", "model", "customer", "dealer")],
    )


@query("e9_vehicle_health_daily", _health_sql("sess"))
def e9(spark, sf_dir):
    return _health(open_warehouse(spark, sf_dir))


@query("e9_vehicle_health_wide", _health_sql("sess_wide"))
def e9_wide(spark, sf_dir):
    return _health(open_warehouse(spark, sf_dir), **_WIDE)


@query(
    "e10_component_failure_risk",
    sql("""SELECT md5(component_key || '|' || model_key || '|' || month_key) AS component_risk_pk, component_key, model_key, month_key,
component_name, category AS component_category, expected_lifespan_km, warranty_period_months, model_name, vehicle_class, powertrain_type,
total_dtc_count, critical_dtc_count, high_dtc_count, unique_vehicles_with_dtc, warranty_claim_count, total_cents / 100.0 AS total_warranty_amount,
avg_warranty_claim_amount, (6 * critical_dtc_count + 3 * high_dtc_count + (total_dtc_count - critical_dtc_count - high_dtc_count)) / 2.0 AS failure_severity_score,
CASE WHEN critical_dtc_count > 5 OR total_cents > 1000000 THEN 'HIGH_RISK' WHEN critical_dtc_count > 0 OR warranty_claim_count > 2 THEN 'MEDIUM_RISK' ELSE 'LOW_RISK' END AS risk_tier
FROM failures JOIN dim_component USING (component_key) JOIN dim_model USING (model_key)"""),
)
def e10(spark, sf_dir):
    w = open_warehouse(spark, sf_dir)
    return models.component_failure_risk(_failures(w), w.table("dim_component"), w.table("dim_model"))


@query(
    "e11_warranty_cost_analysis",
    sql("""SELECT md5(component_key || '|' || month_key) AS warranty_cost_pk, component_key, month_key, component_name, category AS component_category,
expected_lifespan_km, warranty_period_months, total_claims, unique_vehicles_claimed, total_claim_amount, avg_claim_amount, min_claim_amount, max_claim_amount
FROM claim_month JOIN dim_component USING (component_key)""",
        claim_month="""SELECT component_key, CAST(strftime(claim_date, '%Y%m') AS INT) AS month_key, count(*) AS total_claims,
count(DISTINCT vehicle_key) AS unique_vehicles_claimed, CAST(sum(cents) AS BIGINT) / 100.0 AS total_claim_amount,
CAST((2 * sum(cents) + count(*)) // (2 * count(*)) AS BIGINT) / 100.0 AS avg_claim_amount, min(cents) / 100.0 AS min_claim_amount,
max(cents) / 100.0 AS max_claim_amount FROM fw GROUP BY 1, 2"""),
)
def e11(spark, sf_dir):
    w = open_warehouse(spark, sf_dir)
    return models.warranty_cost(w.table("fact_warranty"), w.table("dim_component"))


@query(
    "e12_dealer_operational_summary",
    sql("""SELECT md5(dealer_key || '|' || month_key) AS dealer_operational_pk, dealer_key, month_key, dealer_id, dealer_name, city, state, region,
tier AS dealer_tier, total_service_invoices, total_service_revenue, avg_service_invoice_cost, unique_vehicles_serviced, total_parts_stock,
avg_parts_lead_time_days, low_stock_sku_count, out_of_stock_sku_count FROM rollup JOIN dim_dealer USING (dealer_key)"""),
)
def e12(spark, sf_dir):
    w = open_warehouse(spark, sf_dir)
    return models.dealer_summary(
        models.dealer_rollup(w.table("fact_service"), w.table("fact_parts")), w.table("dim_dealer")
    )


@query(
    "e13_row_keys",
    sql("SELECT l_orderkey, l_linenumber, l_partkey, md5(l_orderkey || '|' || l_linenumber || '|' || l_partkey) AS row_pk FROM lineitem"),
)
def e13(spark, sf_dir):
    """Deterministic md5 keys over every line."""
    from motorlake.sources.adapters import table

    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", row_key("l_orderkey", "l_linenumber", "l_partkey").alias("row_pk")
    )
