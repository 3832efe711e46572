"""Intermediate models and marts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from motorlake import config
from motorlake.functions.exact import rounded_mean, rounded_ratio
from motorlake.functions.text import date_key, month_key, row_key
from motorlake.operators.slots import active_time


def _flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def trip_sessions(
    telemetry: DataFrame,
    gap_seconds: int = config.SESSION_GAP_SECONDS,
    vibration_limit: float = config.VIBRATION_ALERT,
    temperature_limit: float = config.TEMPERATURE_ALERT,
    battery_limits: tuple[float, float] = config.BATTERY_ALERT,
    tie: str = "telemetry_fact_id",
) -> DataFrame:
    """Operating time and alert counts per vehicle and day."""
    low, high = battery_limits
    one = F.lit(1).cast("long")
    whole = {c: F.col(c) for c in ("rpm", "temperature", "battery", "vibration")}
    measures = {
        "total_telemetry_pings": (one, "sum"),
        **{f"sum_{c}": (v, "sum") for c, v in whole.items()},
        "max_rpm": (whole["rpm"], "max"),
        "max_temperature": (whole["temperature"], "max"),
        "min_battery_voltage": (whole["battery"], "min"),
        "max_vibration": (whole["vibration"], "max"),
        "vibration_alert_count": (_flag(whole["vibration"] >= vibration_limit), "sum"),
        "temperature_alert_count": (_flag(whole["temperature"] >= temperature_limit), "sum"),
        "battery_alert_count": (_flag((whole["battery"] < low) | (whole["battery"] > high)), "sum"),
    }
    days = active_time(
        telemetry, ["vehicle_key", "date_key"], "timestamp", tie, F.col("rpm") > 0, gap_seconds, measures
    )
    n = F.col("total_telemetry_pings")
    return days.select(
        "vehicle_key",
        "date_key",
        "total_telemetry_pings",
        rounded_ratio(F.col("active_micros"), F.lit(3_600_000_000), 4).alias("daily_operating_hours"),
        rounded_ratio(F.col("sum_rpm"), n, 2).alias("avg_rpm"),
        "max_rpm",
        rounded_ratio(F.col("sum_temperature"), n, 2).alias("avg_temperature"),
        "max_temperature",
        rounded_ratio(F.col("sum_battery"), n, 2).alias("avg_battery_voltage"),
        "min_battery_voltage",
        rounded_ratio(F.col("sum_vibration"), n, 3).alias("avg_vibration"),
        "max_vibration",
        "vibration_alert_count",
        "temperature_alert_count",
        "battery_alert_count",
    )


def resolve_diagnostics(diagnostics: DataFrame, vehicles: DataFrame, components: DataFrame) -> DataFrame:
    """Vehicle, model and component keys of every diagnostic; names match ignoring case and blanks."""
    v = vehicles.select(F.col("vehicle_id").alias("_vid"), "vehicle_key", "model_key")
    c = components.select(F.lower(F.trim("component_name")).alias("_name"), F.col("component_key").alias("_ck"))
    d = diagnostics.withColumn("_wanted", F.lower(F.trim("component")))
    joined = d.join(v, d["vehicle_id"] == v["_vid"], "left").join(c, F.col("_wanted") == F.col("_name"), "left")
    unknown = F.lit(config.UNKNOWN_KEY)
    return joined.select(
        "diagnostic_id",
        "vehicle_id",
        F.coalesce("vehicle_key", unknown).alias("vehicle_key"),
        F.coalesce("model_key", unknown).alias("model_key"),
        F.coalesce("_ck", unknown).alias("component_key"),
        date_key(F.col("timestamp")).alias("date_key"),
        month_key(F.col("timestamp")).alias("month_key"),
        "timestamp",
        "dtc_code",
        F.col("component").alias("component_name"),
        "severity",
        _flag(F.col("severity") == "CRITICAL").alias("is_critical_dtc"),
        _flag(F.col("severity") == "HIGH").alias("is_high_dtc"),
    )


def _distinct_in_groups(df: DataFrame, keys: list[str], column: str, out: str, sums: dict[str, Column]) -> DataFrame:
    """Sums plus a distinct count, in two steps: (keys, column) first, then keys.

    The first step spreads a busy group over its distinct values, so no task holds a whole
    group and no row is expanded as a direct count of distinct values would.
    """
    fine = df.groupBy(*keys, column).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    return fine.groupBy(*keys).agg(
        *[F.sum(n).alias(n) for n in sums],
        F.count(column).alias(out),
    )


def diagnostics_monthly(resolved: DataFrame) -> DataFrame:
    one = F.when(F.col("diagnostic_id").isNotNull(), 1).otherwise(0)
    return _distinct_in_groups(
        resolved,
        ["component_key", "model_key", "month_key"],
        "vehicle_key",
        "unique_vehicles_with_dtc",
        {
            "total_dtc_count": one,
            "critical_dtc_count": F.col("is_critical_dtc"),
            "high_dtc_count": F.col("is_high_dtc"),
        },
    )


def warranty_monthly(warranty: DataFrame, vehicles: DataFrame) -> DataFrame:
    v = vehicles.select("vehicle_key", "model_key")
    return (
        warranty.join(v, "vehicle_key")
        .groupBy("component_key", "model_key", month_key(F.col("claim_date")).alias("month_key"))
        .agg(
            F.count("*").alias("warranty_claim_count"),
            F.sum("amount").alias("total_warranty_amount"),
            rounded_mean(F.col("amount"), 2).alias("avg_warranty_claim_amount"),
        )
    )


def align(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Two aggregates side by side over the union of their keys, zero where one has no row.

    One full outer join: each aggregate is computed and shuffled once.
    """
    joined = left.join(right, keys, "full_outer")
    return joined.select(
        *keys, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in joined.columns if c not in keys]
    )


def component_failures(
    diagnostics: DataFrame, warranty: DataFrame, vehicles: DataFrame, components: DataFrame
) -> DataFrame:
    dtc = diagnostics_monthly(resolve_diagnostics(diagnostics, vehicles, components))
    return align(dtc, warranty_monthly(warranty, vehicles), ["component_key", "model_key", "month_key"])


def service_monthly(service: DataFrame) -> DataFrame:
    keyed = service.withColumn("month_key", month_key(F.col("visit_date")))
    sums = _distinct_in_groups(
        keyed,
        ["dealer_key", "month_key"],
        "vehicle_key",
        "unique_vehicles_serviced",
        {"total_service_invoices": F.lit(1).cast("long"), "total_service_revenue": F.col("cost")},
    )
    return sums.select(
        "dealer_key",
        "month_key",
        "total_service_invoices",
        "total_service_revenue",
        rounded_ratio(F.col("total_service_revenue"), F.col("total_service_invoices"), 2).alias(
            "avg_service_invoice_cost"
        ),
        "unique_vehicles_serviced",
    )


def parts_monthly(parts: DataFrame) -> DataFrame:
    return parts.groupBy("dealer_key", month_key(F.col("snapshot_date")).alias("month_key")).agg(
        F.sum("stock").alias("total_parts_stock"),
        rounded_mean(F.col("lead_time"), 2).alias("avg_parts_lead_time_days"),
        F.count_if(F.col("stock") < 10).alias("low_stock_sku_count"),
        F.count_if(F.col("stock") == 0).alias("out_of_stock_sku_count"),
    )


def dealer_rollup(service: DataFrame, parts: DataFrame) -> DataFrame:
    return align(service_monthly(service), parts_monthly(parts), ["dealer_key", "month_key"])


def health_status() -> Column:
    vib, temp, bat = (F.col(f"{x}_alert_count") for x in ("vibration", "temperature", "battery"))
    return (
        F.when((temp > 0) | (vib > 3) | (bat > 3), "CRITICAL")
        .when((vib > 0) | (bat > 0), "WARNING")
        .otherwise("HEALTHY")
    )


def vehicle_health_daily(
    sessions: DataFrame,
    dates: DataFrame,
    vehicles: DataFrame,
    models: DataFrame,
    customers: DataFrame,
    dealers: DataFrame,
) -> DataFrame:
    """Sessions with their calendar, vehicle, model, owner and dealer attributes.

    The vehicle's own dimensions are resolved first, per vehicle, so the daily rows are
    joined once by vehicle and once by date.
    """
    v = vehicles.select(
        "vehicle_key", "vehicle_id", "model_key", "customer_key", "selling_dealer_key", "variant",
        "manufacture_year", F.col("status").alias("vehicle_status"),
    )
    m = models.select("model_key", "model_name", "vehicle_class", "powertrain_type")
    c = customers.select(
        "customer_key", "customer_id", "customer_name", F.col("city").alias("customer_city"),
        F.col("state").alias("customer_state"),
    )
    d = dealers.select(
        F.col("dealer_key").alias("selling_dealer_key"), F.col("dealer_name").alias("selling_dealer_name"),
        F.col("region").alias("selling_dealer_region"),
    )
    fleet = v.join(m, "model_key").join(c, "customer_key").join(d, "selling_dealer_key")
    days = dates.select("date_key", "calendar_date", "year", "month_number", "month_name", "is_weekend")
    joined = sessions.join(days, "date_key").join(fleet, "vehicle_key")
    return joined.select(
        row_key("vehicle_key", "date_key").alias("vehicle_health_pk"),
        "vehicle_key", "date_key", "calendar_date", "year", "month_number", "month_name", "is_weekend",
        "vehicle_id", "variant", "manufacture_year", "vehicle_status", "model_name", "vehicle_class",
        "powertrain_type", "customer_id", "customer_name", "customer_city", "customer_state",
        "selling_dealer_name", "selling_dealer_region", "total_telemetry_pings", "daily_operating_hours",
        "avg_rpm", "max_rpm", "avg_temperature", "max_temperature", "avg_battery_voltage",
        "min_battery_voltage", "avg_vibration", "max_vibration", "vibration_alert_count",
        "temperature_alert_count", "battery_alert_count", health_status().alias("health_status"),
    )


def component_failure_risk(failures: DataFrame, components: DataFrame, models: DataFrame) -> DataFrame:
    crit, high, every = (F.col(f"{x}_dtc_count") for x in ("critical", "high", "total"))
    # halves: 3.0, 1.5 and 0.5 are six, three and one half
    score = (crit * 6 + high * 3 + (every - crit - high)).cast("decimal(18,0)") / F.lit(2)
    tier = (
        F.when((crit > 5) | (F.col("total_warranty_amount") > 10000), "HIGH_RISK")
        .when((crit > 0) | (F.col("warranty_claim_count") > 2), "MEDIUM_RISK")
        .otherwise("LOW_RISK")
    )
    c = components.select(
        "component_key", "component_name", F.col("category").alias("component_category"),
        "expected_lifespan_km", "warranty_period_months",
    )
    m = models.select("model_key", "model_name", "vehicle_class", "powertrain_type")
    measures = [x for x in failures.columns if x not in ("component_key", "model_key", "month_key")]
    return failures.join(c, "component_key").join(m, "model_key").select(
        row_key("component_key", "model_key", "month_key").alias("component_risk_pk"),
        "component_key", "model_key", "month_key", "component_name", "component_category",
        "expected_lifespan_km", "warranty_period_months", "model_name", "vehicle_class", "powertrain_type",
        *measures,
        score.cast("decimal(18,2)").alias("failure_severity_score"),
        tier.alias("risk_tier"),
    )


def warranty_cost(warranty: DataFrame, components: DataFrame) -> DataFrame:
    keyed = warranty.withColumn("month_key", month_key(F.col("claim_date")))
    fine = keyed.groupBy("component_key", "month_key", "vehicle_key").agg(
        F.count("*").alias("n"), F.sum("amount").alias("s"), F.min("amount").alias("lo"), F.max("amount").alias("hi")
    )
    monthly = fine.groupBy("component_key", "month_key").agg(
        F.sum("n").alias("total_claims"),
        F.count("vehicle_key").alias("unique_vehicles_claimed"),
        F.sum("s").alias("total_claim_amount"),
        rounded_ratio(F.sum("s"), F.sum("n"), 2).alias("avg_claim_amount"),
        F.min("lo").alias("min_claim_amount"),
        F.max("hi").alias("max_claim_amount"),
    )
    c = components.select(
        "component_key", "component_name", F.col("category").alias("component_category"),
        "expected_lifespan_km", "warranty_period_months",
    )
    return monthly.join(c, "component_key").select(
        row_key("component_key", "month_key").alias("warranty_cost_pk"),
        "component_key", "month_key", "component_name", "component_category", "expected_lifespan_km",
        "warranty_period_months", "total_claims", "unique_vehicles_claimed", "total_claim_amount",
        "avg_claim_amount", "min_claim_amount", "max_claim_amount",
    )


def dealer_summary(rollup: DataFrame, dealers: DataFrame) -> DataFrame:
    d = dealers.select(
        "dealer_key", "dealer_id", "dealer_name", "city", "state", "region", F.col("tier").alias("dealer_tier")
    )
    measures = [x for x in rollup.columns if x not in ("dealer_key", "month_key")]
    return rollup.join(d, "dealer_key").select(
        row_key("dealer_key", "month_key").alias("dealer_operational_pk"),
        "dealer_key", "month_key", "dealer_id", "dealer_name", "city", "state", "region", "dealer_tier",
        *measures,
    )


# -- reconciliation: every function returns the failing rows ---------------------------

def revenue_mismatch(summary: DataFrame, service: DataFrame) -> DataFrame:
    """Mart revenue against invoice total; no row when they agree within a cent."""
    fact = service.agg(F.coalesce(F.sum("cost"), F.lit(0)).alias("x")).scalar()
    totals = summary.agg(F.coalesce(F.sum("total_service_revenue"), F.lit(0)).alias("mart_revenue"))
    both = totals.withColumn("fact_cost", fact)
    return both.withColumn("variance", F.abs(F.col("mart_revenue") - F.col("fact_cost"))).where(
        F.col("variance") > 0.01
    )


def illogical_hours(health: DataFrame) -> DataFrame:
    h = F.col("daily_operating_hours")
    return health.where((h < 0) | (h > 24)).select(
        "vehicle_health_pk", "vehicle_id", "calendar_date", "daily_operating_hours"
    )


def non_positive_claims(cost: DataFrame) -> DataFrame:
    return cost.where(F.col("total_claim_amount") <= 0).select(
        "warranty_cost_pk", "component_key", "month_key", "total_claim_amount"
    )


def negative_stock(summary: DataFrame) -> DataFrame:
    return summary.where(F.col("total_parts_stock") < 0).select(
        "dealer_operational_pk", "dealer_id", "month_key", "total_parts_stock"
    )
