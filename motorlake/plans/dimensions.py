"""Star schema: dimensions with an unknown member, and the rules for changing them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from motorlake import config
from motorlake.functions.text import date_key
from motorlake.operators.dedup import rows_with_copies
from motorlake.operators.keys import assign_keys, extend_keys

# ---- fixed values: the unknown member of every dimension ----------------------
UNKNOWN = {
    "dim_date": "-1 AS date_key, DATE'1900-01-01' AS calendar_date, 1 AS day_of_week, 'Monday' AS day_name, "
    "1 AS day_of_month, 1 AS day_of_year, 1 AS week_of_year, 1 AS month_number, 'January' AS month_name, "
    "1 AS quarter, 1900 AS year, false AS is_weekend",
    "dim_model": "-1 AS model_key, 'UNKNOWN MODEL' AS model_name, 'UNKNOWN' AS vehicle_class, "
    "'UNKNOWN' AS powertrain_type, CAST(0 AS DECIMAL(6,2)) AS fuel_capacity_or_kwh, "
    "CAST(0 AS DECIMAL(8,2)) AS curb_weight_kg",
    "dim_dealer": "-1 AS dealer_key, 'UNKNOWN_DLR' AS dealer_id, 'UNKNOWN DEALER' AS dealer_name, "
    "'UNKNOWN' AS city, 'UNKNOWN' AS state, 'UNKNOWN' AS region, 'UNKNOWN' AS tier",
    "dim_customer": "-1 AS customer_key, 'UNKNOWN_CUST' AS customer_id, 'UNKNOWN CUSTOMER' AS customer_name, "
    "'unknown@customers.local' AS email, '000-000-0000' AS phone, 'UNKNOWN' AS address, 'UNKNOWN' AS city, "
    "'UNKNOWN' AS state, CAST(NULL AS TIMESTAMP_NTZ) AS created_at",
    "dim_component": "-1 AS component_key, 'UNKNOWN COMPONENT' AS component_name, 'UNKNOWN' AS category, "
    "0 AS expected_lifespan_km, 0 AS warranty_period_months",
    "dim_vehicle": "-1 AS vehicle_key, 'UNKNOWN_VH' AS vehicle_id, -1 AS model_key, -1 AS customer_key, "
    "-1 AS selling_dealer_key, 'UNKNOWN' AS variant, DATE'1900-01-01' AS manufacture_date, "
    "1900 AS manufacture_year, 'UNKNOWN' AS status",
}


def with_unknown(df: DataFrame, name: str) -> DataFrame:
    """Add the -1 member."""
    return df.unionByName(df.sparkSession.sql(f"SELECT {UNKNOWN[name]}"))


def _numbered(rows: DataFrame, natural: str, key: str, existing: DataFrame | None, **options) -> DataFrame:
    if existing is None:
        return assign_keys(rows, natural, key, **options)
    return extend_keys(rows, natural, key, existing, **options)


#: Natural key of each dimension that a later load renews, and the columns that stay as they were.
RENEWED = {
    "dim_model": ("model_name", ["model_key"]),
    "dim_dealer": ("dealer_id", ["dealer_key"]),
    "dim_customer": ("customer_id", ["customer_key", "created_at"]),
    "dim_component": ("component_name", ["component_key"]),
    "dim_vehicle": ("vehicle_id", ["vehicle_key"]),
}


def renewed(old: DataFrame, fresh: DataFrame, name: str) -> DataFrame:
    """The dimension after another load: known members have the latest attributes and keep their key, new
    members are added, and members that the load does not bring stay.
    """
    natural, keep = RENEWED[name]
    return upsert(old, fresh.select(*old.columns), [natural], keep=keep)


def calendar(days: DataFrame) -> DataFrame:
    """Calendar attributes of a column ``calendar_date``."""
    d = F.col("calendar_date")
    iso_day = (F.weekday(d) + 1).cast("int")
    return days.select(
        date_key(d).alias("date_key"),
        d,
        iso_day.alias("day_of_week"),
        F.date_format(d, "EEEE").alias("day_name"),
        F.dayofmonth(d).alias("day_of_month"),
        F.dayofyear(d).alias("day_of_year"),
        F.weekofyear(d).alias("week_of_year"),
        F.month(d).alias("month_number"),
        F.date_format(d, "MMMM").alias("month_name"),
        F.quarter(d).alias("quarter"),
        F.year(d).alias("year"),
        (iso_day >= 6).alias("is_weekend"),
    )


def dim_date(spark: SparkSession, low: str = config.CALENDAR[0], high: str = config.CALENDAR[1]) -> DataFrame:
    """Every day from low to high."""
    days = spark.range(1).select(
        F.explode(F.sequence(F.lit(low).cast("date"), F.lit(high).cast("date"))).alias("calendar_date")
    )
    return with_unknown(calendar(days), "dim_date")


def dim_date_covering(df: DataFrame, column: str) -> DataFrame:
    """The calendar of whole years that covers the dates of a table."""
    span = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    first = F.make_date(F.year("lo"), F.lit(1), F.lit(1))
    last = F.make_date(F.year("hi"), F.lit(12), F.lit(31))
    days = span.select(F.explode(F.sequence(first, last)).alias("calendar_date"))
    return with_unknown(calendar(days), "dim_date")


def dim_model(vehicles: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One row per model in name order; powertrain by model, UNKNOWN where not listed."""
    pairs = [F.lit(x) for kv in config.POWERTRAIN_BY_MODEL.items() for x in kv]
    models = (
        vehicles.select(F.col("model").alias("model_name"))
        .distinct()
        .select(
            "model_name",
            F.lit("UNKNOWN").alias("vehicle_class"),
            F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("model_name")), F.lit("UNKNOWN")).alias(
                "powertrain_type"
            ),
            F.lit(0).cast("decimal(6,2)").alias("fuel_capacity_or_kwh"),
            F.lit(0).cast("decimal(8,2)").alias("curb_weight_kg"),
        )
    )
    return with_unknown(_numbered(models, "model_name", "model_key", existing, order="natural"), "dim_model")


def dim_dealer(dealers: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    rows = dealers.select(
        "dealer_id",
        F.col("name").alias("dealer_name"),
        "city",
        F.lit("UNKNOWN").alias("state"),
        "region",
        F.lit("UNKNOWN").alias("tier"),
    )
    return with_unknown(_numbered(rows, "dealer_id", "dealer_key", existing), "dim_dealer")


def dim_customer(
    customers: DataFrame, existing: DataFrame | None = None, email_domain: str = "customers.local"
) -> DataFrame:
    """The region fills the state; the address parts are not known."""
    rows = customers.select(
        "customer_id",
        "customer_name",
        F.concat(F.lower("customer_id"), F.lit(f"@{email_domain}")).alias("email"),
        F.lit("UNKNOWN").alias("phone"),
        F.lit("UNKNOWN").alias("address"),
        F.lit("UNKNOWN").alias("city"),
        F.col("region").alias("state"),
        F.to_timestamp_ntz("_silver_processed_at", F.lit("yyyy-MM-dd HH:mm:ss")).alias("created_at"),
    )
    return with_unknown(_numbered(rows, "customer_id", "customer_key", existing), "dim_customer")


def dim_component(components: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One row per component name."""
    rows = (
        components.groupBy(F.col("name").alias("component_name"))
        .agg(F.max(F.struct("part_id", "category", "lifespan_km")).alias("c"))
        .select(
            "component_name",
            "c.category",
            F.col("c.lifespan_km").cast("int").alias("expected_lifespan_km"),
            F.lit(0).alias("warranty_period_months"),
        )
    )
    return with_unknown(_numbered(rows, "component_name", "component_key", existing), "dim_component")


def part_lookup(components: DataFrame, dim_component: DataFrame) -> DataFrame:
    """part_id -> component_key."""
    named = components.select("part_id", F.col("name").alias("component_name"))
    return lookup(named, dim_component, "component_name", "component_name", "component_key", by_member=True).select(
        "part_id", "component_key"
    )


def dim_vehicle(
    vehicles: DataFrame,
    owners: DataFrame,
    models: DataFrame,
    dealers: DataFrame,
    customers: DataFrame,
    existing: DataFrame | None = None,
) -> DataFrame:
    """Resolve model, dealer and owner; whatever has no match points to the unknown member."""
    owned = owners.select(F.col("vehicle_id").alias("_owned"), F.col("customer_id").alias("_owner"))
    owned = lookup(owned, customers, "_owner", "customer_id", "customer_key", by_member=True)
    rows = lookup(vehicles, owned, "vehicle_id", "_owned", "customer_key", by_member=True)
    rows = lookup(rows, models, "model", "model_name", "model_key")
    rows = lookup(rows, dealers, "dealer_id", "dealer_id", "dealer_key", "selling_dealer_key", by_member=True)
    made = F.col("manufacture_date").cast("date")
    shaped = rows.select(
        "vehicle_id",
        "model_key",
        "customer_key",
        "selling_dealer_key",
        "variant",
        made.alias("manufacture_date"),
        F.year(made).alias("manufacture_year"),
        F.lit("ACTIVE").alias("status"),
    )
    return with_unknown(_numbered(shaped, "vehicle_id", "vehicle_key", existing), "dim_vehicle")


def lookup(
    df: DataFrame, dim: DataFrame, column: str, natural: str, key: str, out: str | None = None, by_member: bool = False
) -> DataFrame:
    """Surrogate key of a natural key, -1 where the dimension has none.

    No broadcast is forced: dimensions grow with the data, so the planner decides by their
    measured size, and a skewed fact side is split by the adaptive skew join.  That size is of compressed
    files, for members often a hundredth of their rows in memory; so with ``by_member``, where ``df`` is
    itself a set of members, both sides are shuffled and the driver holds none of them.
    """
    found = dim.select(F.col(natural).alias("_n"), F.col(key).alias("_key"))
    if by_member:
        found = found.hint("merge")
    return (
        df.join(found, df[column] == found["_n"], "left")
        .withColumn(out or key, F.coalesce("_key", F.lit(config.UNKNOWN_KEY)))
        .drop("_n", "_key")
    )


def upsert(target: DataFrame, source: DataFrame, keys: list[str], keep: list[str] | None = None) -> DataFrame:
    """Source rows replace or extend the target; ``keep`` columns stay as they were.

    A key may occur once in the source: two rows would both be joined, so that is an error.
    """
    keep = keep or []
    several = rows_with_copies(source, keys)
    twice = several.groupBy(*keys).count().where("count > 1").limit(1).collect() if several is not None else None
    if twice:
        raise ValueError(f"upsert: source has the key {twice[0].asDict()} more than once")
    t, s = target.alias("t"), source.alias("s")
    on = None
    for k in keys:
        same = F.col(f"t.{k}") == F.col(f"s.{k}")
        on = same if on is None else on & same
    present = F.col(f"s.{keys[0]}").isNotNull()
    columns = []
    for c in target.columns:
        if c in keys:
            columns.append(F.coalesce(f"s.{c}", f"t.{c}").alias(c))
        elif c in keep or c not in source.columns:
            fallback = F.col(f"s.{c}") if c in source.columns else F.lit(None)
            columns.append(F.coalesce(F.col(f"t.{c}"), fallback).alias(c))
        else:
            columns.append(F.when(present, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c))
    return t.join(s, on, "full_outer").select(*columns)


def insert_absent(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Add only rows whose key is not there yet; existing rows never change."""
    fresh = source.join(target.select(*keys), keys, "left_anti")
    return target.unionByName(fresh.select(*target.columns))
