"""Data tests: each returns the offending rows or counts, so zero rows mean a pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from motorlake import config


def duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Values occurring more than once."""
    return df.where(F.col(columns[0]).isNotNull()).groupBy(*columns).agg(F.count("*").alias("copies")).where(
        F.col("copies") > 1
    )


def nulls(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def not_accepted(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Distinct values outside the accepted list, with counts."""
    return (
        df.where(F.col(column).isNotNull() & ~F.col(column).isin(*values))
        .groupBy(column)
        .agg(F.count("*").alias("rows"))
    )


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str | None = None) -> DataFrame:
    """Child rows whose non-null key has no parent."""
    parent_key = parent_key or key
    ids = parent.select(F.col(parent_key).alias("_pk"))
    return child.where(F.col(key).isNotNull()).join(ids, F.col(key) == F.col("_pk"), "left_anti")


def out_of_bounds(df: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """One row with the number of violations of each predicate."""
    return df.agg(*[F.count_if(~F.coalesce(p, F.lit(False))).alias(n) for n, p in predicates.items()])


def assert_bounds(df: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """Pass rows through; a violated bound fails the job that reads the column.

    ``predicates`` maps a column to the condition it must meet.  The guard sits in the
    column's own value, not in a filter: filters may be moved below the ones that removed
    the rejected rows.
    """
    guarded = {}
    for name, p in predicates.items():
        broken = F.raise_error(F.concat(F.lit(f"bound violated: {name}="), F.col(name).cast("string")))
        guarded[name] = F.when(F.coalesce(p, F.lit(False)), F.col(name)).otherwise(
            broken.cast(df.schema[name].dataType)
        )
    return df.withColumns(guarded)


def telemetry_bounds() -> dict[str, Column]:
    return {c: F.col(c).between(lo, hi) for c, (lo, hi) in config.TELEMETRY_BOUNDS.items()}


def by_rule(quarantined: DataFrame) -> DataFrame:
    return quarantined.groupBy("_quarantine_rule").agg(F.count("*").alias("rows"))


def freshness(df: DataFrame, column: str, as_of: str, max_lag_days: int) -> DataFrame:
    """Latest event date key, its age in days and whether the limit is met, with the row count."""
    latest = F.to_date(F.col("latest_key").cast("string"), "yyyyMMdd")
    lag = F.date_diff(F.lit(as_of).cast("date"), latest)
    return df.agg(F.max(column).alias("latest_key"), F.count("*").alias("rows")).select(
        "latest_key", "rows", lag.alias("lag_days"), F.coalesce(lag <= max_lag_days, F.lit(False)).alias("met")
    )


def quarantine_volume(spark, path: str) -> DataFrame:
    """Rows and files waiting in a quarantine folder."""
    return (
        spark.read.option("recursiveFileLookup", True)
        .parquet(path)
        .select(F.col("_metadata.file_path").alias("file"))
        .agg(F.count("*").alias("rows"), F.count_distinct("file").alias("files"))
    )


def reconcile(left: DataFrame, right: DataFrame, label: str) -> DataFrame:
    """Row counts of two layers side by side."""
    return (
        left.select(F.lit(1).alias("l"), F.lit(0).alias("r"))
        .unionAll(right.select(F.lit(0).alias("l"), F.lit(1).alias("r")))
        .agg(
            F.lit(label).alias("check_name"),
            F.coalesce(F.sum("l"), F.lit(0)).alias("left_rows"),
            F.coalesce(F.sum("r"), F.lit(0)).alias("right_rows"),
        )
        .withColumn("equal", F.col("left_rows") == F.col("right_rows"))
    )


def unsupported_diagnostics(diagnostics: DataFrame, telemetry: DataFrame) -> DataFrame:
    """Diagnostics without a reading at the same moment, or whose reading does not show the fault."""
    readings = telemetry.select(
        F.col("vehicle_id").alias("_v"), F.col("timestamp").alias("_t"), "temperature", "battery", "vibration"
    )
    joined = diagnostics.join(
        readings, (F.col("vehicle_id") == F.col("_v")) & (F.col("timestamp") == F.col("_t")), "left"
    )
    shown = F.lit(True)
    for codes, reading, op, limit in config.DTC_EVIDENCE:
        ok = F.col(reading) >= limit if op == ">=" else F.col(reading) <= limit
        shown = F.when(F.col("code").isin(*codes), ok).otherwise(shown)
    why = F.when(F.col("_v").isNull(), "NO_READING").when(~F.coalesce(shown, F.lit(False)), "NOT_SHOWN")
    return joined.withColumn("problem", why).where(F.col("problem").isNotNull()).drop("_v", "_t")


def unsupported_claims(claims: DataFrame, service: DataFrame) -> DataFrame:
    """Claims without a costly repair of the vehicle on that day naming the component.

    Of the repairs with the same text only the dearest matters, so a vehicle-day with very
    many visits offers each claim one row per distinct text.
    """
    repairs = (
        service.where(F.col("cost") > config.REPAIR_COST_FLOOR)
        .groupBy(F.col("vehicle_id").alias("_v"), F.col("visit_date").alias("_d"), "issue")
        .agg(F.max("cost").alias("cost"))
    )
    return claims.join(
        repairs,
        (F.col("vehicle_id") == F.col("_v"))
        & (F.col("claim_date") == F.col("_d"))
        & F.col("issue").contains(F.col("component"))
        & (F.col("amount") <= F.col("cost")),
        "left_anti",
    )


def profile(df: DataFrame, keys: list[str], ranges: list[str]) -> DataFrame:
    """Rows, nulls per column, key uniqueness and value ranges: one aggregate over the data
    and one over the keys."""
    nulls_of = [F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in df.columns]
    lows = [F.min(c).cast("string").alias(f"min_{c}") for c in ranges]
    highs = [F.max(c).cast("string").alias(f"max_{c}") for c in ranges]
    base = df.agg(F.count("*").alias("rows"), *nulls_of, *lows, *highs)
    distinct = df.groupBy(*keys).agg(F.lit(1).alias("one")).agg(F.count("*").alias("k")).scalar()
    return base.withColumn("distinct_keys", distinct)
