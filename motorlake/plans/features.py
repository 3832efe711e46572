"""Point-in-time features: failure cohorts, sensor scaling, demand series, claim deviations."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from motorlake import config
from motorlake.functions.text import is_breakdown
from motorlake.operators.cumulative import exact_quantiles, split_by_position
from motorlake.operators.intervals import flag_near_events
from motorlake.session import settle

# ---- failure cohorts -----------------------------------------------------------------
# Every window is made of whole days, so each source is first reduced to one row per
# vehicle and day; only those small rows are repeated for the cutoffs they count towards.


def _cutoffs_where(cutoffs: list[str], holds) -> Column:
    """One row per cutoff whose window holds the day."""
    dates = F.array(*[F.lit(c).cast("date") for c in cutoffs])
    return F.explode(F.filter(dates, holds))


def _days_between(df: DataFrame, column: str, cutoffs: list[str], back: int | None, ahead: int) -> DataFrame:
    """Only the days any cutoff can use, as a range on the stored column that the scan can skip by, and on the
    folders of a fact that is kept by day.
    """
    first, last = min(cutoffs), max(cutoffs)
    kind = df.schema[column].dataType
    end = F.date_add(F.lit(last).cast("date"), ahead + 1).cast(kind)
    kept = df.where(F.col(column) < end)
    if back is not None:
        kept = kept.where(F.col(column) >= F.date_sub(F.lit(first).cast("date"), back).cast(kind))
    if "date_key" in df.columns:
        key = lambda day, days: int((date.fromisoformat(day) + timedelta(days)).strftime("%Y%m%d"))
        kept = kept.where(F.col("date_key") <= key(last, ahead))
        if back is not None:
            kept = kept.where(F.col("date_key") >= key(first, -back))
    return kept


def telemetry_days(telemetry: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Mergeable sums per vehicle and day; squares are of whole thousandths, so exact."""
    v = (F.col("vibration") * 1000).cast("bigint")
    days = telemetry.groupBy("vehicle_key", F.col("timestamp").cast("date").alias("day")).agg(
        F.count("*").alias("n"),
        F.sum("temperature").alias("s_temp"),
        F.max("temperature").alias("max_temp"),
        F.sum(v.cast("decimal(38,0)")).alias("s_vib"),
        F.sum((v * v).cast("decimal(38,0)")).alias("q_vib"),
        F.min("battery").alias("min_bat"),
        F.count_if(F.col("rpm") > config.HIGH_RPM).alias("high_rpm"),
    )
    return days.join(vehicles.select("vehicle_key", "vehicle_id"), "vehicle_key")


def in_lookback(days: DataFrame, cutoffs: list[str], lookback: int) -> DataFrame:
    """The vehicle-days of each cutoff's observation window."""
    return days.withColumn(
        "cutoff_date",
        _cutoffs_where(cutoffs, lambda c: (F.col("day") >= F.date_sub(c, lookback)) & (F.col("day") <= c)),
    )


def cohort(telemetry: DataFrame, vehicles: DataFrame, cutoffs: list[str], lookback: int = config.LOOKBACK_DAYS) -> DataFrame:
    """Vehicles seen in the observation window of each cutoff."""
    telemetry = _days_between(telemetry, "timestamp", cutoffs, lookback, 0)
    days = telemetry.select("vehicle_key", F.col("timestamp").cast("date").alias("day")).distinct()
    seen = in_lookback(days, cutoffs, lookback).select("cutoff_date", "vehicle_key").distinct()
    return seen.join(vehicles.select("vehicle_key", "vehicle_id"), "vehicle_key")


def _telemetry_aggregates() -> list[Column]:
    n, s, q = F.sum("n"), F.sum("s_vib"), F.sum("q_vib")
    spread = (n * q - s * s).cast("double") / (n * (n - 1)).cast("double")
    return [
        (F.sum("s_temp").cast("double") / n).alias("avg_engine_temp"),
        F.max("max_temp").cast("double").alias("max_engine_temp"),
        F.when(n > 1, F.sqrt(spread) / 1000).alias("vibration_stddev"),
        F.min("min_bat").cast("double").alias("battery_min"),
        F.sum("high_rpm").alias("high_rpm_pings"),
    ]


def telemetry_window_features(
    telemetry: DataFrame, vehicles: DataFrame, cutoffs: list[str], lookback: int = config.LOOKBACK_DAYS
) -> DataFrame:
    telemetry = _days_between(telemetry, "timestamp", cutoffs, lookback, 0)
    days = in_lookback(telemetry_days(telemetry, vehicles), cutoffs, lookback)
    return days.groupBy("cutoff_date", "vehicle_id").agg(*_telemetry_aggregates())


def severe_days(diagnostics: DataFrame) -> DataFrame:
    return (
        diagnostics.where(F.col("severity").isin(*config.SEVERE))
        .groupBy("vehicle_id", F.col("timestamp").cast("date").alias("day"))
        .agg(F.count("*").alias("severe"))
    )


def dtc_count(diagnostics: DataFrame, cutoffs: list[str], lookback: int = config.LOOKBACK_DAYS) -> DataFrame:
    diagnostics = _days_between(diagnostics, "timestamp", cutoffs, lookback, 0)
    days = in_lookback(severe_days(diagnostics), cutoffs, lookback)
    return days.groupBy("cutoff_date", "vehicle_id").agg(F.sum("severe").alias("severe_dtc_count"))


def service_days(service: DataFrame, vehicles: DataFrame) -> DataFrame:
    days = service.groupBy("vehicle_key", F.col("visit_date").alias("day")).agg(
        F.count("*").alias("visits"), F.max(is_breakdown(F.col("issue")).cast("int")).alias("broke")
    )
    return days.join(vehicles.select("vehicle_key", "vehicle_id"), "vehicle_key")


def service_history(service: DataFrame, vehicles: DataFrame, cutoffs: list[str]) -> DataFrame:
    service = _days_between(service, "visit_date", cutoffs, None, 0)
    days = service_days(service, vehicles).withColumn(
        "cutoff_date", _cutoffs_where(cutoffs, lambda c: F.col("day") <= c)
    )
    return days.groupBy("cutoff_date", "vehicle_id").agg(
        F.sum("visits").alias("service_count"), F.max("day").alias("last_service_date")
    )


def _after(horizon: int):
    return lambda c: (F.col("day") > c) & (F.col("day") <= F.date_add(c, horizon))


def forward_label(
    service: DataFrame, diagnostics: DataFrame, vehicles: DataFrame, cutoffs: list[str], horizon: int = config.HORIZON_DAYS
) -> DataFrame:
    """Vehicles that broke down, or showed a severe code, within the horizon after each cutoff."""
    service = _days_between(service, "visit_date", cutoffs, 0, horizon)
    diagnostics = _days_between(diagnostics, "timestamp", cutoffs, 0, horizon)
    broke = service_days(service, vehicles).where(F.col("broke") == 1).select("vehicle_id", "day")
    severe = severe_days(diagnostics).select("vehicle_id", "day")
    return (
        broke.unionByName(severe)
        .withColumn("cutoff_date", _cutoffs_where(cutoffs, _after(horizon)))
        .select("cutoff_date", "vehicle_id")
        .distinct()
    )


def days_since(cutoff: Column, last: Column, default: int = config.NEVER_SERVICED_DAYS) -> Column:
    return F.coalesce(F.greatest(F.lit(0), F.date_diff(cutoff, last)), F.lit(default))


def failure_cohorts(
    telemetry: DataFrame,
    diagnostics: DataFrame,
    service: DataFrame,
    vehicles: DataFrame,
    cutoffs: list[str],
    lookback: int = config.LOOKBACK_DAYS,
    horizon: int = config.HORIZON_DAYS,
) -> DataFrame:
    """Features and target of every (cutoff, active vehicle), all cutoffs in one pass.

    The daily rows of the three sources are stacked and grouped once, instead of joining one
    frame per source and cutoff.
    """
    telemetry = _days_between(telemetry, "timestamp", cutoffs, lookback, 0)
    diagnostics = _days_between(diagnostics, "timestamp", cutoffs, lookback, horizon)
    service = _days_between(service, "visit_date", cutoffs, None, horizon)
    tel = in_lookback(telemetry_days(telemetry, vehicles), cutoffs, lookback).drop("vehicle_key", "day")
    dates = F.array(*[F.lit(c).cast("date") for c in cutoffs])

    def tagged(days: DataFrame, past, future) -> DataFrame:
        either = F.filter(dates, lambda c: past(c) | future(c))
        spread = days.withColumn("cutoff_date", F.explode(either))
        return spread.withColumns({"past": past(F.col("cutoff_date")), "future": future(F.col("cutoff_date"))})

    day = F.col("day")
    sev = tagged(
        severe_days(diagnostics), lambda c: (day >= F.date_sub(c, lookback)) & (day <= c), _after(horizon)
    ).select(
        "cutoff_date", "vehicle_id", F.when(F.col("past"), F.col("severe")).alias("severe"),
        F.col("future").cast("int").alias("hit"),
    )
    srv = tagged(service_days(service, vehicles), lambda c: day <= c, _after(horizon)).select(
        "cutoff_date", "vehicle_id", F.when(F.col("past"), F.col("visits")).alias("visits"),
        F.when(F.col("past"), day).alias("visited"),
        (F.col("future") & (F.col("broke") == 1)).cast("int").alias("hit"),
    )
    stacked = tel.unionByName(sev, allowMissingColumns=True).unionByName(srv, allowMissingColumns=True)
    grouped = stacked.groupBy("cutoff_date", "vehicle_id").agg(
        F.sum("n").alias("_pings"),
        *_telemetry_aggregates(),
        F.sum("severe").alias("severe_dtc_count"),
        F.sum("visits").alias("service_count"),
        F.max("visited").alias("_last"),
        F.coalesce(F.max("hit"), F.lit(0)).alias("target"),
    )
    active = grouped.where(F.col("_pings") > 0).na.fill(config.FEATURE_DEFAULTS)
    return active.withColumn("days_since_service", days_since(F.col("cutoff_date"), F.col("_last"))).select(
        "cutoff_date", "vehicle_id", *config.FAILURE_FEATURES, "target"
    )


# ---- sensor readings -----------------------------------------------------------------


def quartiles(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float, float]]:
    """(q25, median, q75) of every column over the whole frame: one pass for all columns."""
    long = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])
        ).alias("x")
    ).select("x.*")
    found = exact_quantiles(long, "v", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, ["feature"])
    return {r["feature"]: (r["q25"], r["q50"], r["q75"]) for r in found.collect()}  # one row per column


def robust_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - median) / (q75 - q25 + 1e-5) for each column, as norm_<column>."""
    stats = quartiles(df, columns)
    scaled = {}
    for c in columns:
        low, mid, high = stats[c]
        scaled[f"norm_{c}"] = (F.col(c).cast("double") - mid) / (high - low + 1e-5)
    return df.withColumns(scaled)


def ratio() -> Column:
    return F.col("vibration").cast("double") / (F.col("rpm") + 1.0)


def sensor_features(
    telemetry: DataFrame, vehicles: DataFrame, diagnostics: DataFrame | None, cutoff: str | None = None
) -> DataFrame:
    """Scaled readings per vehicle, with the fault-window flag when diagnostics are given."""
    rows = telemetry.join(vehicles.select("vehicle_key", "vehicle_id"), "vehicle_key")
    if cutoff is not None:
        rows = rows.where(F.col("timestamp").cast("date") <= F.lit(cutoff).cast("date"))
    scaled = robust_scale(rows, ["rpm", "temperature", "vibration"]).withColumn("vibration_per_rpm", ratio())
    if diagnostics is None:
        return scaled.withColumn("is_fault_window", F.lit(False))
    return flag_fault_windows(scaled, diagnostics)


def flag_fault_windows(
    rows: DataFrame,
    diagnostics: DataFrame,
    before_hours: float = config.FAULT_BEFORE_HOURS,
    after_hours: float = config.FAULT_AFTER_HOURS,
) -> DataFrame:
    """Readings from two hours before to six hours after a severe code of the vehicle."""
    severe = diagnostics.where(F.col("severity").isin(*config.SEVERE)).select(
        "vehicle_id", F.col("timestamp").alias("fault_ts")
    )
    return flag_near_events(
        rows, severe, "vehicle_id", "timestamp", "fault_ts",
        int(before_hours * 3600), int(after_hours * 3600), "is_fault_window",
    )


# ---- demand series -------------------------------------------------------------------


def daily_counts(service: DataFrame, dealers: DataFrame) -> DataFrame:
    counted = service.groupBy("dealer_key", "visit_date").agg(F.count("*").alias("service_count"))
    return (
        counted.join(dealers.select("dealer_key", "dealer_id"), "dealer_key")
        .groupBy("dealer_id", "visit_date")
        .agg(F.sum("service_count").alias("service_count"))
    )


def dense_grid(counts: DataFrame) -> DataFrame:
    """Every dealer on every day of the observed span; days without visits are zero.

    Each dealer carries the span as an array, so no product of two frames is formed.
    """
    low = counts.agg(F.min("visit_date").alias("d")).scalar()
    high = counts.agg(F.max("visit_date").alias("d")).scalar()
    days = (
        counts.select("dealer_id").distinct()
        .withColumn("visit_date", F.explode(F.sequence(low, high)))
    )
    return days.join(counts, ["dealer_id", "visit_date"], "left").na.fill({"service_count": 0})


def lags(grid: DataFrame, steps: list[int] | None = None) -> DataFrame:
    by_day = Window.partitionBy("dealer_id").orderBy("visit_date")
    steps = steps or config.DEMAND_LAGS
    return grid.withColumns({f"lag_{k}": F.lag("service_count", k, 0).over(by_day) for k in steps})


def rolling_mean_prev(grid: DataFrame, days: int = config.DEMAND_WINDOW_DAYS) -> DataFrame:
    """Mean of the previous ``days`` days of the same dealer, 0 on the first day."""
    before = Window.partitionBy("dealer_id").orderBy("visit_date").rowsBetween(-days, -1)
    return grid.withColumn(f"mean_prev_{days}", F.coalesce(F.avg("service_count").over(before), F.lit(0.0)))


def calendar_features(df: DataFrame, day: str = "visit_date") -> DataFrame:
    monday_first = F.weekday(F.col(day))
    return df.withColumns({"day_of_week": monday_first, "is_weekend": (monday_first >= 5).cast("int")})


def demand_series(service: DataFrame, dealers: DataFrame) -> DataFrame:
    return calendar_features(rolling_mean_prev(lags(dense_grid(daily_counts(service, dealers)))))


# ---- claims --------------------------------------------------------------------------


def claims_base(warranty: DataFrame, vehicles: DataFrame, components: DataFrame) -> DataFrame:
    return (
        warranty.join(vehicles.select("vehicle_key", "vehicle_id"), "vehicle_key")
        .join(components.select("component_key", F.col("component_name").alias("component_id")), "component_key")
        .select("claim_id", "vehicle_id", "component_id", "claim_date", F.col("amount").alias("claim_amount"))
    )


def component_stats(claims: DataFrame) -> DataFrame:
    """Median, quartiles and their distance per component."""
    found = exact_quantiles(
        claims, "claim_amount", {"q25": 0.25, "median_amount": 0.5, "q75": 0.75}, ["component_id"]
    )
    return found.withColumn("iqr", F.col("q75") - F.col("q25"))


def vehicle_claims(claims: DataFrame) -> DataFrame:
    """Claims of each vehicle over the whole history."""
    return claims.groupBy("vehicle_id").agg(F.count("claim_id").alias("vehicle_claims"))


def vehicle_claims_recent(claims: DataFrame, days: int = 30) -> DataFrame:
    """Claims of the vehicle in the ``days`` days up to each claim day.

    Counted per day first: the window sees one row per vehicle and day.
    """
    daily = claims.groupBy("vehicle_id", "claim_date").agg(F.count("claim_id").alias("n"))
    number = F.datediff("claim_date", F.lit("1970-01-01").cast("date"))
    span = Window.partitionBy("vehicle_id").orderBy("_d").rangeBetween(-(days - 1), 0)
    return daily.withColumn("_d", number).withColumn("vehicle_claims_recent", F.sum("n").over(span)).drop("n", "_d")


def claim_features(claims: DataFrame) -> DataFrame:
    amount = F.col("claim_amount").cast("double")
    joined = claims.join(component_stats(claims).drop("n"), "component_id", "left").join(
        vehicle_claims(claims), "vehicle_id", "left"
    )
    return joined.withColumns(
        {
            "claim_amount": amount,
            "median_ratio": amount / (F.col("median_amount") + 1e-5),
            "iqr_distance": (amount - F.col("q75")) / (F.col("iqr") + 1e-5),
        }
    )


# ---- splits --------------------------------------------------------------------------


def validate_cutoffs(cutoffs: DataFrame, t_min: Column, t_max: Column, horizon: int = config.HORIZON_DAYS) -> DataFrame:
    """Whether each cutoff leaves a complete outcome window, and why not."""
    c = F.col("cutoff_date")
    latest = F.date_sub(t_max, horizon)
    reason = (
        F.when(
            c > latest,
            F.format_string(
                "Cutoff date %s is censored: forward " + str(horizon) + "-day outcome window exceeds maximum "
                "available date %s (max eligible cutoff is %s)",
                c.cast("string"), t_max.cast("string"), latest.cast("string"),
            ),
        )
        .when(c < t_min, F.format_string("Cutoff date %s precedes minimum available date %s", c.cast("string"), t_min.cast("string")))
        .otherwise("Eligible")
    )
    return cutoffs.withColumns({"eligible": (c <= latest) & (c >= t_min), "reason": reason})


def split_by_dates(df: DataFrame, day: str, train_end: str, val_end: str, test_end: str) -> DataFrame:
    """Chronological thirds; rows after the last date belong to none and are left out."""
    if not train_end < val_end < test_end:
        raise ValueError(f"split dates out of order: {train_end}, {val_end}, {test_end}")
    d = F.col(day).cast("date")
    part = F.when(d <= train_end, "train").when(d <= val_end, "val").when(d <= test_end, "test")
    return df.withColumn("split", part).where(F.col("split").isNotNull())


def split_by_fraction(df: DataFrame, ts: str, tie: str, fractions: tuple[float, float] = (0.70, 0.85)) -> DataFrame:
    return split_by_position(df, ts, tie, fractions)


def holdout_tail(df: DataFrame, day: str, days: int = 7) -> DataFrame:
    """The last ``days`` days are the test part."""
    last = df.agg(F.max(day).alias("d")).scalar()
    return df.withColumn("is_test", F.col(day) > F.date_sub(last, days))


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-independent content hash of a frame: the exact sum of row hashes, and the rows."""
    row = F.xxhash64(*[F.col(c) for c in df.columns]).cast("decimal(38,0)")
    return df.agg(F.coalesce(F.sum(row), F.lit(0)).cast("string").alias("hash_sum"), F.count("*").alias("rows"))
