"""Registered feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from motorlake import config
from motorlake.catalog.registry import query
from motorlake.catalog.sql import BLOCKS, DAY, STAMP, sql
from motorlake.functions.text import is_breakdown
from motorlake.plans import features
from motorlake.plans.warehouse import open_warehouse

TRAIN_CUTOFFS = [f"2024-01-{d:02d}" for d in (8, 9, 10, 11, 12, 13)]
EVAL_CUTOFFS = [f"2024-01-{d:02d}" for d in (14, 15, 16)]
CUTOFFS = TRAIN_CUTOFFS + EVAL_CUTOFFS

BLOCKS["cutoffs"] = "SELECT unnest([" + ", ".join(f"DATE '{c}'" for c in CUTOFFS) + "]) AS cutoff"
BLOCKS["tel_v"] = "SELECT t.*, v.vehicle_id FROM ft t JOIN dim_vehicle v USING (vehicle_key)"
BLOCKS["tel_cut"] = """
SELECT cutoff, t.* FROM tel_v t JOIN cutoffs c ON CAST(t.ts AS DATE) BETWEEN c.cutoff - 7 AND c.cutoff"""
BLOCKS["tel_feat"] = """
SELECT cutoff, vehicle_id, CAST(sum(temp) AS DOUBLE) / count(*) AS avg_engine_temp, CAST(max(temp) AS DOUBLE) AS max_engine_temp,
CASE WHEN count(*) > 1 THEN sqrt(CAST(count(*) * sum(CAST(vib10 * 100 AS HUGEINT) * vib10 * 100) - sum(vib10 * 100) * sum(vib10 * 100) AS DOUBLE)
  / CAST(count(*) * (count(*) - 1) AS DOUBLE)) / 1000 END AS vibration_stddev,
min(bat10) / 10.0 AS battery_min, count(*) FILTER (WHERE rpm > 4500) AS high_rpm_pings
FROM tel_cut GROUP BY cutoff, vehicle_id"""
BLOCKS["dtc_feat"] = """
SELECT cutoff, vehicle_id, count(*) AS severe_dtc_count FROM bridge JOIN cutoffs ON CAST(ts AS DATE) BETWEEN cutoff - 7 AND cutoff
WHERE severity IN ('CRITICAL', 'HIGH') GROUP BY 1, 2"""
BLOCKS["srv_v"] = """
SELECT s.*, v.vehicle_id, issue <> 'Scheduled routine maintenance and multi-point inspection'
  AND regexp_matches(lower(issue), 'repair|replacement|failure|leak|solenoid|strut|rotor|pump|alternator') AS broke
FROM fs s JOIN dim_vehicle v USING (vehicle_key)"""
BLOCKS["srv_feat"] = """
SELECT cutoff, vehicle_id, count(*) AS service_count, max(visit_date) AS last_service_date
FROM srv_v JOIN cutoffs ON visit_date <= cutoff GROUP BY 1, 2"""
BLOCKS["label"] = """
SELECT cutoff, vehicle_id FROM srv_v JOIN cutoffs ON visit_date > cutoff AND visit_date <= cutoff + 14 WHERE broke
UNION SELECT cutoff, vehicle_id FROM bridge JOIN cutoffs ON CAST(ts AS DATE) > cutoff AND CAST(ts AS DATE) <= cutoff + 14
WHERE severity IN ('CRITICAL', 'HIGH')"""
BLOCKS["cohorts"] = """
SELECT t.cutoff, t.vehicle_id, avg_engine_temp, max_engine_temp, coalesce(vibration_stddev, 0) AS vibration_stddev, battery_min,
high_rpm_pings, coalesce(severe_dtc_count, 0) AS severe_dtc_count, coalesce(service_count, 0) AS service_count,
coalesce(greatest(0, date_diff('day', last_service_date, t.cutoff)), 180) AS days_since_service,
CASE WHEN l.vehicle_id IS NULL THEN 0 ELSE 1 END AS target
FROM tel_feat t LEFT JOIN dtc_feat d ON t.cutoff = d.cutoff AND t.vehicle_id = d.vehicle_id
LEFT JOIN srv_feat s ON t.cutoff = s.cutoff AND t.vehicle_id = s.vehicle_id
LEFT JOIN label l ON t.cutoff = l.cutoff AND t.vehicle_id = l.vehicle_id"""
_C = DAY.format("cutoff") + " AS cutoff_date"
_TEL = ("vehicle_id, round(avg_engine_temp, 9) AS avg_engine_temp, max_engine_temp, round(vibration_stddev, 9) AS vibration_stddev, "
        "battery_min, high_rpm_pings")

BLOCKS["demand_day"] = "SELECT dealer_id, visit_date, count(*) AS n FROM fs JOIN dim_dealer USING (dealer_key) GROUP BY 1, 2"
BLOCKS["grid"] = """
SELECT dealer_id, visit_date, coalesce(n, 0) AS service_count
FROM (SELECT dealer_id, CAST(d AS DATE) AS visit_date FROM (SELECT DISTINCT dealer_id FROM demand_day)
      CROSS JOIN (SELECT unnest(generate_series((SELECT min(visit_date) FROM demand_day), (SELECT max(visit_date) FROM demand_day), INTERVAL 1 DAY)) AS d))
LEFT JOIN demand_day USING (dealer_id, visit_date)"""
BLOCKS["series"] = """
SELECT *, lag(service_count, 7, 0) OVER w AS lag_7, lag(service_count, 14, 0) OVER w AS lag_14,
coalesce(avg(service_count) OVER (PARTITION BY dealer_id ORDER BY visit_date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 0) AS mean_prev_7,
isodow(visit_date) - 1 AS day_of_week, CASE WHEN isodow(visit_date) >= 6 THEN 1 ELSE 0 END AS is_weekend
FROM grid WINDOW w AS (PARTITION BY dealer_id ORDER BY visit_date)"""
BLOCKS["claims"] = """
SELECT claim_id, vehicle_id, component_name AS component_id, claim_date, cents / 100.0 AS claim_amount
FROM fw JOIN dim_vehicle USING (vehicle_key) JOIN dim_component USING (component_key)"""
BLOCKS["cstats"] = """
SELECT component_id, quantile_cont(claim_amount, 0.25) AS q25, quantile_cont(claim_amount, 0.5) AS median_amount,
quantile_cont(claim_amount, 0.75) AS q75, count(*) AS n FROM claims GROUP BY 1"""
BLOCKS["cfeat"] = """
SELECT claim_id, c.vehicle_id, c.component_id, claim_date, claim_amount, claim_amount / (median_amount + 1e-5) AS median_ratio,
(claim_amount - q75) / (q75 - q25 + 1e-5) AS iqr_distance, vehicle_claims
FROM claims c JOIN cstats USING (component_id)
JOIN (SELECT vehicle_id, count(*) AS vehicle_claims FROM claims GROUP BY 1) v ON c.vehicle_id = v.vehicle_id"""
BLOCKS["near_fault"] = """
SELECT t.*, EXISTS (SELECT 1 FROM bridge b WHERE b.severity IN ('CRITICAL', 'HIGH') AND b.vehicle_id = t.vehicle_id
  AND t.ts >= b.ts - INTERVAL 2 HOUR AND t.ts <= b.ts + INTERVAL 6 HOUR) AS is_fault_window FROM tel_v t"""


def _inputs(spark, sf_dir):
    names = "fact_telemetry", "silver_diagnostics", "fact_service", "dim_vehicle"
    return tuple(map(open_warehouse(spark, sf_dir, *names).table, names))


@query("f1_active_cohort", sql(f"SELECT DISTINCT {_C}, vehicle_id, vehicle_key FROM tel_cut"))
def f1(spark, sf_dir):
    tel, _, _, veh = _inputs(spark, sf_dir)
    return features.cohort(tel, veh, CUTOFFS).select("cutoff_date", "vehicle_id", "vehicle_key")


@query("f2_telemetry_window_features", sql(f"SELECT {_C}, {_TEL} FROM tel_feat"))
def f2(spark, sf_dir):
    tel, _, _, veh = _inputs(spark, sf_dir)
    df = features.telemetry_window_features(tel, veh, CUTOFFS)
    return df.withColumns({c: F.round(c, 9) for c in ("avg_engine_temp", "vibration_stddev")})


@query("f3_dtc_count", sql(f"SELECT {_C}, vehicle_id, severe_dtc_count FROM dtc_feat"))
def f3(spark, sf_dir):
    return features.dtc_count(_inputs(spark, sf_dir)[1], CUTOFFS)


@query("f4_service_history", sql(f"SELECT {_C}, vehicle_id, service_count, {DAY.format('last_service_date')} AS last_service_date FROM srv_feat"))
def f4(spark, sf_dir):
    _, _, srv, veh = _inputs(spark, sf_dir)
    return features.service_history(srv, veh, CUTOFFS)


@query("f5_forward_label", sql(f"SELECT {_C}, vehicle_id FROM label"))
def f5(spark, sf_dir):
    _, dtc, srv, veh = _inputs(spark, sf_dir)
    return features.forward_label(srv, dtc, veh, CUTOFFS)


@query("f6_breakdown_text", sql("""SELECT issue, count(*) AS visits, issue <> 'Scheduled routine maintenance and multi-point inspection'
  AND regexp_matches(lower(issue), 'repair|replacement|failure|leak|solenoid|strut|rotor|pump|alternator') AS is_breakdown FROM srv_raw GROUP BY 1"""))
def f6(spark, sf_dir):
    from motorlake.sources.adapters import raw_set

    counted = raw_set(spark, sf_dir, "service").groupBy("issue").agg(F.count("*").alias("visits"))
    return counted.withColumn("is_breakdown", is_breakdown(F.col("issue")))


@query(
    "f7_assembled_defaults",
    sql("""SELECT count(*) AS rows, count(*) FILTER (WHERE vibration_stddev = 0) AS no_stddev, count(*) FILTER (WHERE severe_dtc_count = 0) AS no_dtc,
count(*) FILTER (WHERE service_count = 0) AS no_service, CAST(sum(target) AS BIGINT) AS positives FROM cohorts"""),
)
def f7(spark, sf_dir):
    """How many assembled rows hold a default."""
    df = features.failure_cohorts(*_inputs(spark, sf_dir), CUTOFFS)
    return df.agg(
        F.count("*").alias("rows"), F.count_if(F.col("vibration_stddev") == 0).alias("no_stddev"),
        F.count_if(F.col("severe_dtc_count") == 0).alias("no_dtc"),
        F.count_if(F.col("service_count") == 0).alias("no_service"), F.sum("target").alias("positives"),
    )


@query("f8_days_since_service", sql("SELECT days_since_service, count(*) AS rows FROM cohorts GROUP BY 1"))
def f8(spark, sf_dir):
    df = features.failure_cohorts(*_inputs(spark, sf_dir), CUTOFFS)
    return df.groupBy("days_since_service").agg(F.count("*").alias("rows"))


@query(
    "f9_failure_cohorts",
    sql(f"SELECT {_C}, {_TEL}, severe_dtc_count, service_count, days_since_service, target FROM cohorts"),
)
def f9(spark, sf_dir):
    """All features and targets of nine cutoffs in one pass."""
    df = features.failure_cohorts(*_inputs(spark, sf_dir), CUTOFFS)
    return df.withColumns({c: F.round(c, 9) for c in ("avg_engine_temp", "vibration_stddev")})


@query(
    "f10_robust_scale",
    sql(f"""SELECT vehicle_id, {STAMP.format('ts')} AS timestamp, round((rpm - (SELECT quantile_cont(CAST(rpm AS DOUBLE), 0.5) FROM tel_v)) /
  ((SELECT quantile_cont(CAST(rpm AS DOUBLE), 0.75) - quantile_cont(CAST(rpm AS DOUBLE), 0.25) FROM tel_v) + 1e-5), 6) AS norm_rpm,
round((temp - (SELECT quantile_cont(CAST(temp AS DOUBLE), 0.5) FROM tel_v)) /
  ((SELECT quantile_cont(CAST(temp AS DOUBLE), 0.75) - quantile_cont(CAST(temp AS DOUBLE), 0.25) FROM tel_v) + 1e-5), 6) AS norm_temperature,
round((vib10 / 10.0 - (SELECT quantile_cont(vib10 / 10.0, 0.5) FROM tel_v)) /
  ((SELECT quantile_cont(vib10 / 10.0, 0.75) - quantile_cont(vib10 / 10.0, 0.25) FROM tel_v) + 1e-5), 6) AS norm_vibration FROM tel_v"""),
)
def f10(spark, sf_dir):
    tel, _, _, veh = _inputs(spark, sf_dir)
    df = features.sensor_features(tel, veh, None)
    return df.select(
        "vehicle_id", "timestamp", *[F.round(f"norm_{c}", 6).alias(f"norm_{c}") for c in ("rpm", "temperature", "vibration")]
    )


@query(
    "f11_vibration_ratio",
    sql(f"SELECT vehicle_key, {STAMP.format('ts')} AS timestamp, vib10 / 10.0 / (rpm + 1.0) AS vibration_per_rpm FROM ft"),
)
def f11(spark, sf_dir):
    return _inputs(spark, sf_dir)[0].select("vehicle_key", "timestamp", features.ratio().alias("vibration_per_rpm"))


@query("f12_fault_windows", sql(f"SELECT vehicle_id, {STAMP.format('ts')} AS timestamp, rpm, is_fault_window FROM near_fault"))
def f12(spark, sf_dir):
    tel, dtc, _, veh = _inputs(spark, sf_dir)
    rows = tel.join(veh.select("vehicle_key", "vehicle_id"), "vehicle_key").select("vehicle_id", "timestamp", "rpm")
    return features.flag_fault_windows(rows, dtc)


def _service(spark, sf_dir):
    t = open_warehouse(spark, sf_dir).table
    return t("fact_service"), t("dim_dealer")


@query("f13_daily_counts", sql(f"SELECT dealer_id, {DAY.format('visit_date')} AS visit_date, n AS service_count FROM demand_day"))
def f13(spark, sf_dir):
    return features.daily_counts(*_service(spark, sf_dir))


@query("f14_dense_grid", sql(f"SELECT dealer_id, {DAY.format('visit_date')} AS visit_date, service_count FROM grid"))
def f14(spark, sf_dir):
    return features.dense_grid(features.daily_counts(*_service(spark, sf_dir)))


_DV = f"dealer_id, {DAY.format('visit_date')} AS visit_date"


@query("f15_lags", sql(f"SELECT {_DV}, service_count, lag_7, lag_14 FROM series"))
def f15(spark, sf_dir):
    return features.lags(features.dense_grid(features.daily_counts(*_service(spark, sf_dir))))


@query("f16_rolling_mean", sql(f"SELECT {_DV}, service_count, round(mean_prev_7, 9) AS mean_prev_7 FROM series"))
def f16(spark, sf_dir):
    df = features.rolling_mean_prev(features.dense_grid(features.daily_counts(*_service(spark, sf_dir))))
    return df.withColumn("mean_prev_7", F.round("mean_prev_7", 9))


@query("f17_demand_series", sql(f"SELECT {_DV}, service_count, lag_7, lag_14, round(mean_prev_7, 9) AS mean_prev_7, day_of_week, is_weekend FROM series"))
def f17(spark, sf_dir):
    return features.demand_series(*_service(spark, sf_dir)).withColumn("mean_prev_7", F.round("mean_prev_7", 9))


def _claims(spark, sf_dir):
    t = open_warehouse(spark, sf_dir).table
    return features.claims_base(t("fact_warranty"), t("dim_vehicle"), t("dim_component"))


@query(
    "f18_component_stats",
    sql("SELECT component_id, round(q25, 6) AS q25, round(median_amount, 6) AS median_amount, round(q75, 6) AS q75, round(q75 - q25, 6) AS iqr, n FROM cstats"),
)
def f18(spark, sf_dir):
    df = features.component_stats(_claims(spark, sf_dir))
    return df.withColumns({c: F.round(c, 6) for c in ("q25", "median_amount", "q75", "iqr")})


@query(
    "f19_claim_ratios",
    sql("SELECT claim_id, claim_amount, round(median_ratio, 6) AS median_ratio, round(iqr_distance, 5) AS iqr_distance FROM cfeat"),
)
def f19(spark, sf_dir):
    """Amount against the component's median and quartiles."""
    df = features.claim_features(_claims(spark, sf_dir))
    return df.select("claim_id", "claim_amount", F.round("median_ratio", 6).alias("median_ratio"), F.round("iqr_distance", 5).alias("iqr_distance"))


@query("f20_vehicle_claims", sql("SELECT claim_id, vehicle_id, vehicle_claims FROM cfeat"))
def f20(spark, sf_dir):
    claims = _claims(spark, sf_dir)
    return claims.join(features.vehicle_claims(claims), "vehicle_id").select("claim_id", "vehicle_id", "vehicle_claims")


@query(
    "f20_vehicle_claims_30d",
    sql(f"""SELECT DISTINCT vehicle_id, {DAY.format('claim_date')} AS claim_date,
count(*) OVER (PARTITION BY vehicle_id ORDER BY claim_date RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW) AS vehicle_claims_recent FROM claims"""),
)
def f20_recent(spark, sf_dir):
    return features.vehicle_claims_recent(_claims(spark, sf_dir))


@query(
    "f21_cutoff_eligibility",
    sql(f"""SELECT {DAY.format('d')} AS cutoff_date, d <= hi - 14 AND d >= lo AS eligible,
CASE WHEN d > hi - 14 THEN 'Cutoff date ' || d || ' is censored: forward 14-day outcome window exceeds maximum available date ' || hi || ' (max eligible cutoff is ' || (hi - 14) || ')'
     WHEN d < lo THEN 'Cutoff date ' || d || ' precedes minimum available date ' || lo ELSE 'Eligible' END AS reason
FROM (SELECT DISTINCT visit_date AS d FROM fs) CROSS JOIN (SELECT CAST(min(ts) AS DATE) AS lo, CAST(max(ts) AS DATE) AS hi FROM ft)"""),
)
def f21(spark, sf_dir):
    """Every visit day as a cutoff against the span of the readings."""
    tel, _, srv, _ = _inputs(spark, sf_dir)
    day = F.col("timestamp").cast("date")
    low, high = tel.agg(F.min(day).alias("d")).scalar(), tel.agg(F.max(day).alias("d")).scalar()
    days = srv.select(F.col("visit_date").alias("cutoff_date")).distinct()
    return features.validate_cutoffs(days, low, high)


@query(
    "f22_split_by_dates",
    sql(f"""SELECT service_id, CASE WHEN visit_date <= DATE '2024-01-10' THEN 'train' WHEN visit_date <= DATE '2024-01-25' THEN 'val' ELSE 'test' END AS split
FROM fs WHERE visit_date <= DATE '2024-02-10'"""),
)
def f22(spark, sf_dir):
    srv = _inputs(spark, sf_dir)[2]
    return features.split_by_dates(srv, "visit_date", "2024-01-10", "2024-01-25", "2024-02-10").select("service_id", "split")


@query(
    "f23_split_by_position",
    sql("""SELECT service_id, CASE WHEN rn <= floor(n * 0.70 + 1e-9) THEN 0 WHEN rn <= floor(n * 0.85 + 1e-9) THEN 1 ELSE 2 END AS split
FROM (SELECT service_id, row_number() OVER (ORDER BY visit_date, service_id) AS rn, count(*) OVER () AS n FROM fs)"""),
)
def f23(spark, sf_dir):
    """70/15/15 by position; hundreds of visits share each day, so both cuts fall inside ties."""
    srv = _inputs(spark, sf_dir)[2].select("service_id", "visit_date")
    return features.split_by_fraction(srv, "visit_date", "service_id").select("service_id", "split")


@query(
    "f24_holdout_tail",
    sql("SELECT dealer_id, visit_date > (SELECT max(visit_date) FROM series) - 7 AS is_test, count(*) AS days, CAST(sum(service_count) AS BIGINT) AS visits FROM series GROUP BY 1, 2"),
)
def f24(spark, sf_dir):
    df = features.holdout_tail(features.demand_series(*_service(spark, sf_dir)), "visit_date")
    return df.groupBy("dealer_id", "is_test").agg(F.count("*").alias("days"), F.sum("service_count").alias("visits"))


@query(
    "f25_fingerprint",
    sql(f"""SELECT count(*) AS rows, CAST(sum(CAST('0x' || substr(md5(vehicle_id || '|' || {DAY.format('cutoff')} || '|' || target), 1, 8) AS BIGINT)) AS BIGINT) AS key_sum,
TRUE AS layout_free FROM cohorts WHERE cutoff <= DATE '{TRAIN_CUTOFFS[-1]}'"""),
)
def f25(spark, sf_dir):
    """Content hash of the training frame, the same in any layout, and a hash of its keys that SQL can form."""
    frame = features.failure_cohorts(*_inputs(spark, sf_dir), TRAIN_CUTOFFS)
    key = F.md5(F.concat_ws("|", "vehicle_id", F.date_format("cutoff_date", "yyyy-MM-dd"), F.col("target").cast("string")))
    dealt = features.fingerprint(frame.repartition(7, "vehicle_id")).select("hash_sum").scalar()
    same = (features.fingerprint(frame).select("hash_sum").scalar() == dealt).alias("layout_free")
    return frame.agg(
        F.count("*").alias("rows"), F.sum(F.conv(F.substring(key, 1, 8), 16, 10).cast("long")).alias("key_sum")
    ).select("rows", "key_sum", same)
