"""Registered model, metric and drift queries.

Metrics and drift are checked with plain scores both engines can form.  The isolation forest draws by
md5, so SQL grows it again and its scores, thresholds and flags are checked in value.  The random forests of
MLlib have streams of their own: their queries return their values, which the tests check against the
stored nodes.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from motorlake import config
from motorlake.catalog.features import EVAL_CUTOFFS, TRAIN_CUTOFFS, _claims, _inputs, _service
from motorlake.catalog.registry import query
from motorlake.catalog import forest_sql  # noqa: F401  (blocks of the forests)
from motorlake.catalog.sql import BLOCKS, DAY, STAMP, sql
from motorlake.learning import drift, forests, iforest, metrics, registry
from motorlake.operators.cumulative import exact_quantiles, fractional_rank
from motorlake.plans import features, scoring
from motorlake.plans.warehouse import open_warehouse
from motorlake.session import scratch_path, settle

VERSION = "v1.0.0"
STAMPED = "2024-03-05 00:00:00"
ORIGIN = "2024-01-31"

_made: dict[tuple[str, str, str], object] = {}


def once(name, spark, sf_dir, build):
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), name)
    if key not in _made:
        _made[key] = build()
    return _made[key]


def cohorts(spark, sf_dir, cutoffs):
    name = "cohorts-" + ",".join(cutoffs)
    return once(
        name, spark, sf_dir,
        lambda: settle(features.failure_cohorts(*_inputs(spark, sf_dir), cutoffs), "cohorts"),
    )


def risk_model(spark, sf_dir):
    return once("risk", spark, sf_dir, lambda: forests.fit_failure_risk(cohorts(spark, sf_dir, TRAIN_CUTOFFS)))


def series(spark, sf_dir):
    return once("series", spark, sf_dir, lambda: settle(features.demand_series(*_service(spark, sf_dir)), "series"))


def demand_model(spark, sf_dir):
    def build():
        split = features.holdout_tail(series(spark, sf_dir), "visit_date")
        return forests.fit_demand(split.where(~F.col("is_test")))

    return once("demand", spark, sf_dir, build)


def readings(spark, sf_dir):
    def build():
        tel, dtc, _, veh = _inputs(spark, sf_dir)
        rows = features.sensor_features(tel, veh, dtc)
        moment = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS")
        return settle(rows.withColumn("reading_id", F.concat_ws("|", "vehicle_id", moment)), "readings")

    return once("readings", spark, sf_dir, build)


def nominal(spark, sf_dir):
    def build():
        rows = readings(spark, sf_dir).where(~F.col("is_fault_window"))
        return settle(features.split_by_fraction(rows, "timestamp", "reading_id"), "nominal")

    return once("nominal", spark, sf_dir, build)


def sensor_forest(spark, sf_dir):
    def build():
        parts = nominal(spark, sf_dir)
        forest = iforest.fit(parts.where(F.col("split") == 0), config.SENSOR_FEATURES, ["reading_id"])
        forest.calibrate(parts.where(F.col("split") == 1))
        return forest

    return once("sensors", spark, sf_dir, build)


def claims(spark, sf_dir):
    return once("claims", spark, sf_dir, lambda: settle(features.claim_features(_claims(spark, sf_dir)), "claims"))


def claim_forest(spark, sf_dir):
    return once(
        "claimforest", spark, sf_dir, lambda: iforest.fit(claims(spark, sf_dir), config.CLAIM_FEATURES, ["claim_id"])
    )


# ---- checks on plain scores --------------------------------------------------------------

BLOCKS["scored"] = """
SELECT cutoff, vehicle_id, least(1.0, severe_dtc_count / 6.0) AS score, CASE WHEN high_rpm_pings > 0 THEN 1 ELSE 0 END AS label FROM cohorts"""
BLOCKS["curve"] = """
SELECT g, score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM grouped GROUP BY 1, 2"""
BLOCKS["points"] = """
SELECT *, sum(pos) OVER (PARTITION BY g) AS p, sum(neg) OVER (PARTITION BY g) AS n,
sum(pos) OVER (PARTITION BY g ORDER BY score DESC) AS tp, sum(neg) OVER (PARTITION BY g ORDER BY score DESC) AS fp FROM curve"""
BLOCKS["areas"] = """
SELECT g, sum(pos / p * (tp / (tp + fp) + CASE WHEN tp - pos + fp - neg > 0 THEN (tp - pos) / (tp - pos + fp - neg) ELSE 1.0 END) / 2) AS pr_auc,
sum(pos * (n - fp + neg / 2.0)) / max(p) / max(n) AS roc_auc FROM points GROUP BY g"""
BLOCKS["flat"] = """
SELECT g, count(*) AS rows, avg((score - label) * (score - label)) AS brier,
count(*) FILTER (WHERE score >= 0.5 AND label = 1) / count(*) FILTER (WHERE score >= 0.5) AS prec,
count(*) FILTER (WHERE score >= 0.5 AND label = 1) / count(*) FILTER (WHERE label = 1) AS rec FROM grouped GROUP BY g"""
_M = "rows, round(pr_auc, 4) AS pr_auc, round(roc_auc, 4) AS roc_auc, round(brier, 4) AS brier, round(prec, 4) AS precision, round(rec, 4) AS recall"


def plain_scores(spark, sf_dir):
    both = cohorts(spark, sf_dir, TRAIN_CUTOFFS + EVAL_CUTOFFS)
    return both.select(
        "cutoff_date", "vehicle_id",
        F.least(F.lit(1.0), F.col("severe_dtc_count") / F.lit(6.0)).alias("score"),
        (F.col("high_rpm_pings") > 0).cast("int").alias("label"),
    )


@query("g2_risk_tiers", sql("""SELECT CASE WHEN score >= 0.75 THEN 'CRITICAL' WHEN score >= 0.5 THEN 'HIGH' WHEN score >= 0.25 THEN 'MEDIUM' ELSE 'LOW' END AS risk_tier,
count(*) AS rows FROM scored GROUP BY 1"""))
def g2(spark, sf_dir):
    s = plain_scores(spark, sf_dir)
    return s.groupBy(metrics.risk_tier(F.col("score")).alias("risk_tier")).agg(F.count("*").alias("rows"))


@query("g3_classification_metrics", sql(f"SELECT {_M} FROM flat JOIN areas USING (g)", grouped="SELECT 0 AS g, score, label FROM scored"))
def g3(spark, sf_dir):
    return metrics.classification_metrics(plain_scores(spark, sf_dir), "score", "label")


@query(
    "g4_metrics_by_cutoff",
    sql(f"SELECT {DAY.format('g')} AS cutoff_date, {_M} FROM flat JOIN areas USING (g)", grouped="SELECT cutoff AS g, score, label FROM scored"),
)
def g4(spark, sf_dir):
    return metrics.classification_metrics(plain_scores(spark, sf_dir), "score", "label", ["cutoff_date"])


@query(
    "g8_score_summary",
    sql("""SELECT round(avg(s), 4) AS mean_score, round(max(s), 4) AS max_score, round(avg(CASE WHEN s >= 0.9 THEN 1.0 ELSE 0.0 END), 4) AS anomaly_rate,
round(quantile_cont(s, 0.5), 4) AS median_score, 0.9 AS threshold FROM (SELECT vib10 / 150.0 AS s FROM ft)"""),
)
def g8(spark, sf_dir):
    """Summary of a vibration score with its inclusive threshold."""
    s = _inputs(spark, sf_dir)[0].select((F.col("vibration").cast("double") * 10 / 150.0).alias("s"))
    return metrics.score_summary(s, "s", 0.9)


BLOCKS["naive"] = "SELECT service_count AS y, mean_prev_7 AS p, lag_7 AS b FROM series"


@query(
    "g11_regression_metrics",
    sql("SELECT round(sum(abs(y - p)) / (sum(y) + 1e-5), 4) AS wape, round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse FROM naive"),
)
def g11(spark, sf_dir):
    """Errors of the weekly mean as a forecast."""
    return metrics.regression_metrics(series(spark, sf_dir), "service_count", "mean_prev_7")


@query(
    "g12_baseline_lift",
    sql("""SELECT round(avg(abs(y - b)), 4) AS naive_mae, round((avg(abs(y - b)) - avg(abs(y - p))) / (avg(abs(y - b)) + 1e-9), 4) AS lift FROM naive"""),
)
def g12(spark, sf_dir):
    return metrics.baseline_lift(series(spark, sf_dir), "service_count", "mean_prev_7", "lag_7")


BLOCKS["ranked"] = "SELECT *, percent_rank() OVER (ORDER BY claim_amount) AS r FROM cfeat"


@query("g13_outlier_rank", sql("SELECT claim_id, round(r, 12) AS rank_score FROM ranked"))
def g13(spark, sf_dir):
    """Claims ranked by amount, without a global sort in one task."""
    ranked = fractional_rank(claims(spark, sf_dir), "claim_amount")
    return ranked.select("claim_id", F.round("rank_score", 12).alias("rank_score"))


@query(
    "g14_triage",
    sql("""SELECT round(avg(r), 4) AS mean_score, round(max(r), 4) AS max_score, round(min(r), 4) AS min_score, count(*) FILTER (WHERE r >= 0.8) AS triage_count,
round(avg(CASE WHEN r >= 0.8 THEN 1.0 ELSE 0.0 END), 4) AS triage_rate, round(quantile_cont(r, 0.5), 4) AS median_score FROM ranked"""),
)
def g14(spark, sf_dir):
    return metrics.triage_summary(fractional_rank(claims(spark, sf_dir), "claim_amount"), "rank_score")


@query(
    "g15_gates",
    sql("""SELECT round(roc_auc, 4) AS roc_auc, round(pr_auc, 4) AS pr_auc, round(brier, 4) AS brier, round(roc_auc, 4) >= 0.70 AS roc_auc_pass, round(pr_auc, 4) >= 0.35 AS pr_auc_pass,
round(brier, 4) <= 0.15 AS brier_pass, round(roc_auc, 4) >= 0.70 AND round(pr_auc, 4) >= 0.35 AND round(brier, 4) <= 0.15 AS overall_pass FROM flat JOIN areas USING (g)""",
        grouped="SELECT 0 AS g, score, label FROM scored"),
)
def g15(spark, sf_dir):
    m = metrics.classification_metrics(plain_scores(spark, sf_dir), "score", "label")
    return metrics.gates(m.select("roc_auc", "pr_auc", "brier"), ["roc_auc", "pr_auc", "brier"])


@query(
    "g19_forecast_grid",
    sql(f"""SELECT dealer_id, {DAY.format('d')} AS forecast_date, lag_7, lag_14, round(mean_prev_7, 9) AS mean_prev_7, isodow(d) - 1 AS day_of_week,
CASE WHEN isodow(d) >= 6 THEN 1 ELSE 0 END AS is_weekend
FROM (SELECT dealer_id, lag_7, lag_14, mean_prev_7, CAST(DATE '2024-01-31' + h AS DATE) AS d FROM series CROSS JOIN (SELECT CAST(unnest(generate_series(1, 14)) AS INT) AS h)
      WHERE visit_date = (SELECT max(visit_date) FROM series WHERE visit_date <= DATE '2024-01-31'))"""),
)
def g19_grid(spark, sf_dir):
    """Inputs of the fourteen-day forecast."""
    return scoring.forecast_grid(series(spark, sf_dir), ORIGIN).withColumn("mean_prev_7", F.round("mean_prev_7", 9))


_DRIFT = ["rpm", "temperature", "battery", "vibration"]
BLOCKS["long"] = "\nUNION ALL ".join(
    f"SELECT '{n}' AS feature, CAST({c} AS DOUBLE) AS v, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 1 ELSE 0 END AS ref FROM ft"
    for n, c in (("rpm", "rpm"), ("temperature", "temp"), ("battery", "bat10 / 10.0"), ("vibration", "vib10 / 10.0"))
)
BLOCKS["edge_raw"] = """
SELECT feature, unnest([q[1] - 1e-5] || q[2:10] || [q[11] + 1e-5]) AS e FROM (
SELECT feature, quantile_cont(v, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q FROM long WHERE ref = 1 GROUP BY 1)"""
BLOCKS["edge"] = """
SELECT feature, e AS lo, lead(e) OVER (PARTITION BY feature ORDER BY e) AS hi, max(e) OVER (PARTITION BY feature) AS top,
count(*) OVER (PARTITION BY feature) - 1 AS bins FROM (SELECT DISTINCT feature, e FROM edge_raw)"""
BLOCKS["binned"] = """
SELECT e.feature, e.lo, max(bins) AS bins, count(*) FILTER (WHERE ref = 1) AS r, count(*) FILTER (WHERE ref = 0) AS c
FROM edge e LEFT JOIN long l ON l.feature = e.feature AND l.v >= e.lo AND (l.v < e.hi OR (e.hi = e.top AND l.v = e.top))
WHERE e.hi IS NOT NULL GROUP BY 1, 2"""
BLOCKS["sizes"] = "SELECT feature, count(*) FILTER (WHERE ref = 1) AS nr, count(*) FILTER (WHERE ref = 0) AS nc FROM long GROUP BY 1"
BLOCKS["psi"] = """
SELECT feature, round(sum(((c + 1e-4) / (nc + 1e-4 * bins) - (r + 1e-4) / (nr + 1e-4 * bins)) *
  ln(((c + 1e-4) / (nc + 1e-4 * bins)) / ((r + 1e-4) / (nr + 1e-4 * bins)))), 4) AS psi FROM binned JOIN sizes USING (feature) GROUP BY 1"""
BLOCKS["ks"] = """
SELECT feature, max(abs(a / nr - b / nc)) AS ks FROM (SELECT DISTINCT feature, v, sum(ref) OVER w AS a, sum(1 - ref) OVER w AS b
FROM long WINDOW w AS (PARTITION BY feature ORDER BY v)) JOIN sizes USING (feature) GROUP BY 1"""


def _halves(spark, sf_dir):
    tel = _inputs(spark, sf_dir)[0]
    middle = F.lit("2024-01-16").cast("timestamp_ntz")
    return tel.where(F.col("timestamp") < middle), tel.where(F.col("timestamp") >= middle)


@query("g21_psi", sql("SELECT feature, psi, nr AS n_ref, nc AS n_cur FROM psi JOIN sizes USING (feature)"))
def g21(spark, sf_dir):
    """Drift of the second half of the month against the first."""
    return drift.psi(*_halves(spark, sf_dir), _DRIFT).select("feature", "psi", "n_ref", "n_cur")


@query("g22_ks_statistic", sql("SELECT feature, round(ks, 9) AS ks, nr AS n_ref, nc AS n_cur FROM ks JOIN sizes USING (feature)"))
def g22(spark, sf_dir):
    return drift.ks_statistic(*_halves(spark, sf_dir), _DRIFT).withColumn("ks", F.round("ks", 9))


#: The Kolmogorov series, as long as the library takes it.
BLOCKS["ks_p"] = """
SELECT feature, ks, CASE WHEN x < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, 2.0 * list_sum(
  [CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END * exp(-2.0 * k * k * x * x) FOR k IN range(1, 101)]))) END AS p
FROM (SELECT feature, ks, sqrt(CAST(nr AS DOUBLE) * nc / (nr + nc)) * ks AS x FROM ks JOIN sizes USING (feature))"""


@query(
    "g23_drift_report",
    sql(f"""SELECT feature, psi, round(ks, 4) AS ks_statistic, round(p, 4) AS ks_pvalue, psi >= {config.PSI_LIMIT} OR p < {config.KS_ALPHA} AS drift_detected
FROM psi JOIN ks_p USING (feature)"""),
)
def g23(spark, sf_dir):
    """PSI, KS statistic, its asymptotic p-value and the decision, per feature."""
    return drift.drift_report(*_halves(spark, sf_dir), _DRIFT)


# ---- trained models ----------------------------------------------------------------------

BLOCKS["nominal_n"] = """
SELECT n, CAST(floor(n * 0.70 + 1e-9) AS BIGINT) AS a, CAST(floor(n * 0.85 + 1e-9) AS BIGINT) AS b
FROM (SELECT count(*) AS n FROM near_fault WHERE NOT is_fault_window)"""
#: Map values as SQL writes them beside Spark's to_json, rounded.
_READINGS = ["rpm", "temperature", "vibration"]


def _readings_of(column):
    return [F.round(F.try_element_at(column, F.lit(c)), 6).alias(c) for c in _READINGS]


@query("g1_failure_risk")
def g1(spark, sf_dir):
    """Pooled metrics of the trained risk model on later cutoffs."""
    scored = forests.score_failure_risk(risk_model(spark, sf_dir), cohorts(spark, sf_dir, EVAL_CUTOFFS))
    return metrics.classification_metrics(settle(scored.select("risk_score", "target"), "risk"), "risk_score", "target")


@query(
    "g5_iforest_nodes",
    sql("SELECT tree, heap, coalesce(f - 1, -1) AS feature, round(coalesce(cut, 0.0), 6) AS split, size, depth FROM sensor_nodes"),
)
def g5(spark, sf_dir):
    """Every node of the sensor forest: feature and cut (-1 and 0 at a leaf), rows of the sample and depth."""
    nodes = sensor_forest(spark, sf_dir).nodes
    return nodes.select("tree", "heap", "feature", F.round("split", 6).alias("split"), "size", "depth")


@query("g6_iforest_score", sql(f"SELECT vehicle_id, {STAMP.format('ts')} AS timestamp, round(score, 6) AS anomaly_score FROM sensor_rows JOIN sensor_scored USING (uid)"))
def g6(spark, sf_dir):
    """Normalised scores of all readings."""
    forest = sensor_forest(spark, sf_dir)
    return readings(spark, sf_dir).select("vehicle_id", "timestamp", F.round(forest.score(), 6).alias("anomaly_score"))


@query(
    "g7_calibrated_threshold",
    sql("""SELECT part, count(*) AS rows, round(avg(CASE WHEN score >= threshold THEN 1.0 ELSE 0.0 END), 6) AS flag_rate, round(max(threshold), 6) AS threshold
FROM (SELECT CAST(split AS VARCHAR) AS part, uid FROM sensor_nominal UNION ALL SELECT 'fault', uid FROM sensor_rows WHERE is_fault_window)
JOIN sensor_scored USING (uid), (SELECT * FROM sensor_limit) GROUP BY part"""),
)
def g7(spark, sf_dir):
    """Flag rates of the three nominal parts and of the fault windows at the frozen threshold."""
    forest = sensor_forest(spark, sf_dir)
    parts = nominal(spark, sf_dir).select(F.col("split").cast("string").alias("part"), *config.SENSOR_FEATURES)
    fault = readings(spark, sf_dir).where("is_fault_window").select(F.lit("fault").alias("part"), *config.SENSOR_FEATURES)
    scored = parts.unionByName(fault).withColumn("score", forest.score())
    return scored.groupBy("part").agg(
        F.count("*").alias("rows"), F.round(F.avg((F.col("score") >= forest.threshold).cast("int")), 6).alias("flag_rate")
    ).withColumn("threshold", F.round(F.lit(forest.threshold), 6))


@query("g9_demand_forecast")
def g9(spark, sf_dir):
    """Errors of the demand model on the held-out week, with the naive lift."""
    split = features.holdout_tail(series(spark, sf_dir), "visit_date")
    predicted = forests.predict_demand(demand_model(spark, sf_dir), split.where("is_test"))
    m = metrics.regression_metrics(predicted, "service_count", "predicted_volume")
    lift = metrics.baseline_lift(predicted, "service_count", "predicted_volume", "lag_7")
    return m.withColumns({c: lift.select(c).scalar() for c in ("naive_mae", "lift")})


@query("g10_prediction_intervals")
def g10(spark, sf_dir):
    """Point forecast and 80% interval of every dealer-day."""
    out = forests.predict_interval(demand_model(spark, sf_dir), series(spark, sf_dir), scratch_path(spark, "forest"))
    return out.select("dealer_id", "visit_date", "predicted_volume", "lower_bound_80", "upper_bound_80")


@query(
    "g16_model_registry",
    sql(f"""SELECT 'sensor_anomaly_iforest' AS model_id, 'v1.' || (split - 1) || '.0' AS model_version, CAST(count(*) AS DOUBLE) AS rows,
round(avg(CASE WHEN score >= threshold THEN 1.0 ELSE 0.0 END), 6) AS flag_rate, {len(config.SENSOR_FEATURES)} AS features
FROM sensor_nominal JOIN sensor_scored USING (uid), (SELECT * FROM sensor_limit) WHERE split > 0 GROUP BY split"""),
)
def g16(spark, sf_dir):
    """Registry after registering a version twice and another once."""
    forest = sensor_forest(spark, sf_dir)
    path = scratch_path(spark, "model")
    forest.save(path)
    data = features.fingerprint(nominal(spark, sf_dir).select("telemetry_fact_id")).first()["hash_sum"]
    row = lambda v, m: registry.entry(
        spark, "sensor_anomaly_iforest", v, STAMPED, data, forest.features, forest.settings(), m, path
    )
    table = registry.empty_registry(spark)
    measured = {
        r["split"]: {"rows": float(r["rows"]), "flag_rate": r["rate"]}
        for r in nominal(spark, sf_dir).select("split", (forest.score() >= forest.threshold).cast("int").alias("f"))
        .groupBy("split").agg(F.count("*").alias("rows"), F.avg("f").alias("rate")).collect()  # three parts
    }
    for entry in (row("v1.0.0", measured[0]), row("v1.0.0", measured[1]), row("v1.1.0", measured[2])):
        table = registry.register(table, entry)
    return table.select(
        "model_id", "model_version", F.element_at("metrics", "rows").alias("rows"),
        F.round(F.element_at("metrics", "flag_rate"), 6).alias("flag_rate"), F.size("feature_names").alias("features"),
    )


@query("g17_score_failure_risk")
def g17(spark, sf_dir):
    """Risk predictions of the trained model on later cutoffs."""
    out = scoring.failure_predictions(risk_model(spark, sf_dir), cohorts(spark, sf_dir, EVAL_CUTOFFS), VERSION, STAMPED)
    return out.withColumn("top_features", F.to_json("top_features"))


@query(
    "g18_score_sensors",
    sql(f"""SELECT md5(vehicle_id || '|' || CAST(ts AS VARCHAR)) AS anomaly_id, vehicle_id, {STAMP.format('ts')} AS window_timestamp, round(score, 6) AS anomaly_score,
score >= threshold AS is_anomaly, CASE WHEN score >= threshold THEN CAST(rpm AS DOUBLE) END AS rpm, CASE WHEN score >= threshold THEN CAST(temp AS DOUBLE) END AS temperature,
CASE WHEN score >= threshold THEN vib10 / 10.0 END AS vibration, '{VERSION}' AS model_version, '{STAMPED}' AS detected_at
FROM sensor_rows JOIN sensor_scored USING (uid), (SELECT * FROM sensor_limit)"""),
)
def g18(spark, sf_dir):
    """Sensor predictions of all readings: score, flag and the readings of flagged ones."""
    out = scoring.sensor_anomalies(sensor_forest(spark, sf_dir), readings(spark, sf_dir), VERSION, STAMPED)
    return out.select(
        "anomaly_id", "vehicle_id", "window_timestamp", F.round("anomaly_score", 6).alias("anomaly_score"), "is_anomaly",
        *_readings_of("anomalous_features"), "model_version", "detected_at",
    )


@query("g19_demand_forecast_14d")
def g19(spark, sf_dir):
    """Fourteen days of demand for every dealer, with intervals."""
    return scoring.demand_forecasts(
        demand_model(spark, sf_dir), series(spark, sf_dir), ORIGIN, scratch_path(spark, "forest"), VERSION, STAMPED
    )


@query(
    "g20_score_claims",
    sql(f"""SELECT md5(claim_id) AS anomaly_id, claim_id, component_id, claim_amount, round(rank, 6) AS anomaly_score,
CASE WHEN rank >= {config.TRIAGE_RANK} THEN round(median_ratio, 6) END AS median_ratio, CASE WHEN rank >= {config.TRIAGE_RANK} THEN round(iqr_distance, 6) END AS iqr_distance,
'{VERSION}' AS model_version, '{STAMPED}' AS flagged_at
FROM (SELECT *, percent_rank() OVER (ORDER BY -raw) AS rank FROM cfeat JOIN claim_scored ON uid = claim_id)"""),
)
def g20(spark, sf_dir):
    """Claim predictions: rank by isolation, and the reasons of flagged claims."""
    out = scoring.score_claims(claim_forest(spark, sf_dir), claims(spark, sf_dir), VERSION, STAMPED)
    reason = lambda c: F.round(F.try_element_at("outlier_reasons", F.lit(c)), 6).alias(c)
    return out.select(
        "anomaly_id", "claim_id", "component_id", "claim_amount", F.round("anomaly_score", 6).alias("anomaly_score"),
        reason("median_ratio"), reason("iqr_distance"), "model_version", "flagged_at",
    )


@query(
    "g24_governed_threshold",
    sql("SELECT count(*) AS readings, count(*) FILTER (WHERE score >= threshold) AS flagged, round(max(threshold), 6) AS threshold FROM sensor_rows JOIN sensor_scored USING (uid), (SELECT * FROM sensor_limit)"),
)
def g24(spark, sf_dir):
    """Readings at or above the threshold fetched from the registry."""
    forest = sensor_forest(spark, sf_dir)
    table = registry.entry(spark, "sensor_anomaly_iforest", VERSION, STAMPED, "", forest.features, forest.settings(), {}, "")
    limit = registry.load_threshold(table, "sensor_anomaly_iforest", VERSION)
    scored = readings(spark, sf_dir).select(forest.score().alias("s"))
    return scored.agg(
        F.count("*").alias("readings"), F.count_if(F.col("s") >= limit).alias("flagged"), F.round(F.lit(limit), 6).alias("threshold")
    )
