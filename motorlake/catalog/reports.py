"""Registered report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from motorlake import config
from motorlake.catalog.actions import mean_forecasts, ranked_claims, risk_predictions, severe_actions, vibration_scores
from motorlake.catalog.registry import query
from motorlake.catalog.sql import BLOCKS, DAY, STAMP, sql
from motorlake.plans import actions, reports
from motorlake.plans.warehouse import open_warehouse

BLOCKS["fleet"] = """
SELECT v.vehicle_id, variant, manufacture_year, strftime(manufacture_date, '%Y-%m-%d') AS manufacture_date, status, model_name, vehicle_class,
powertrain_type, 0.0 AS curb_weight_kg, dealer_id AS selling_dealer_id, dealer_name AS selling_dealer_name
FROM dim_vehicle v LEFT JOIN dim_model USING (model_key) LEFT JOIN dim_dealer ON selling_dealer_key = dealer_key"""
_LIST = "vehicle_id, variant, manufacture_year, manufacture_date, status, model_name, vehicle_class, selling_dealer_name"
BLOCKS["tiered"] = """
SELECT vehicle_id, strftime(cutoff, '%Y-%m-%d') AS cutoff_date, score AS risk_score,
CASE WHEN score >= 0.75 THEN 'CRITICAL' WHEN score >= 0.5 THEN 'HIGH' WHEN score >= 0.25 THEN 'MEDIUM' ELSE 'LOW' END AS risk_tier FROM scored"""


def _dims(spark, sf_dir):
    t = open_warehouse(spark, sf_dir).table
    return t("dim_vehicle"), t("dim_model"), t("dim_dealer")


@query(
    "i1_vehicle_page",
    sql(f"SELECT {_LIST}, (SELECT count(*) FROM fleet WHERE status = 'ACTIVE') AS total_count FROM fleet WHERE status = 'ACTIVE' ORDER BY vehicle_id LIMIT 50 OFFSET 100"),
)
def i1(spark, sf_dir):
    """Third page of active vehicles."""
    return reports.vehicle_page(*_dims(spark, sf_dir), status="ACTIVE", limit=50, offset=100)


@query("i2_vehicle_detail", sql("SELECT * FROM fleet WHERE vehicle_id = 'VH-7'"))
def i2(spark, sf_dir):
    """Everything about one vehicle."""
    return reports.vehicle_detail(*_dims(spark, sf_dir), "VH-7")


@query(
    "i3_diagnostic_history",
    sql(f"SELECT diagnostic_id, vehicle_id, {STAMP.format('ts')} AS timestamp, code, severity FROM bridge WHERE vehicle_id = 'VH-8' AND severity = 'HIGH' ORDER BY ts DESC LIMIT 50"),
)
def i3(spark, sf_dir):
    """Latest high-severity diagnostics of one vehicle."""
    d = open_warehouse(spark, sf_dir).table("silver_diagnostics")
    return reports.diagnostic_history(d, "VH-8", "high").select("diagnostic_id", "vehicle_id", "timestamp", "code", "severity")


@query(
    "i4_risk_page",
    sql("SELECT *, (SELECT count(*) FROM tiered WHERE risk_tier = 'HIGH') AS total_count FROM tiered WHERE risk_tier = 'HIGH' ORDER BY risk_score DESC, vehicle_id, cutoff_date LIMIT 25 OFFSET 25"),
)
def i4(spark, sf_dir):
    return reports.risk_page(risk_predictions(spark, sf_dir).drop("top_features"), "HIGH", 25, 25)


@query(
    "i5_anomaly_page",
    sql(f"SELECT vehicle_id, {STAMP.format('ts')} AS window_timestamp, vib10 / 170.0 AS anomaly_score, TRUE AS is_anomaly, (SELECT count(*) FROM tel_raw WHERE vib10 / 170.0 >= 0.5) AS total_count FROM tel_raw WHERE vib10 / 170.0 >= 0.5 ORDER BY ts DESC, vehicle_id LIMIT 50"),
)
def i5(spark, sf_dir):
    rows = vibration_scores(spark, sf_dir).select("vehicle_id", "window_timestamp", "anomaly_score", "is_anomaly")
    return reports.anomaly_page(rows, True)


BLOCKS["fc"] = """
SELECT dealer_id, strftime(d, '%Y-%m-%d') AS forecast_date, v AS predicted_volume FROM (SELECT dealer_id, CAST(DATE '2024-01-31' + h AS DATE) AS d, mean_prev_7 AS v
FROM series CROSS JOIN (SELECT CAST(unnest(generate_series(1, 14)) AS INT) AS h) WHERE visit_date = DATE '2024-01-31')"""


@query(
    "i6_forecast_page",
    sql("SELECT dealer_id, forecast_date, round(predicted_volume, 9) AS predicted_volume, (SELECT count(*) FROM fc WHERE dealer_id = 'DLR-7') AS total_count FROM fc WHERE dealer_id = 'DLR-7' ORDER BY forecast_date LIMIT 50"),
)
def i6(spark, sf_dir):
    rows = mean_forecasts(spark, sf_dir).withColumn("predicted_volume", F.round("predicted_volume", 9))
    return reports.forecast_page(rows, "DLR-7")


@query(
    "i7_claim_page",
    sql("SELECT claim_id, component_id, claim_amount, round(r, 12) AS anomaly_score, (SELECT count(*) FROM ranked) AS total_count FROM ranked ORDER BY r DESC, claim_id LIMIT 50"),
)
def i7(spark, sf_dir):
    rows = ranked_claims(spark, sf_dir).withColumn("anomaly_score", F.round("anomaly_score", 12))
    return reports.claim_page(rows).select("claim_id", "component_id", "claim_amount", "anomaly_score", "total_count")


@query(
    "i8_action_page",
    sql("SELECT *, (SELECT count(*) FROM rule2b) AS total_count FROM rule2b ORDER BY trigger_timestamp DESC, idempotency_key LIMIT 30 OFFSET 30"),
)
def i8(spark, sf_dir):
    log = severe_actions(spark, sf_dir).drop("payload")
    return reports.action_page(log, "RULE_2_SEVERE_DTC", "VEHICLE", "PENDING", 30, 30)


@query(
    "i9_fleet_overview",
    sql("""SELECT (SELECT count(DISTINCT idempotency_key) FROM rule2b) AS actions_logged, '2024-03-05 00:00:00' AS last_action, (SELECT count(*) FROM dim_vehicle WHERE vehicle_key > 0) AS total_vehicles,
(SELECT count(*) FROM tiered WHERE risk_tier = 'CRITICAL') AS critical_risk, (SELECT count(*) FROM tel_raw WHERE vib10 / 170.0 >= 0.5) AS sensor_anomalies, (SELECT count(*) FROM cfeat) AS warranty_outliers"""),
)
def i9(spark, sf_dir):
    log = actions.append_actions(actions.empty_log(spark), severe_actions(spark, sf_dir), "2024-03-05 00:00:00")
    return reports.fleet_overview(
        _dims(spark, sf_dir)[0], risk_predictions(spark, sf_dir), vibration_scores(spark, sf_dir), ranked_claims(spark, sf_dir), log
    )


@query(
    "i10_vehicle_search",
    sql("""SELECT vehicle_id, model_name, variant, vehicle_class, selling_dealer_name FROM fleet WHERE vehicle_id <> 'UNKNOWN_VH' AND (contains(lower(vehicle_id), 'pulse') OR contains(lower(model_name), 'pulse')
OR contains(lower(variant), 'pulse') OR contains(lower(vehicle_class), 'pulse') OR contains(lower(selling_dealer_name), 'pulse'))"""),
)
def i10(spark, sf_dir):
    """Free-text search."""
    return reports.search_vehicles(*_dims(spark, sf_dir), " PULSE")


@query("i11_claim_search", sql("SELECT claim_id, claim_amount FROM cfeat WHERE contains(lower(claim_id), '-77')"))
def i11(spark, sf_dir):
    """Claims whose id contains a text."""
    return reports.search_claims(ranked_claims(spark, sf_dir), " -77 ").select("claim_id", "claim_amount")


@query(
    "i12_tier_distribution",
    sql("SELECT t AS risk_tier, count(vehicle_id) AS vehicles FROM (SELECT unnest(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW']) AS t) LEFT JOIN tiered ON t = risk_tier GROUP BY 1"),
)
def i12(spark, sf_dir):
    return reports.tier_distribution(risk_predictions(spark, sf_dir))


@query(
    "i13_model_status",
    sql(f"""SELECT 'sensor_anomaly_iforest' AS model_id, 'v1.0.0' AS model_version, {len(config.SENSOR_FEATURES)} AS feature_count, CAST(a AS DOUBLE) AS trained_on, least(256.0, a) AS tree_sample FROM nominal_n"""),
)
def i13(spark, sf_dir):
    """Registered models, from the registry, with the rows that the model was trained on."""
    from motorlake.catalog.scoring import STAMPED, VERSION, nominal, sensor_forest
    from motorlake.learning import registry

    forest = sensor_forest(spark, sf_dir)
    trained_on = float(nominal(spark, sf_dir).where(F.col("split") == 0).count())
    held = {"trained_on": trained_on, "tree_sample": float(forest.sample)}
    status = reports.model_status(
        registry.entry(spark, "sensor_anomaly_iforest", VERSION, STAMPED, "", forest.features, forest.settings(), held, "models/sensor")
    )
    return status.select(
        "model_id", "model_version", "feature_count",
        *[F.get_json_object("metrics", f"$.{k}").cast("double").alias(k) for k in ("trained_on", "tree_sample")],
    )
