"""Registered alert rule and action log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from motorlake import config
from motorlake.catalog.features import _service
from motorlake.catalog.registry import query
from motorlake.catalog.scoring import claims, plain_scores, series
from motorlake.catalog.sql import BLOCKS, DAY, STAMP, sql
from motorlake.learning.metrics import risk_tier
from motorlake.operators.cumulative import fractional_rank
from motorlake.plans import actions, features, scoring
from motorlake.plans.warehouse import open_warehouse
from motorlake.sources.adapters import raw_set, table

LIMIT = 0.5  # streak threshold for the plain vibration score


def risk_predictions(spark, sf_dir):
    """Prediction rows from the plain score."""
    s = plain_scores(spark, sf_dir)
    return s.select(
        "vehicle_id", "cutoff_date", F.col("score").alias("risk_score"), risk_tier(F.col("score")).alias("risk_tier"),
        F.create_map(F.lit("score"), F.col("score")).alias("top_features"),
    )


def vibration_scores(spark, sf_dir):
    """Anomaly rows from the vibration alone."""
    v = F.col("vibration").cast("double") * 10 / 170.0
    return raw_set(spark, sf_dir, "telemetry").select(
        "vehicle_id", F.col("timestamp").alias("window_timestamp"), v.alias("anomaly_score"),
        (v >= LIMIT).alias("is_anomaly"), F.col("_row_seq").alias("anomaly_id"), "rpm", "temperature", "battery", "vibration",
    )


def mean_forecasts(spark, sf_dir):
    """Forecast rows from the weekly mean."""
    grid = scoring.forecast_grid(series(spark, sf_dir), "2024-01-31")
    return grid.select("dealer_id", "forecast_date", F.col("mean_prev_7").alias("predicted_volume"))


def ranked_claims(spark, sf_dir):
    """Claim rows ranked by amount."""
    ranked = fractional_rank(claims(spark, sf_dir), "claim_amount", "anomaly_score")
    return scoring.claim_anomalies(ranked, "plain", "2024-03-05 00:00:00")


def severe_actions(spark, sf_dir):
    return actions.rule_severe_dtc(open_warehouse(spark, sf_dir).table("silver_diagnostics"), LIMIT)


_KEY = "sha256('{rule}:' || {entity} || ':' || {ts} || ':' || printf('%.4f', {value}))"
_ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN date_part('microsecond', ts) % 1000000 = 0 THEN '' ELSE '.' || strftime(ts, '%f') END"


def _action_sql(source, rule, kind, entity, stamp, ts, value, limit, text, channel, status="PENDING"):
    key = _KEY.format(rule=rule, entity=entity, ts=ts, value=value)
    return f"""SELECT '{rule}' AS rule_id, '{kind}' AS entity_type, {entity} AS entity_id, {stamp} AS trigger_timestamp, CAST({value} AS DOUBLE) AS trigger_value,
CAST({limit} AS DOUBLE) AS threshold_applied, {text} AS action_taken, '{channel}' AS channel_dispatched, '{status}' AS delivery_status, {key} AS idempotency_key FROM {source}"""


BLOCKS["rule1"] = _action_sql(
    "scored WHERE cutoff = (SELECT max(cutoff) FROM scored) AND score >= 0.7", "RULE_1_FAILURE_RISK", "VEHICLE", "vehicle_id",
    "strftime(cutoff, '%Y-%m-%d 00:00:00.000000')", "strftime(cutoff, '%Y-%m-%dT00:00:00+00:00')", "score", "0.7",
    "'Pre-emptive service work-order drafted for vehicle ' || vehicle_id || '. Failure probability ' || printf('%.1f', score * 100) || '% exceeds proposed initial trigger 70%.'",
    "SLACK,EMAIL",
)
BLOCKS["vib_hits"] = """
SELECT *, vib10 / 170.0 AS s, sum(CASE WHEN vib10 / 170.0 >= 0.5 THEN 0 ELSE 1 END) OVER (PARTITION BY vehicle_id ORDER BY ts, seq) AS island FROM tel_raw"""
BLOCKS["vib_streaks"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id, island ORDER BY ts, seq) AS streak FROM vib_hits WHERE s >= 0.5) WHERE streak % 3 = 0"""
BLOCKS["rule2a"] = _action_sql(
    "vib_streaks", "RULE_2_SENSOR_ANOMALY", "VEHICLE", "vehicle_id", STAMP.format("ts"), _ISO, "s", "0.5",
    "'Critical telemetry anomaly incident flagged for ' || vehicle_id || '. Observed 3 consecutive pings with score >= 0.5000.'", "SLACK",
)
BLOCKS["rule2b"] = _action_sql(
    "bridge WHERE severity IN ('CRITICAL', 'HIGH')", "RULE_2_SEVERE_DTC", "VEHICLE", "vehicle_id", STAMP.format("ts"), _ISO, "1.0", "0.5",
    "'Severe diagnostic event (' || severity || ' - ' || code || ') detected on vehicle ' || vehicle_id || '. Immediate service inspection recommended.'", "SLACK",
)
BLOCKS["base30"] = """
SELECT dealer_id, CAST(sum(n) AS DOUBLE) / 30 AS base FROM demand_day WHERE visit_date > (SELECT max(visit_date) FROM demand_day) - 30 GROUP BY 1"""
BLOCKS["first_forecast"] = """
SELECT dealer_id, DATE '2024-02-01' AS d, mean_prev_7 AS v FROM series WHERE visit_date = DATE '2024-01-31'"""


def _surge(source, base):
    return _action_sql(
        source, "RULE_3_DEMAND_SURGE", "DEALER", "dealer_id", "strftime(d, '%Y-%m-%d 00:00:00.000000')", "strftime(d, '%Y-%m-%d')",
        f"((v - {base}) / {base})", "0.25",
        f"'Service demand surge (+' || printf('%.1f', (v - {base}) / {base} * 100) || '%) detected for dealer ' || dealer_id || '. Forecasted volume (' || printf('%.1f', v) || ') exceeds baseline capacity (' || printf('%.1f', {base}) || ') by > 25%.'",
        "SLACK,EMAIL",
    )


BLOCKS["rule3"] = _surge("first_forecast WHERE (v - 1.0) / 1.0 > 0.25", "1.0")
BLOCKS["rule3_recent"] = _surge("first_forecast JOIN base30 USING (dealer_id) WHERE (v - base) / base > 0.25", "base")
BLOCKS["rule4"] = _action_sql(
    "ranked WHERE r >= 0.8", "RULE_4_WARRANTY_AUDIT", "CLAIM", "claim_id", "'2024-03-05 00:00:00.000000'", "'2024-03-05T00:00:00'", "r", "0.8",
    "'Warranty claim ' || claim_id || ' prioritized for forensic audit review. Outlier percentile rank ' || printf('%.2f', r) || ' meets proposed audit threshold 0.80. Strictly audit prioritization for sampling inspection.'",
    "INTERNAL", "DELIVERED",
)


@query("h1_rule_failure_risk", sql("SELECT * FROM rule1"))
def h1(spark, sf_dir):
    """High risk on the latest cutoff."""
    return actions.rule_failure_risk(risk_predictions(spark, sf_dir)).drop("payload")


@query("h2_rule_sensor_streak", sql("SELECT * FROM rule2a"))
def h2a(spark, sf_dir):
    """Three strong vibrations in a row."""
    return actions.rule_sensor_streak(vibration_scores(spark, sf_dir), LIMIT).drop("payload")


@query("h2_rule_severe_dtc", sql("SELECT * FROM rule2b"))
def h2b(spark, sf_dir):
    """Severe codes."""
    return severe_actions(spark, sf_dir).drop("payload")


@query("h3_rule_demand_surge", sql("SELECT * FROM rule3"))
def h3(spark, sf_dir):
    """Forecasts above a fixed baseline of one visit a day."""
    return actions.rule_demand_surge(mean_forecasts(spark, sf_dir), baseline=1.0).drop("payload")


@query("h3_rule_surge_over_recent", sql("SELECT * FROM rule3_recent"))
def h3_recent(spark, sf_dir):
    """Forecasts above each dealer's own last thirty days."""
    counts = features.daily_counts(*_service(spark, sf_dir))
    return actions.rule_demand_surge(mean_forecasts(spark, sf_dir), actions.recent_baseline(counts)).drop("payload")


@query("h4_rule_claim_audit", sql("SELECT * FROM rule4"))
def h4(spark, sf_dir):
    """Claims in the top fifth by amount."""
    return actions.rule_claim_audit(ranked_claims(spark, sf_dir)).drop("payload")


@query(
    "h5_idempotency_keys",
    sql("SELECT o_orderkey, sha256('RULE_T:VH-' || o_custkey || ':' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || ':' || printf('%.4f', o_totalprice)) AS idempotency_key FROM orders"),
)
def h5(spark, sf_dir):
    """Keys over every order as an event."""
    from motorlake.functions.text import iso_seconds

    o = table(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey",
        actions.idempotency_key(
            F.lit("RULE_T"), F.concat(F.lit("VH-"), "o_custkey"), iso_seconds(F.col("o_orderdate")), F.col("o_totalprice")
        ).alias("idempotency_key"),
    )


def _log_and_batch(spark, sf_dir):
    """A log of the first half of the month, and a batch of the whole month sent twice."""
    severe = severe_actions(spark, sf_dir)
    early = severe.where(F.col("trigger_timestamp") < F.lit("2024-01-15").cast("timestamp_ntz"))
    log = actions.append_actions(actions.empty_log(spark), early, "2024-01-15 00:00:00")
    return log, severe.unionByName(severe)


@query(
    "h6_append_unseen",
    sql(f"""SELECT idempotency_key, count(*) AS sent, sum(CASE WHEN trigger_timestamp < '2024-01-15' THEN 0 ELSE 1 END) > 0 AS is_new
FROM (SELECT * FROM rule2b UNION ALL SELECT * FROM rule2b) GROUP BY 1"""),
)
def h6(spark, sf_dir):
    """What a repeated batch adds to a half-filled log."""
    log, batch = _log_and_batch(spark, sf_dir)
    marked = actions.new_actions(batch, log)
    return marked.groupBy("idempotency_key").agg(
        F.sum(F.col("suppressed") + F.col("is_new").cast("int")).alias("sent"), F.max("is_new").alias("is_new")
    )


@query(
    "h7_action_payloads",
    sql("SELECT idempotency_key, b.code AS dtc_code, b.severity FROM rule2b JOIN (SELECT DISTINCT code, severity, vehicle_id, ts FROM bridge) b ON entity_id = b.vehicle_id AND trigger_timestamp = strftime(b.ts, '%Y-%m-%d %H:%M:%S.%f')"),
)
def h7(spark, sf_dir):
    """Fields read back from the payload text."""
    return severe_actions(spark, sf_dir).select(
        "idempotency_key", F.get_json_object("payload", "$.dtc_code").alias("dtc_code"),
        F.get_json_object("payload", "$.severity").alias("severity"),
    )


@query(
    "h8_trigger_counts",
    sql("""SELECT rule_id, count(DISTINCT idempotency_key) AS triggered FROM (SELECT rule_id, idempotency_key FROM rule1 UNION ALL SELECT rule_id, idempotency_key FROM rule2a
UNION ALL SELECT rule_id, idempotency_key FROM rule3 UNION ALL SELECT rule_id, idempotency_key FROM rule4) GROUP BY 1"""),
)
def h8(spark, sf_dir):
    """New actions per rule against an empty log."""
    every = (
        actions.rule_failure_risk(risk_predictions(spark, sf_dir))
        .unionByName(actions.rule_sensor_streak(vibration_scores(spark, sf_dir), LIMIT))
        .unionByName(actions.rule_demand_surge(mean_forecasts(spark, sf_dir), baseline=1.0))
        .unionByName(actions.rule_claim_audit(ranked_claims(spark, sf_dir)))
    )
    return actions.trigger_counts(actions.new_actions(every, actions.empty_log(spark)))


@query("h9_recent_actions", sql("SELECT * FROM rule2b ORDER BY trigger_timestamp DESC LIMIT 20"))
def h9(spark, sf_dir):
    """The twenty latest actions."""
    log = actions.append_actions(actions.empty_log(spark), severe_actions(spark, sf_dir), "2024-03-05 00:00:00")
    return actions.recent_actions(log, 20).drop("payload", "action_id", "created_at")


@query(
    "h10_reorder_points",
    sql("""SELECT part_id, dealer_key, stock, lead_time, CAST(lead_time * used AS DOUBLE) / 120 AS reorder_level FROM fp JOIN (
SELECT 'PRT-' || l_partkey AS part_id, dealer_key, count(*) AS used FROM lineitem JOIN dim_dealer ON dealer_id = 'DLR-' || l_suppkey GROUP BY 1, 2) USING (part_id, dealer_key)
WHERE stock <= CAST(lead_time * used AS DOUBLE) / 120"""),
)
def h10(spark, sf_dir):
    """Stock that will not last until the next delivery at the observed rate of use."""
    w = open_warehouse(spark, sf_dir)
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    used = li.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("used"))
    keyed = used.select(F.concat(F.lit("PRT-"), "l_partkey").alias("part_id"), F.concat(F.lit("DLR-"), "l_suppkey").alias("dealer_id"), "used")
    rates = keyed.join(w.table("dim_dealer").select("dealer_id", "dealer_key"), "dealer_id").drop("dealer_id")
    parts = w.table("fact_parts").select("part_id", "dealer_key", "stock", "lead_time").join(rates, ["part_id", "dealer_key"])
    need = (F.col("lead_time") * F.col("used")).cast("double") / 120
    return parts.withColumn("reorder_level", need).where(F.col("stock") <= F.col("reorder_level")).drop("used")


@query(
    "h10_claim_spikes",
    sql(f"""SELECT component_id, {DAY.format('claim_date')} AS claim_date, n FROM (SELECT *, avg(n) OVER (PARTITION BY component_id) AS m, stddev_samp(n) OVER (PARTITION BY component_id) AS s
FROM (SELECT category AS component_id, claim_date, count(*) AS n FROM fw JOIN dim_component USING (component_key) GROUP BY 1, 2)) WHERE n > m + 2.5 * s"""),
)
def h10_spikes(spark, sf_dir):
    """Days on which a category's claims stand out."""
    w = open_warehouse(spark, sf_dir)
    c = w.table("dim_component").select("component_key", F.col("category").alias("component_id"))
    daily = w.table("fact_warranty").join(c, "component_key").groupBy("component_id", "claim_date").agg(F.count("*").alias("n"))
    return actions.claim_spikes(daily, "component_id", "claim_date", "n").select("component_id", "claim_date", "n")


@query(
    "c16_new_actions_feed",
    sql("SELECT entity_id, trigger_timestamp, action_taken FROM rule2b WHERE trigger_timestamp > '2024-01-20' ORDER BY trigger_timestamp LIMIT 5"),
)
def c16(spark, sf_dir):
    """The next five actions after the last one a reader has seen."""
    severe = severe_actions(spark, sf_dir).withColumns(
        {
            "created_at": F.date_format("trigger_timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"),
            "action_id": F.md5("idempotency_key"),
        }
    )
    return actions.actions_since(severe, "2024-01-20", 5).select("entity_id", "trigger_timestamp", "action_taken")
