"""Alert rules as table queries, and the idempotent action log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from motorlake import config
from motorlake.functions.text import iso_seconds
from motorlake.operators.dedup import tag_kept
from motorlake.operators.slots import streak_alerts

COLUMNS = [
    "rule_id", "entity_type", "entity_id", "trigger_timestamp", "trigger_value", "threshold_applied",
    "action_taken", "channel_dispatched", "delivery_status", "idempotency_key", "payload",
]
LOG_SCHEMA = (
    "action_id string, rule_id string, entity_type string, entity_id string, trigger_timestamp timestamp_ntz, "
    "trigger_value double, threshold_applied double, action_taken string, channel_dispatched string, "
    "delivery_status string, idempotency_key string, payload string, created_at string"
)


def idempotency_key(rule: Column, entity: Column, ts: Column, value: Column) -> Column:
    """sha256 of rule, entity, time and the value at four decimals."""
    text = F.concat_ws(":", F.trim(rule), F.trim(entity), F.trim(ts), F.format_string("%.4f", value))
    return F.substring(F.sha2(text, 256), 1, 64)


def _actions(
    df: DataFrame,
    rule: str,
    entity_type: str,
    entity: str,
    ts: Column,
    value: Column,
    threshold: float,
    text: list[Column],
    channel: str,
    payload: list[Column],
    ts_text: Column | None = None,
    status: str = "PENDING",
) -> DataFrame:
    stamped = df.withColumns({"_ts": ts.cast("timestamp_ntz"), "_value": value.cast("double")})
    rule_id = F.lit(rule)
    key_ts = ts_text if ts_text is not None else iso_seconds(F.col("_ts"))
    return stamped.select(
        rule_id.alias("rule_id"),
        F.lit(entity_type).alias("entity_type"),
        F.col(entity).alias("entity_id"),
        F.col("_ts").alias("trigger_timestamp"),
        F.col("_value").alias("trigger_value"),
        F.lit(float(threshold)).alias("threshold_applied"),
        F.format_string(config.ACTION_TEXT[rule], *text).alias("action_taken"),
        F.lit(channel).alias("channel_dispatched"),
        F.lit(status).alias("delivery_status"),
        idempotency_key(rule_id, F.col(entity), key_ts, F.col("_value")).alias("idempotency_key"),
        F.to_json(F.struct(*payload)).alias("payload"),
    )


def rule_failure_risk(predictions: DataFrame, threshold: float = config.RISK_TRIGGER) -> DataFrame:
    """High risk scores of the latest cutoff."""
    latest = predictions.agg(F.max("cutoff_date").alias("d")).scalar()
    score = F.col("risk_score")
    hit = predictions.where((F.col("cutoff_date") == latest) & (score >= threshold))
    midnight = F.concat(F.date_format("cutoff_date", "yyyy-MM-dd"), F.lit("T00:00:00+00:00"))
    return _actions(
        hit, "RULE_1_FAILURE_RISK", "VEHICLE", "vehicle_id", F.col("cutoff_date"), score, threshold,
        [F.col("vehicle_id"), score * 100, F.lit(threshold * 100)], "SLACK,EMAIL",
        [score, F.lit(threshold).alias("threshold"), F.col("top_features")], ts_text=midnight,
    )


def rule_sensor_streak(
    scored: DataFrame, threshold: float, length: int = config.STREAK_LENGTH, tie: str = "anomaly_id"
) -> DataFrame:
    """The third, sixth, ... of consecutive anomalous readings of a vehicle."""
    marked = scored.withColumn("_hit", F.col("is_anomaly") & (F.col("anomaly_score") >= threshold))
    hits = streak_alerts(marked, "vehicle_id", "window_timestamp", tie, "_hit", length)
    return streak_actions(hits, threshold, length)


def streak_actions(hits: DataFrame, threshold: float, length: int) -> DataFrame:
    telemetry = [c for c in ("rpm", "temperature", "battery", "vibration") if c in hits.columns]
    payload = [F.col("anomaly_score"), F.lit(length).alias("consecutive_pings")]
    if telemetry:
        payload.append(F.struct(*telemetry).alias("telemetry"))
    return _actions(
        hits, "RULE_2_SENSOR_ANOMALY", "VEHICLE", "vehicle_id", F.col("window_timestamp"), F.col("anomaly_score"),
        threshold, [F.col("vehicle_id"), F.lit(length), F.lit(float(threshold))], "SLACK", payload,
    )


def rule_severe_dtc(diagnostics: DataFrame, threshold: float, description: str | None = None) -> DataFrame:
    """Critical and high severities, whatever their spelling."""
    severity = F.upper(F.trim("severity"))
    hit = diagnostics.withColumn("_severity", severity).where(F.col("_severity").isin(*config.SEVERE))
    told = F.col(description) if description else F.lit("")
    return _actions(
        hit, "RULE_2_SEVERE_DTC", "VEHICLE", "vehicle_id", F.col("timestamp"), F.lit(1.0), threshold,
        [F.col("_severity"), F.col("code"), F.col("vehicle_id")], "SLACK",
        [F.col("code").alias("dtc_code"), F.col("_severity").alias("severity"), told.alias("description")],
    )


def rule_demand_surge(
    forecasts: DataFrame,
    baseline: float | DataFrame = config.SURGE_BASELINE,
    limit: float = config.SURGE_LIMIT,
) -> DataFrame:
    """Forecasts of the earliest day above the dealer's baseline by more than the limit.

    ``baseline`` is one number or a frame (dealer_id, baseline_capacity).
    """
    first = forecasts.agg(F.min("forecast_date").alias("d")).scalar()
    rows = forecasts.where(F.col("forecast_date") == first)
    if isinstance(baseline, DataFrame):
        rows = rows.join(baseline, "dealer_id")
    else:
        rows = rows.withColumn("baseline_capacity", F.lit(float(baseline)))
    base, volume = F.col("baseline_capacity"), F.col("predicted_volume")
    rows = rows.where(base > 0).withColumn("surge_pct", (volume - base) / base).where(F.col("surge_pct") > limit)
    return _actions(
        rows, "RULE_3_DEMAND_SURGE", "DEALER", "dealer_id", F.col("forecast_date"), F.col("surge_pct"), limit,
        [F.col("surge_pct") * 100, F.col("dealer_id"), volume, base, F.lit(limit * 100)], "SLACK,EMAIL",
        [volume, base, F.col("surge_pct"), F.lit(limit).alias("threshold_pct")],
        ts_text=F.date_format("forecast_date", "yyyy-MM-dd"),
    )


def recent_baseline(counts: DataFrame, days: int = 30) -> DataFrame:
    """Average daily visits of each dealer over its last ``days`` days."""
    last = counts.agg(F.max("visit_date").alias("d")).scalar()
    recent = counts.where(F.col("visit_date") > F.date_sub(last, days))
    return recent.groupBy("dealer_id").agg((F.sum("service_count") / F.lit(days)).alias("baseline_capacity"))


def rule_claim_audit(claims: DataFrame, threshold: float = config.TRIAGE_RANK) -> DataFrame:
    score = F.col("anomaly_score")
    hit = claims.where(score >= threshold)
    return _actions(
        hit, "RULE_4_WARRANTY_AUDIT", "CLAIM", "claim_id", F.col("flagged_at"), score, threshold,
        [F.col("claim_id"), score, F.lit(threshold)], "INTERNAL",
        [F.col("claim_id"), F.col("dealer_id"), F.col("component_id"), F.col("claim_amount"), score,
         F.lit(threshold).alias("threshold"), F.lit(config.AUDIT_NOTE).alias("disclaimer")],
        status="DELIVERED",
    )


def reorder_points(parts: DataFrame, daily_rates: DataFrame) -> DataFrame:
    """Stock at or below what is used while a new delivery is on its way."""
    need = F.col("lead_time") * F.col("daily_rate")
    return parts.join(daily_rates, ["part_id", "dealer_key"]).where(F.col("stock") <= need).withColumn(
        "reorder_level", need
    )


def claim_spikes(daily: DataFrame, key: str, day: str, count: str, sigmas: float = 2.5) -> DataFrame:
    """Days on which a key's count lies more than ``sigmas`` deviations above its mean."""
    stats = daily.groupBy(key).agg(F.avg(count).alias("mean_count"), F.stddev_samp(count).alias("sd_count"))
    return daily.join(stats, key).where(F.col(count) > F.col("mean_count") + sigmas * F.col("sd_count"))


def new_actions(candidates: DataFrame, log: DataFrame) -> DataFrame:
    """Candidates with ``is_new``: the first of each key that the log does not hold."""
    rows = candidates.withColumn("_uid", F.sha2(F.to_json(F.struct(*candidates.columns)), 256))
    # identical candidates collapse here, so the id below is unique
    rows = rows.groupBy("_uid").agg(
        *[F.first(c).alias(c) for c in candidates.columns], F.count("*").alias("_copies")
    )
    first = tag_kept(rows, ["idempotency_key"], [F.col("payload")], ["_uid"], keep="earliest", flag="_first")
    seen = log.select(F.col("idempotency_key").alias("_seen")).distinct()
    return (
        first.join(seen, F.col("idempotency_key") == F.col("_seen"), "left")
        .withColumn("is_new", F.col("_first") & F.col("_seen").isNull())
        .withColumn("suppressed", F.col("_copies") - F.col("is_new").cast("int"))
        .drop("_first", "_seen", "_uid", "_copies")
    )


def unseen(candidates: DataFrame, log: DataFrame) -> DataFrame:
    """One candidate of each idempotency key that the log does not hold: the first by payload."""
    columns = candidates.columns
    one = candidates.groupBy(F.col("idempotency_key").alias("_key")).agg(F.min_by(F.struct(*columns), F.struct("payload", "trigger_value")).alias("_row"))
    seen = log.select(F.col("idempotency_key").alias("_key"))
    return one.join(seen, "_key", "left_anti").select(*[F.col(f"_row.{c}").alias(c) for c in columns])


def append_actions(log: DataFrame, candidates: DataFrame, created_at: str) -> DataFrame:
    """The log plus the unseen candidates; writing the same batch again adds nothing."""
    rows = unseen(candidates, log).withColumns({"action_id": F.md5("idempotency_key"), "created_at": F.lit(created_at)})
    return log.unionByName(rows.select(*log.columns))


def empty_log(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LOG_SCHEMA)


def trigger_counts(marked: DataFrame) -> DataFrame:
    """New actions per rule."""
    return marked.groupBy("rule_id").agg(F.count_if("is_new").alias("triggered"))


def recent_actions(log: DataFrame, n: int = 50) -> DataFrame:
    return log.orderBy(F.desc("trigger_timestamp"), "action_id").limit(n)


def actions_since(log: DataFrame, last_seen: str, n: int = 5, last_id: str | None = None) -> DataFrame:
    """The next actions of a feed, oldest first.

    A batch shares one ``created_at``, so the place in the feed is (created_at, action_id) of the
    last action read.  Without ``last_id`` the feed starts after the whole of ``last_seen``.
    """
    later = F.col("created_at") > last_seen
    if last_id is not None:
        later = later | ((F.col("created_at") == last_seen) & (F.col("action_id") > last_id))
    return log.where(later).orderBy("created_at", "action_id").limit(n)
