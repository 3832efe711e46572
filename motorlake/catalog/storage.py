"""Registered source, sink and storage queries: each writes, reads back and summarises."""

from __future__ import annotations

from pyspark.sql import functions as F

from motorlake.catalog.registry import query
from motorlake.catalog.actions import mean_forecasts, ranked_claims, risk_predictions
from motorlake.catalog.cleaning import tagged
from motorlake.catalog.scoring import readings, sensor_forest
from motorlake.catalog.sql import DAY, STAMP, sql
from motorlake.plans import silver
from motorlake.plans.scoring import sensor_anomalies, stable_id
from motorlake.plans.warehouse import PROCESSED_AT, SILVER_BATCH, open_warehouse
from motorlake.session import scratch_path, settle
from motorlake.sources import lake, manifest
from motorlake.sources.adapters import SNAPSHOT_DATE, raw_set, table

_RAW_TEL = ["vehicle_id", "timestamp", "rpm", "temperature", "battery", "vibration"]


def _csv(spark, sf_dir, name, columns):
    directory = scratch_path(spark, "raw")
    df = raw_set(spark, sf_dir, name).select(*columns)
    df.write.option("header", True).csv(f"{directory}/{name}.csv")
    return directory


_SRV = ["service_id", "vehicle_id", "dealer_id", "visit_date", "issue", "cost"]


@query(
    "a1_raw_csv",
    sql(f"SELECT service_id, vehicle_id, dealer_id, {DAY.format('visit_date')} AS visit_date, issue, printf('%.2f', cents / 100.0) AS cost FROM srv_raw"),
)
def a1(spark, sf_dir):
    """The visits as CSV, read back as text."""
    return lake.read_raw(spark, _csv(spark, sf_dir, "service", _SRV), "service")


@query("a2_audit_columns", sql("SELECT 'B-7' AS _batch_id, '2024-03-01 00:00:00' AS _ingested_at, 'service.csv' AS _source_file, count(*) AS rows, count(*) AS positions FROM srv_raw"))
def a2(spark, sf_dir):
    """Audit columns on every ingested row; the positions are all different."""
    raw = lake.read_raw(spark, _csv(spark, sf_dir, "service", _SRV), "service")
    audited = lake.with_audit(raw, "B-7", "2024-03-01 00:00:00", "service.csv")
    return audited.groupBy("_batch_id", "_ingested_at", "_source_file").agg(
        F.count("*").alias("rows"), F.count_distinct("_row_seq").alias("positions")
    )


@query("a3_event_partitions", sql("SELECT strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month, strftime(ts, '%d') AS day, count(*) AS rows FROM tel_raw GROUP BY 1, 2, 3"))
def a3(spark, sf_dir):
    """Readings stored by year, month and day."""
    path = scratch_path(spark, "bronze")
    lake.write_events(raw_set(spark, sf_dir, "telemetry").select(*_RAW_TEL), path)
    days = lake.read_lake(spark, path)
    padded = [F.lpad(F.col(c).cast("string"), n, "0").alias(c) for c, n in (("year", 4), ("month", 2), ("day", 2))]
    return days.groupBy(*padded).agg(F.count("*").alias("rows"))


@query("a4_snapshot_partitions", sql("SELECT '2024-02-01' AS snapshot_date, count(*) AS rows FROM veh_raw UNION ALL SELECT '2024-02-02', count(*) FROM veh_raw"))
def a4(spark, sf_dir):
    """Two snapshot dates, one of them written twice."""
    path = scratch_path(spark, "snapshots")
    v = raw_set(spark, sf_dir, "vehicles").select("vehicle_id", "model")
    for day in ("2024-02-01", "2024-02-02", "2024-02-02"):
        lake.write_snapshot(v, path, day)
    return lake.read_lake(spark, path).groupBy("snapshot_date").agg(F.count("*").alias("rows"))


@query("a5_pruned_scan", sql("SELECT vehicle_id, rpm FROM tel_raw WHERE CAST(ts AS DATE) = DATE '2024-01-12'"))
def a5(spark, sf_dir):
    """Two columns of one day of the stored readings."""
    path = scratch_path(spark, "bronze")
    lake.write_events(raw_set(spark, sf_dir, "telemetry").select(*_RAW_TEL), path)
    return lake.read_lake(spark, path).where((F.col("month") == 1) & (F.col("day") == 12)).select("vehicle_id", "rpm")


@query("a6_silver_sink", sql(f"SELECT {DAY.format('CAST(ts AS DATE)')} AS day, count(*) AS rows, CAST(sum(rpm) AS BIGINT) AS rpm FROM tel GROUP BY 1"))
def a6(spark, sf_dir):
    """Clean readings stored and read back."""
    path = scratch_path(spark, "silver")
    clean = silver.clean_rows(tagged(spark, sf_dir, "telemetry"), "telemetry", SILVER_BATCH, PROCESSED_AT)
    lake.write_silver(clean, path, "telemetry")
    back = lake.read_lake(spark, path)
    return back.groupBy(F.make_date("year", "month", "day").alias("day")).agg(F.count("*").alias("rows"), F.sum("rpm").alias("rpm"))


@query(
    "a7_quarantine_sink",
    sql(f"SELECT claim_id, vehicle_id, {DAY.format('claim_date')} AS claim_date, cents / 100.0 AS amount, rule AS _quarantine_rule FROM wrn_tag WHERE rule IS NOT NULL"),
)
def a7(spark, sf_dir):
    """Rejected claims with their raw values."""
    path = scratch_path(spark, "quarantine")
    lake.write_quarantine(silver.quarantine_rows(tagged(spark, sf_dir, "warranty"), PROCESSED_AT), path)
    return spark.read.parquet(path).select("claim_id", "vehicle_id", "claim_date", "amount", "_quarantine_rule")


@query("a8_event_source", sql("SELECT user_id, count(*) AS messages FROM ev GROUP BY 1"))
def a8(spark, sf_dir):
    """The message files as a stream source."""
    from motorlake.catalog.streams import _messages_stream, run_to_table
    from motorlake.sources.adapters import telemetry_messages

    def build(spark, sf_dir):
        return telemetry_messages(spark, sf_dir).select(F.regexp_extract("key", r"(\d+)", 1).alias("value"))

    messages = _messages_stream(spark, sf_dir, build, "vehicle-telemetry")
    seen = run_to_table(spark, messages.select("value"), "seen")
    return seen.groupBy(F.col("value").cast("long").alias("user_id")).agg(F.count("*").alias("messages"))


@query("a9_landing", sql("SELECT strftime(ts, '%Y-%m-%d %H') AS hour, count(*) AS rows FROM tparsed WHERE reject IS NULL GROUP BY 1"))
def a9(spark, sf_dir):
    """Events landed by hour."""
    from motorlake.catalog.streams import _messages_stream
    from motorlake.session import configure
    from motorlake.sources.adapters import telemetry_messages
    from motorlake.streaming import landing

    configure(spark)
    path = scratch_path(spark, "landed")
    landing.land_stream(
        _messages_stream(spark, sf_dir, telemetry_messages, "vehicle-telemetry"), "telemetry", path, scratch_path(spark, "cp")
    ).awaitTermination()
    return spark.read.parquet(path).groupBy(F.date_format("timestamp", "yyyy-MM-dd HH").alias("hour")).agg(F.count("*").alias("rows"))


@query("a10_dead_letter_sink", sql("SELECT 'diagnostic-events-dlq' AS _dlq_topic, reject AS _dlq_reason, count(*) AS rows FROM dparsed WHERE reject IS NOT NULL GROUP BY 2"))
def a10(spark, sf_dir):
    """Dead letters stored per topic."""
    from motorlake.catalog.streams import _messages_stream
    from motorlake.session import configure
    from motorlake.sources.adapters import diagnostic_messages
    from motorlake.streaming import landing

    configure(spark)
    path = scratch_path(spark, "dead")
    landing.dlq_stream(
        _messages_stream(spark, sf_dir, diagnostic_messages, "diagnostic-events"), "diagnostics", path, scratch_path(spark, "cp")
    ).awaitTermination()
    return spark.read.parquet(path).groupBy("_dlq_topic", "_dlq_reason").agg(F.count("*").alias("rows"))


@query("a11_prediction_archive", sql("SELECT 2024 AS year, 3 AS month, risk_tier, 2 * count(*) AS rows FROM tiered GROUP BY 3"))
def a11(spark, sf_dir):
    """Predictions archived twice in March."""
    path = scratch_path(spark, "archive")
    p = risk_predictions(spark, sf_dir)
    for day in ("2024-03-05 00:00:00", "2024-03-06 00:00:00"):
        lake.archive_predictions(p, path, day)
    return spark.read.parquet(path).groupBy("year", "month", "risk_tier").agg(F.count("*").alias("rows"))


@query("a12_prediction_table", sql("SELECT risk_tier, count(*) AS rows FROM tiered GROUP BY 1"))
def a12(spark, sf_dir):
    """Predictions in the operational table."""
    rows = risk_predictions(spark, sf_dir).withColumn("prediction_id", stable_id("vehicle_id", "cutoff_date"))
    stored = lake.write_predictions(rows, scratch_path(spark, "predictions"), "prediction_id", F.col("cutoff_date"), "B-1")
    return stored.groupBy("risk_tier").agg(F.count("*").alias("rows"))


@query(
    "a12_operational_predictions",
    sql("""SELECT 'risk' AS kind, count(*) AS rows, count(DISTINCT cutoff) AS days FROM scored
UNION ALL SELECT 'sensor', count(*), count(DISTINCT CAST(ts AS DATE)) FROM sensor_rows
UNION ALL SELECT 'demand', 14 * count(DISTINCT dealer_id), 14 FROM series
UNION ALL SELECT 'claim', count(*), 1 FROM cfeat"""),
)
def a12_all(spark, sf_dir):
    """All four kinds of predictions, each written twice and once more under another batch: every key is there once."""
    kinds = {
        "risk": (risk_predictions(spark, sf_dir).withColumn("prediction_id", stable_id("vehicle_id", "cutoff_date")), "prediction_id", "cutoff_date"),
        "sensor": (sensor_anomalies(sensor_forest(spark, sf_dir), readings(spark, sf_dir), "v1", PROCESSED_AT), "prediction_id", "window_timestamp"),
        "demand": (mean_forecasts(spark, sf_dir).withColumn("forecast_id", stable_id("dealer_id", "forecast_date")), "forecast_id", "forecast_date"),
        "claim": (ranked_claims(spark, sf_dir), "anomaly_id", "flagged_at"),
    }
    out = None
    for kind, (rows, key, day) in kinds.items():
        path = scratch_path(spark, f"predictions-{kind}")
        for batch in ("B-1", "B-1", "B-2"):
            stored = lake.write_predictions(rows, path, key, F.col(day), batch)
        one = stored.agg(F.lit(kind).alias("kind"), F.count("*").alias("rows"), F.count_distinct("_day").alias("days"))
        out = one if out is None else out.unionByName(one)
    return out


@query("a13_changed_files", sql("""SELECT day, rows > 0 AS has_rows, day = '2024-01-05' OR day >= '2024-01-30' AS is_changed
FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS rows FROM ev GROUP BY 1)"""))
def a13(spark, sf_dir):
    """One file per day; after the first scan one day changes and the last ones arrive."""
    path = scratch_path(spark, "files")
    e = table(spark, sf_dir, "events").select("event_id", "value", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    put = lambda rows: (
        rows.repartition("day").write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("day").csv(path)
    )
    put(e.where(F.col("day") < "2024-01-30"))
    csv_only = lambda files: files.where(F.col("path").endswith(".csv"))
    seen = csv_only(manifest.scan_files(spark, path))
    known = settle(manifest.record_processed(manifest.empty_manifest(spark), seen, "B-1", PROCESSED_AT), "manifest")
    put(e.where(F.col("day") == "2024-01-05").withColumn("value", F.col("value") + 1))
    put(e.where(F.col("day") >= "2024-01-30"))
    changed = manifest.changed_files(csv_only(manifest.scan_files(spark, path, manifest=known)), known)
    return changed.select(
        F.regexp_extract("path", r"day=([0-9-]+)", 1).alias("day"), (F.col("file_size") > 0).alias("has_rows"), "is_changed"
    )


@query("a13_ingest_changed", sql("SELECT event_id, CASE WHEN strftime(ts, '%Y-%m-%d') = '2024-01-05' THEN value + 1 ELSE value END AS value FROM ev WHERE strftime(ts, '%Y-%m-%d') = '2024-01-05' OR strftime(ts, '%Y-%m-%d') >= '2024-01-30'"))
def a13_ingest(spark, sf_dir):
    """After the first scan the rows of changed and new files only are read, and the next scan finds no change."""
    path = scratch_path(spark, "files")
    e = table(spark, sf_dir, "events").select("event_id", "value", F.date_format("ts", "yyyy-MM-dd").alias("day"))

    def put(rows):
        rows.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)

    def scan(known):
        files = manifest.scan_files(spark, path, manifest=known)
        return settle(manifest.changed_files(files.where(F.col("path").endswith(".parquet")), known), "scan")

    put(e.where(F.col("day") < "2024-01-30"))
    known = manifest.empty_manifest(spark)
    known = settle(manifest.record_processed(known, scan(known), "B-1", PROCESSED_AT), "manifest")
    put(e.where(F.col("day") == "2024-01-05").withColumn("value", F.col("value") + 1))
    put(e.where(F.col("day") >= "2024-01-30"))
    changed = scan(known)
    rows = manifest.read_changed(changed, lambda paths: spark.read.parquet(*paths))
    known = settle(manifest.record_processed(known, changed.where("is_changed"), "B-2", PROCESSED_AT), "manifest")
    if scan(known).where("is_changed").count():
        raise AssertionError("a processed file counts as changed")
    return rows.select("event_id", "value")


@query("a14_materialize", sql("SELECT 'view' AS kind, count(*) AS rows FROM srv_month UNION ALL SELECT 'table', count(*) FROM srv_month"))
def a14(spark, sf_dir):
    """One model as a view and as a table."""
    from motorlake.plans import models

    df = models.service_monthly(open_warehouse(spark, sf_dir).table("fact_service"))
    tail = scratch_path(spark, "m").rsplit("-", 1)[1]
    rows = None
    for kind in ("view", "table"):
        one = lake.materialize(df, f"service_monthly_{kind}_{tail}", kind).agg(F.lit(kind).alias("kind"), F.count("*").alias("rows"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query("a15_stage_metrics", sql("SELECT 'bronze' AS stage, count(*) AS rows, TRUE AS timed, TRUE AS stored FROM tel_raw"))
def a15(spark, sf_dir):
    """Rows, time and size of one written stage."""
    m = lake.measured("bronze", raw_set(spark, sf_dir, "telemetry").select(*_RAW_TEL), scratch_path(spark, "stage"))
    return spark.createDataFrame(
        [(m["stage"], m["rows"], m["seconds"] > 0 and m["rows_per_second"] > 0, m["bytes"] > 0)],
        "stage string, rows long, timed boolean, stored boolean",
    )
