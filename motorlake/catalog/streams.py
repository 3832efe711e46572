"""Registered event contract, compaction and streaming queries.

Streams read the given event table as a file source and write to files, so the result is
read back as an ordinary table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from motorlake import config
from motorlake.catalog.actions import _ISO, _action_sql
from motorlake.catalog.registry import query
from motorlake.catalog.scoring import once, sensor_forest
from motorlake.catalog.sql import BLOCKS, DAY, STAMP, sql
from motorlake.operators.slots import streak_alerts
from motorlake.plans import actions, silver
from motorlake.plans.warehouse import open_warehouse
from motorlake.session import configure, scratch_path, settle
from motorlake.sources.adapters import GIVEN, diagnostic_messages, raw_set, table, telemetry_messages
from motorlake.streaming import alerts, batches, contracts, landing, sessions
from motorlake.streaming.action_log import ActionLog

SECOND = "strftime({}, '%Y-%m-%d %H:%M:%S') || '.000000'"

BLOCKS["tmsg"] = """
SELECT *, CASE WHEN k = 97 THEN '  ' ELSE 'VH-' || user_id END AS vid, CAST(floor(value * 30) AS BIGINT) AS rpm,
20 + (event_id * 13) % 150 AS temp, 40 + k AS bat, (event_id * 7) % 60 AS vib FROM ev"""
BLOCKS["tparsed"] = """
SELECT *, CASE WHEN k = 96 THEN 'CORRUPT_JSON: not parseable'
WHEN trim(vid) = '' OR rpm > 9000 OR temp > 150 OR bat > 100 OR vib > 50 OR k = 95 THEN 'VALIDATION_ERROR: ' || array_to_string(list_filter_nulls, ', ') END AS reject
FROM (SELECT *, [x FOR x IN [CASE WHEN trim(vid) = '' THEN 'vehicle_id' END, CASE WHEN rpm > 9000 THEN 'rpm' END, CASE WHEN temp > 150 THEN 'temperature' END,
CASE WHEN bat > 100 THEN 'battery' END, CASE WHEN vib > 50 THEN 'vibration' END, CASE WHEN k = 95 THEN 'driver' END] IF x IS NOT NULL] AS list_filter_nulls FROM tmsg)"""
BLOCKS["dparsed"] = """
SELECT *, CASE WHEN k = 96 THEN 'CORRUPT_JSON: not parseable' WHEN k = 99 THEN 'VALIDATION_ERROR: code' WHEN k = 98 THEN 'VALIDATION_ERROR: component'
WHEN k = 97 THEN 'VALIDATION_ERROR: severity' END AS reject,
['P0217','P0562','P0300','C0035','P0420','B0001','U0100','C0561'][CAST(k % 8 AS INT) + 1] AS code,
['LOW', 'MEDIUM', 'HIGH', 'CRITICAL', 'WARNING', 'INFO'][CAST(k % 6 AS INT) + 1] AS sev FROM ev WHERE event_type = 'error'"""


@query(
    "c1_telemetry_contract",
    sql(f"SELECT event_id AS seq, coalesce(reject, '') AS reject FROM tparsed"),
)
def c1(spark, sf_dir):
    """Verdict on every telemetry message."""
    parsed = contracts.parse_telemetry(telemetry_messages(spark, sf_dir))
    return parsed.select(F.col("offset").alias("seq"), F.coalesce("_reject", F.lit("")).alias("reject"))


@query(
    "c2_diagnostic_contract",
    sql(f"SELECT event_id AS seq, coalesce(reject, '') AS reject, CASE WHEN reject IS NULL THEN code END AS code, CASE WHEN reject IS NULL THEN sev END AS severity FROM dparsed"),
)
def c2(spark, sf_dir):
    """Verdict on every diagnostic message, with the normalised code and severity."""
    parsed = contracts.parse_diagnostics(diagnostic_messages(spark, sf_dir))
    ok = F.col("_reject").isNull()
    return parsed.select(
        F.col("offset").alias("seq"), F.coalesce("_reject", F.lit("")).alias("reject"),
        F.when(ok, F.col("code")).alias("code"), F.when(ok, F.col("severity")).alias("severity"),
    )


@query("c3_unknown_fields", sql("SELECT 'vehicle-telemetry' AS topic, count(*) AS messages FROM tparsed WHERE reject LIKE '%driver%'"))
def c3(spark, sf_dir):
    """Messages with a field that neither the contract nor the transport knows."""
    parsed = contracts.parse_telemetry(telemetry_messages(spark, sf_dir))
    return parsed.where(F.col("_reject").contains("driver")).groupBy("topic").agg(F.count("*").alias("messages"))


@query(
    "c4_business_columns",
    sql(f"SELECT vid AS vehicle_id, {SECOND.format('ts')} AS timestamp, CAST(rpm AS DOUBLE) AS rpm, CAST(temp AS DOUBLE) AS temperature, CAST(bat AS DOUBLE) AS battery, CAST(vib AS DOUBLE) AS vibration FROM tparsed WHERE reject IS NULL"),
)
def c4(spark, sf_dir):
    """Valid telemetry without transport fields."""
    return contracts.business_cols(contracts.parse_telemetry(telemetry_messages(spark, sf_dir)), "telemetry")


@query(
    "c5_dead_letters",
    sql("""SELECT reject AS _dlq_reason, 'vehicle-telemetry' AS _original_topic, CAST(user_id % 3 AS INT) AS _original_partition, event_id AS _original_offset,
'VH-' || user_id AS _original_key, 'vehicle-telemetry-dlq' AS _dlq_topic FROM tparsed WHERE reject IS NOT NULL
UNION ALL SELECT reject, 'diagnostic-events', CAST(user_id % 3 AS INT), event_id, 'VH-' || user_id, 'diagnostic-events-dlq' FROM dparsed WHERE reject IS NOT NULL"""),
)
def c5(spark, sf_dir):
    """Envelopes of all rejected messages of both topics."""
    t = contracts.to_dlq(contracts.parse_telemetry(telemetry_messages(spark, sf_dir)))
    d = contracts.to_dlq(contracts.parse_diagnostics(diagnostic_messages(spark, sf_dir)))
    return t.unionByName(d).drop("_dlq_timestamp", "_raw_payload")


def _message_files(spark, sf_dir, build):
    """The messages as files of one JSON text per line, as a topic dump would be."""
    path = scratch_path(spark, "messages")
    build(spark, sf_dir).select("value").write.text(path)
    return path


def _messages_stream(spark, sf_dir, build, topic):
    from motorlake.sources.streams import read_json_files

    return read_json_files(spark, _message_files(spark, sf_dir, build), topic)


@query(
    "c6_landed_counts",
    sql("SELECT count(*) FILTER (WHERE reject IS NULL) AS valid, count(*) FILTER (WHERE reject IS NOT NULL) AS rejected FROM tparsed"),
)
def c6(spark, sf_dir):
    """Counts of a landing run, observed while the rows pass."""
    configure(spark)
    counts = landing.ContractCounts()
    spark.streams.addListener(counts)
    q = landing.land_stream(
        _messages_stream(spark, sf_dir, telemetry_messages, config.TELEMETRY_TOPIC), "telemetry",
        scratch_path(spark, "landed"), scratch_path(spark, "cp"), name=counts.query,
    )
    q.awaitTermination()
    counts.ended.wait(60)
    spark.streams.removeListener(counts)
    return spark.createDataFrame([(counts.valid, counts.rejected)], "valid long, rejected long")


@query(
    "c7_compaction",
    sql(f"""SELECT vehicle_id, {STAMP.format('t')} AS timestamp, n AS landed, CASE WHEN held THEN 0 ELSE 1 END AS silver_added, CASE WHEN held THEN n ELSE n - 1 END AS quarantine_added
FROM (SELECT vehicle_id, date_trunc('hour', ts) AS t, count(*) AS n, date_trunc('hour', ts) < TIMESTAMP '2024-01-10' AS held FROM tel_raw GROUP BY 1, 2)"""),
)
def c7(spark, sf_dir):
    """Readings on an hourly grid, so that copies occur, against silver that ends on January 9."""
    tel = raw_set(spark, sf_dir, "telemetry").withColumn("timestamp", F.date_trunc("hour", "timestamp").cast("timestamp_ntz"))
    held = tel.where(F.col("timestamp") < F.lit("2024-01-10").cast("timestamp_ntz")).select("vehicle_id", "timestamp")
    tagged = landing.compact(tel, held, "telemetry", ["_row_seq"])
    return tagged.groupBy("vehicle_id", "timestamp").agg(
        F.count("*").alias("landed"), F.count_if(F.col(silver.RULE).isNull()).alias("silver_added"),
        F.count_if(F.col(silver.RULE).isNotNull()).alias("quarantine_added"),
    )


@query(
    "c7_compaction_diagnostics",
    sql("""SELECT vehicle_id, code, count(*) AS landed, count(DISTINCT day) AS silver_added FROM (
SELECT vehicle_id, upper(code) AS code, CAST(ts AS DATE) AS day FROM diag_raw) GROUP BY 1, 2"""),
)
def c7_diagnostics(spark, sf_dir):
    """Diagnostics on a daily grid against empty silver; the code's case does not matter."""
    d = raw_set(spark, sf_dir, "diagnostics").withColumns(
        {
            "timestamp": F.date_trunc("day", "timestamp").cast("timestamp_ntz"),
            "code": F.when(F.col("_row_seq") % 2 == 0, F.lower("code")).otherwise(F.col("code")),
        }
    )
    tagged = landing.compact(d, d.limit(0), "diagnostics", ["_row_seq"])
    return tagged.groupBy("vehicle_id", F.upper("code").alias("code")).agg(
        F.count("*").alias("landed"), F.count_if(F.col(silver.RULE).isNull()).alias("silver_added")
    )


@query(
    "c7_compaction_life_cycle",
    sql(f"""SELECT vehicle_id, {STAMP.format("date_trunc('hour', ts)")} AS timestamp, 1 AS silver_rows, count(*) - 1 AS quarantine_rows, TRUE AS first_archived
FROM tel_raw GROUP BY vehicle_id, date_trunc('hour', ts)"""),
)
def c7_life_cycle(spark, sf_dir):
    """Two landings of readings on an hourly grid, slow vehicles first, compacted one after the other; the first one's files are archived."""
    configure(spark)
    tel = raw_set(spark, sf_dir, "telemetry").select(
        "vehicle_id", F.date_trunc("hour", "timestamp").cast("timestamp_ntz").alias("timestamp"), "rpm", F.col("temperature").cast("double").alias("temperature"),
        F.col("battery").cast("double").alias("battery"), F.col("vibration").cast("double").alias("vibration"), F.col("_row_seq").cast("long").alias("seq"),
    )
    schema = ", ".join(f"{c} {t}" for c, t in tel.dtypes)
    landed, good, bad, archive, cp = (scratch_path(spark, x) for x in ("landed", "good", "bad", "archive", "cp"))
    for part in (tel.where("rpm < 1500"), tel.where("rpm >= 1500")):
        part.write.mode("append").parquet(landed)
        landing.compact_landed(spark, "telemetry", landed, good, bad, archive, cp, schema, ["seq"])
    archived = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(archive).select((F.count("*") > 0).alias("y")).scalar()
    keys = ["vehicle_id", "timestamp"]
    each = lambda path, layer: spark.read.parquet(path).select(*keys, F.lit(layer).alias("layer"))
    counts = each(good, "s").unionAll(each(bad, "q")).groupBy(*keys).agg(
        F.count_if(F.col("layer") == "s").alias("silver_rows"), F.count_if(F.col("layer") == "q").alias("quarantine_rows")
    )
    return counts.withColumn("first_archived", archived)


def events_stream(spark, sf_dir):
    """The given events as a stream of readings."""
    configure(spark)
    e = (
        spark.readStream.schema(GIVEN["events"])
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf_dir)
    )
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.concat(F.lit("VH-"), "user_id").alias("vehicle_id"),
        F.col("ts").alias("timestamp"),
        F.floor(F.col("value") * 30).cast("int").alias("rpm"),
        (F.lit(20) + (F.col("event_id") * 13) % 150).cast("double").alias("temperature"),
        ((F.lit(90) + k % 80) / 10.0).alias("battery"),
        (((F.col("event_id") * 7) % 170) / 10.0).alias("vibration"),
        F.col("event_id").alias("seq"),
    )


def run_to_table(spark, df, label):
    """Run a stream until its input is used up and read what it wrote."""
    path = scratch_path(spark, label)
    q = (
        df.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", scratch_path(spark, "cp"))
        .trigger(availableNow=True).start(path)
    )
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


@query("c8_dedup_stream", sql(f"SELECT vehicle_id, {STAMP.format('hour')} AS timestamp FROM (SELECT DISTINCT vehicle_id, date_trunc('hour', ts) AS hour FROM tel_raw)"))
def c8(spark, sf_dir):
    """First-seen deduplication of the stream on an hourly grid."""
    hourly = events_stream(spark, sf_dir).select(
        "vehicle_id", F.date_trunc("hour", "timestamp").cast("timestamp_ntz").alias("timestamp")
    )
    # the whole month may still change: the watermark spans it
    return run_to_table(spark, landing.dedup_stream(hourly, ["vehicle_id", "timestamp"], "60 days"), "deduped")


@query(
    "c9_score_stream",
    sql(f"""SELECT vehicle_id, {STAMP.format('ts')} AS timestamp, round(score, 4) AS anomaly_score_shown, score >= threshold AS is_anomaly,
CASE WHEN score >= threshold AND temp > {config.STREAM_TEMPERATURE_FLAG[1]} OR score >= threshold AND temp < {config.STREAM_TEMPERATURE_FLAG[0]} THEN CAST(temp AS DOUBLE) END AS temperature,
CASE WHEN score >= threshold AND vib10 / 10.0 > {config.STREAM_VIBRATION_FLAG} THEN vib10 / 10.0 END AS vibration, round(threshold, 4) AS decision_threshold
FROM sensor_stream JOIN sensor_scored USING (uid), (SELECT * FROM sensor_limit)"""),
)
def c9(spark, sf_dir):
    """Stream scores with the fixed centring, flags and out-of-range readings."""
    scored = alerts.score_stream(events_stream(spark, sf_dir), sensor_forest(spark, sf_dir))
    shown = scored.select(
        "vehicle_id", "timestamp", "anomaly_score_shown", "is_anomaly",
        *[F.try_element_at("anomalous_features", F.lit(c)).alias(c) for c in ("temperature", "vibration")], "decision_threshold",
    )
    return run_to_table(spark, shown, "scored")


@query(
    "c10_flagged_features",
    sql("""SELECT seq, CASE WHEN vib10 >= 100 AND temp > 105 THEN CAST(temp AS DOUBLE) END AS temperature, CASE WHEN vib10 >= 100 THEN vib10 / 10.0 END AS vibration FROM tel_raw"""),
)
def c10(spark, sf_dir):
    """Out-of-range readings of strongly vibrating vehicles."""
    tel = raw_set(spark, sf_dir, "telemetry").withColumn("m", alerts.flagged_features(F.col("vibration") >= 10))
    return tel.select(
        F.col("_row_seq").alias("seq"), F.try_element_at("m", F.lit("temperature")).alias("temperature"),
        F.try_element_at("m", F.lit("vibration")).alias("vibration"),
    )


BLOCKS["hits"] = """
SELECT *, vib10 >= 100 AS hit, sum(CASE WHEN vib10 >= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY vehicle_id ORDER BY ts, seq) AS island FROM tel_raw"""
BLOCKS["streaks"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id, island ORDER BY ts, seq) AS streak FROM hits WHERE hit) WHERE streak % 3 = 0"""


@query("c11_streak_alerts", sql(f"SELECT vehicle_id, {STAMP.format('ts')} AS timestamp, seq, streak FROM streaks"))
def c11(spark, sf_dir):
    """Every third consecutive strong vibration of a vehicle, in batch."""
    tel = raw_set(spark, sf_dir, "telemetry").select(
        "vehicle_id", "timestamp", F.col("_row_seq").alias("seq"), (F.col("vibration") >= 10).alias("hit")
    )
    return streak_alerts(tel, "vehicle_id", "timestamp", "seq", "hit", 3).drop("hit")


#: Some readings arrive an hour or two days after their time; a batch brings what arrives in ten days.
BLOCKS["arriving"] = """
SELECT *, CAST(floor(epoch(ts + CASE WHEN seq % 11 = 3 THEN INTERVAL 2 DAY WHEN seq % 5 = 1 THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END) / 864000) AS BIGINT) AS part FROM tel_raw"""
BLOCKS["marks"] = """
SELECT part, max(max(ts)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 1 DAY AS mark FROM arriving GROUP BY part"""
BLOCKS["timely"] = "SELECT arriving.*, coalesce(ts < mark, FALSE) AS late FROM arriving JOIN marks USING (part)"
BLOCKS["timely_hits"] = """
SELECT *, vib10 >= 100 AS hit, sum(CASE WHEN vib10 >= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY vehicle_id ORDER BY ts, seq) AS island FROM timely WHERE NOT late"""
BLOCKS["timely_streaks"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id, island ORDER BY ts, seq) AS streak FROM timely_hits WHERE hit) WHERE streak % 3 = 0"""
_READING = f"vehicle_id, {STAMP.format('ts')} AS timestamp, rpm, CAST(temp AS DOUBLE) AS temperature, bat10 / 10.0 AS battery, vib10 / 10.0 AS vibration, seq"


def readings_by_arrival(spark, sf_dir, delayed):
    """All readings with the number of the batch that brings them."""
    configure(spark)
    rows = raw_set(spark, sf_dir, "telemetry").select(
        "vehicle_id", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "rpm", F.col("temperature").cast("double").alias("temperature"),
        F.col("battery").cast("double").alias("battery"), F.col("vibration").cast("double").alias("vibration"), F.col("_row_seq").alias("seq"),
    )
    seconds = F.unix_timestamp(F.col("timestamp").cast("timestamp"))
    if delayed:
        seconds = seconds + F.when(F.col("seq") % 11 == 3, 172_800).when(F.col("seq") % 5 == 1, 3_600).otherwise(0)
    return rows.withColumn("hit", F.col("vibration") >= 10).withColumn("part", F.floor(seconds / 864_000))


def replay(spark, rows, write, writer=None):
    """Let the batches of ``rows`` arrive one after the other, each as one micro-batch of a stream that is started again."""
    source, checkpoint = scratch_path(spark, "arriving"), scratch_path(spark, "cp")
    writer = writer or write
    for r in rows.select("part").distinct().orderBy("part").collect():  # one number for ten days
        rows.where(F.col("part") == r["part"]).drop("part").write.mode("append").parquet(source)
        batches.run_batches(spark.readStream.schema(rows.drop("part").schema).parquet(source), write, checkpoint)
    writer.close(spark, rows.drop("part"))
    return writer


def streak_replay(spark, sf_dir, delayed):
    """The stream of all readings, run once per application."""
    return once(f"streaks-{delayed}", spark, sf_dir, lambda: _streak_replay(spark, sf_dir, delayed))


def _streak_replay(spark, sf_dir, delayed):
    rows = readings_by_arrival(spark, sf_dir, delayed)
    writer = batches.streak_writer(scratch_path(spark, "streaks"), "vehicle_id", "timestamp", "seq", "hit", dict(rows.dtypes))
    return replay(spark, rows, writer)


@query("c11_streak_alerts_stream", sql(f"SELECT {_READING} FROM streaks"))
def c11_stream(spark, sf_dir):
    """The same alerts from the stream, in several batches, with their readings."""
    return streak_replay(spark, sf_dir, delayed=False).results(spark).drop("hit")


@query("c11_streak_alerts_disorder", sql(f"SELECT {_READING} FROM timely_streaks"))
def c11_disorder(spark, sf_dir):
    """Alerts where readings arrive out of order: those an hour late count in their place, those below the watermark do not."""
    return streak_replay(spark, sf_dir, delayed=True).results(spark).drop("hit")


@query("c11_late_readings", sql(f"SELECT {_READING}, dense_rank() OVER (ORDER BY part) - 1 + (SELECT count(*) FROM marks WHERE part < (SELECT min(part) FROM timely WHERE late)) AS batch FROM timely WHERE late"))
def c11_late(spark, sf_dir):
    """Readings that came too late, stored with the batch that brought them."""
    return streak_replay(spark, sf_dir, delayed=True).late_rows(spark).drop("hit")


ALERT_SCORE = 0.5  # from which scores of the stream count towards an alert
BLOCKS["score_hits"] = f"""
SELECT *, score >= {ALERT_SCORE} AS hit, sum(CASE WHEN score >= {ALERT_SCORE} THEN 0 ELSE 1 END) OVER (PARTITION BY vehicle_id ORDER BY ts, seq) AS island
FROM sensor_stream JOIN sensor_scored USING (uid)"""
BLOCKS["score_streaks"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id, island ORDER BY ts, seq) AS streak FROM score_hits WHERE hit) WHERE streak % 3 = 0"""
BLOCKS["logged_streaks"] = _action_sql(
    "score_streaks", "RULE_2_SENSOR_ANOMALY", "VEHICLE", "vehicle_id", STAMP.format("ts"), _ISO, "score", f"{ALERT_SCORE}",
    f"'Critical telemetry anomaly incident flagged for ' || vehicle_id || '. Observed 3 consecutive pings with score >= {ALERT_SCORE:.4f}.'", "SLACK",
).replace(" FROM score_streaks", ", score AS logged_score, rpm AS logged_rpm, vib10 / 10.0 AS logged_vibration FROM score_streaks")


def action_log(spark, sf_dir):
    """The log after the scored stream and the severe codes have gone into it, every batch of them twice."""
    forest, limit = sensor_forest(spark, sf_dir), ALERT_SCORE
    rows = alerts.score_stream(
        readings_by_arrival(spark, sf_dir, delayed=False).drop("hit"), forest, limit
    ).drop(*[c for c in forest.features if c.startswith(("norm_", "vibration_per"))], "anomalous_features", "anomaly_score_shown", "decision_threshold")
    rows = settle(rows.withColumn("hit", F.col("is_anomaly") & (F.col("anomaly_score") >= limit)), "scored")
    log = ActionLog(scratch_path(spark, "log"))
    writer = batches.streak_writer(
        scratch_path(spark, "streaks"), "vehicle_id", "timestamp", "seq", "hit", dict(rows.dtypes),
        then=lambda hits, number: log.append(actions.streak_actions(hits.withColumnRenamed("timestamp", "window_timestamp"), limit, 3), "sensors", number),
    )

    def twice(batch, number):
        writer(batch, number)
        writer(batch, number)

    replay(spark, rows, twice, writer)
    for _ in range(2):
        log.append(actions.rule_severe_dtc(open_warehouse(spark, sf_dir).table("silver_diagnostics"), 0.5), "codes", 0)
    return log


@query(
    "h6_stream_to_log",
    sql("""SELECT * REPLACE (round(trigger_value, 6) AS trigger_value, round(threshold_applied, 6) AS threshold_applied, round(logged_score, 6) AS logged_score) FROM logged_streaks
UNION ALL SELECT DISTINCT *, NULL, NULL, NULL FROM rule2b"""),
)
def h6_stream(spark, sf_dir):
    """From the event stream to the stored log: scored, counted by vehicle, logged once, with score and readings in the payload."""
    rows = action_log(spark, sf_dir).read(spark)
    told = lambda path, name: F.get_json_object("payload", path).cast("double").alias(name)
    return rows.select(
        *[c for c in actions.COLUMNS if c not in ("payload", "trigger_value", "threshold_applied")],
        *[F.round(c, 6).alias(c) for c in ("trigger_value", "threshold_applied")],
        F.round(told("$.anomaly_score", "s"), 6).alias("logged_score"), told("$.telemetry.rpm", "logged_rpm").cast("long").alias("logged_rpm"),
        told("$.telemetry.vibration", "logged_vibration"),
    )


@query(
    "c12_severe_dtc_alerts",
    sql(f"""SELECT vehicle_id, {STAMP.format('ts')} AS timestamp, code, severity FROM diag_raw WHERE upper(trim(severity)) IN ('CRITICAL', 'HIGH')"""),
)
def c12(spark, sf_dir):
    """Severe codes, whatever the spelling of the severity."""
    d = raw_set(spark, sf_dir, "diagnostics")
    return d.where(F.upper(F.trim("severity")).isin(*config.SEVERE)).select("vehicle_id", "timestamp", "code", "severity")


@query(
    "c13_field_fallbacks",
    sql(f"""SELECT 'VH-' || user_id AS vehicle_id, CASE WHEN k % 10 = 3 THEN '2024-06-01 00:00:00.000000' ELSE {SECOND.format('ts')} END AS timestamp,
'P' || lpad(CAST(k AS VARCHAR), 4, '0') AS code, CASE WHEN k % 2 = 0 THEN 'critical' ELSE ' High' END AS severity
FROM ev WHERE event_type = 'error' AND k % 10 <> 7 AND k % 10 <> 9"""),
)
def c13(spark, sf_dir):
    """Messages naming their fields in different ways, with missing ones and unreadable times."""
    e = table(spark, sf_dir, "events").where(F.col("event_type") == "error")
    k = F.get_json_object("props", "$.k").cast("int")
    code = F.concat(F.lit("P"), F.lpad(k.cast("string"), 4, "0"))
    when = F.when(k % 10 == 3, F.lit("yesterday")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    severity = F.when(k % 2 == 0, "critical").otherwise(" High")
    fields = F.struct(
        F.concat(F.lit("VH-"), "user_id").alias("vehicle_id"),
        when.alias("timestamp"),
        F.when((k % 3 == 0) & (k % 10 != 9), code).alias("dtc_code"),
        F.when((k % 3 != 0) & (k % 10 != 9), code).alias("code"),
        F.when((k % 4 < 2) & (k % 10 != 7), severity).alias("severity"),
        F.when((k % 4 >= 2) & (k % 10 != 7), severity).alias("diagnostic_severity"),
    )
    at = F.lit("2024-06-01 00:00:00").cast("timestamp")
    return contracts.severe_events(e.select(F.to_json(fields).alias("value")), at).drop("description")


@query(
    "c14_trip_sessions",
    sql(f"""SELECT vehicle_id, {STAMP.format('min(ts)')} AS first_ping, {STAMP.format('max(ts)')} AS last_ping, count(*) AS pings FROM (
SELECT *, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY vehicle_id ORDER BY ts) AS s
FROM (SELECT vehicle_id, ts, lag(ts) OVER (PARTITION BY vehicle_id ORDER BY ts) AS p FROM tel_raw)) GROUP BY vehicle_id, s"""),
)
def c14(spark, sf_dir):
    """Trips with a six-hour gap."""
    return sessions.trip_sessions(raw_set(spark, sf_dir, "telemetry"), 21600)


@query(
    "c14_active_seconds_stream",
    sql(f"""SELECT vehicle_id, {DAY.format('day')} AS day, CAST(sum(CASE WHEN d > 0 AND d <= 21600000000 AND rpm > 0 THEN d ELSE 0 END) AS BIGINT) AS active_micros, count(*) AS pings FROM (
SELECT vehicle_id, CAST(ts AS DATE) AS day, rpm, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY vehicle_id, CAST(ts AS DATE) ORDER BY ts)) AS d FROM tel_raw) GROUP BY 1, 2"""),
)
def c14_active(spark, sf_dir):
    """Exact operating time per vehicle and day from the stream, in several batches."""
    return active_replay(spark, sf_dir, delayed=False)


def active_replay(spark, sf_dir, delayed):
    writer = replay(spark, readings_by_arrival(spark, sf_dir, delayed), batches.active_seconds_writer(scratch_path(spark, "active"), 21600))
    out = writer.results(spark, "vehicle_id string, day long, active_micros long, pings long")
    day = F.date_from_unix_date(F.col("day").cast("int"))
    return out.groupBy("vehicle_id", day.alias("day")).agg(F.sum("active_micros").alias("active_micros"), F.sum("pings").alias("pings"))


@query(
    "c14_active_seconds_disorder",
    sql(f"""SELECT vehicle_id, {DAY.format('day')} AS day, CAST(sum(CASE WHEN d > 0 AND d <= 21600000000 AND rpm > 0 THEN d ELSE 0 END) AS BIGINT) AS active_micros, count(*) AS pings FROM (
SELECT vehicle_id, CAST(ts AS DATE) AS day, rpm, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY vehicle_id, CAST(ts AS DATE) ORDER BY ts)) AS d FROM timely WHERE NOT late) GROUP BY 1, 2"""),
)
def c14_disorder(spark, sf_dir):
    """Operating time where readings arrive out of order; those below the watermark add nothing."""
    return active_replay(spark, sf_dir, delayed=True)


@query(
    "c15_minute_windows",
    sql(f"""SELECT {STAMP.format("date_trunc('minute', ts)")} AS minute_start, vehicle_id, count(*) AS pings, CAST(max(temp) AS DOUBLE) AS max_temperature, max(vib10) / 10.0 AS max_vibration
FROM tel_raw GROUP BY date_trunc('minute', ts), vehicle_id"""),
)
def c15(spark, sf_dir):
    """One-minute windows."""
    return sessions.telemetry_1m(raw_set(spark, sf_dir, "telemetry"))


@query("c17_landing_lifecycle", sql("""SELECT count(*) FILTER (WHERE reject IS NULL) AS landed, count(*) FILTER (WHERE reject IS NOT NULL) AS dead,
TRUE AS has_pending, count(DISTINCT CASE WHEN reject IS NULL THEN strftime(ts, '%Y%m%d%H') END) AS hours FROM tparsed"""))
def c17(spark, sf_dir):
    """Land a topic, dead letters aside, then count what awaits compaction."""
    from motorlake.sources.streams import pending_files

    configure(spark)
    path = _message_files(spark, sf_dir, telemetry_messages)
    from motorlake.sources.streams import read_json_files

    landed, dead = scratch_path(spark, "landed"), scratch_path(spark, "dead")
    messages = read_json_files(spark, path, config.TELEMETRY_TOPIC)
    for q in (
        landing.land_stream(messages, "telemetry", landed, scratch_path(spark, "cp")),
        landing.dlq_stream(messages, "telemetry", dead, scratch_path(spark, "cp")),
    ):
        q.awaitTermination()
    rows = spark.read.option("inferSchema", False).parquet(landed)
    waiting = pending_files(spark, landed).select(F.col("files") > 0).scalar()
    dead_rows = spark.read.parquet(dead).agg(F.count("*").alias("n")).scalar()
    return rows.groupBy("year", "month", "day", "hour").agg(F.count("*").alias("n")).agg(
        F.sum("n").alias("landed"), F.count("*").alias("hours")
    ).withColumns({"dead": dead_rows, "has_pending": waiting})
