"""Event contracts, landing, compaction, stateful alerts."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from motorlake.plans import silver
from motorlake.session import scratch_path
from motorlake.sources.streams import pending_files, read_json_files
from motorlake.streaming import alerts, batches, contracts, landing, sessions

GOOD = {"vehicle_id": "VH-1", "timestamp": "2026-09-01T10:00:00", "rpm": 2000, "temperature": 90.5, "battery": 50, "vibration": 1}
CODE = {"vehicle_id": "VH-1", "timestamp": "2026-09-01T10:00:00Z", "code": " p0217 ", "component": "Pump", "severity": "warning "}


def messages(spark, values):
    rows = [(v if v is None or isinstance(v, str) else json.dumps(v), "k", "vehicle-telemetry", 0, i) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "value string, key string, topic string, partition int, offset long")


def reasons(df):
    return [r["_reject"] for r in df.orderBy("offset").collect()]


def test_telemetry_contract(spark):
    with_ = lambda **k: {**GOOD, **k}
    without = lambda k: {a: b for a, b in GOOD.items() if a != k}
    df = contracts.parse_telemetry(messages(spark, [
        GOOD, with_(rpm=9000, temperature=-40, battery=100, vibration=50), with_(rpm="2000"), with_(_sent_at="x", _kafka_offset=3),
        with_(rpm=9000.5), with_(rpm=-1, vibration=51), with_(vehicle_id="  "), with_(vehicle_id=7), without("battery"), with_(extra=1),
        with_(timestamp="soon"), '{"vehicle_id": "VH', "[1, 2]", None, with_(rpm="fast"), with_(timestamp=1767225600), with_(rpm=None),
    ]))
    v = "VALIDATION_ERROR: "
    assert reasons(df) == [
        None, None, None, None, v + "rpm", v + "rpm, vibration", v + "vehicle_id", v + "vehicle_id", v + "battery", v + "extra",
        v + "timestamp", "CORRUPT_JSON: not parseable", v + "vehicle_id, timestamp, rpm, temperature, battery, vibration",
        "PROCESSING_ERROR: empty payload", v + "rpm", None, v + "rpm",
    ]
    times = [r["event_time"] for r in df.orderBy("offset").collect()]
    assert times[0] == datetime(2026, 9, 1, 10) and times[15] == datetime(2026, 1, 1)


def test_diagnostic_contract(spark):
    with_ = lambda **k: {**CODE, **k}
    df = contracts.parse_diagnostics(messages(spark, [
        CODE, with_(code="P"), with_(code="P0123456789"), with_(code="   "), with_(component=""), with_(severity="SEVERE"),
    ]))
    v = "VALIDATION_ERROR: "
    assert reasons(df) == [None, v + "code", v + "code", v + "code", v + "component", v + "severity"]
    first = contracts.business_cols(df, "diagnostics").first()
    assert (first["code"], first["severity"], first["timestamp"]) == ("P0217", "WARNING", datetime(2026, 9, 1, 10))


def test_dead_letter_envelope(spark):
    df = contracts.to_dlq(contracts.parse_telemetry(messages(spark, ["{oops", GOOD])))
    (row,) = df.collect()
    assert row["_raw_payload"] == "{oops" and row["_original_offset"] == 0 and row["_dlq_topic"] == "vehicle-telemetry-dlq"
    assert row["_dlq_reason"].startswith("CORRUPT_JSON")


def test_landing_two_valid_one_corrupt(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text("\n".join([json.dumps(GOOD), json.dumps({**GOOD, "timestamp": "2026-09-01T10:30:00"}), "{oops"]))
    stream = read_json_files(spark, str(source), "vehicle-telemetry")
    out, dead = str(tmp_path / "out"), str(tmp_path / "dead")
    landing.land_stream(stream, "telemetry", out, str(tmp_path / "cp1")).awaitTermination()
    landing.dlq_stream(stream, "telemetry", dead, str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    assert spark.read.parquet(dead).count() == 1
    assert (tmp_path / "out" / "year=2026" / "month=09" / "day=01" / "hour=10").is_dir()
    # running again lands nothing twice
    landing.land_stream(stream, "telemetry", out, str(tmp_path / "cp1")).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    assert pending_files(spark, out).first()["files"] >= 1


TEL = "vehicle_id string, timestamp timestamp_ntz, rpm int, temperature double, battery double, vibration double, seq long"


def reading(v, minute, seq, rpm=2000):
    return (v, datetime(2026, 9, 1, 10, minute), rpm, 90.0, 12.0, 1.0, seq)


def test_compaction_one_new_two_rejected(spark):
    held = spark.createDataFrame([reading("VH-1", 0, 0)], TEL)
    batch = spark.createDataFrame([reading("VH-1", 0, 1), reading("VH-2", 0, 2), reading("VH-2", 0, 3, 3000)], TEL)
    tagged = {r["seq"]: r[silver.RULE] for r in landing.compact(batch, held, "telemetry", ["seq"]).collect()}
    assert tagged == {1: "DUPLICATE_KEY", 2: None, 3: "DUPLICATE_KEY"}
    ruled = landing.compact(
        spark.createDataFrame([reading("VH-3", 1, 1, 9500)], TEL), held, "telemetry", ["seq"], "2026-09-25"
    ).first()
    assert ruled[silver.RULE] == "RULE_TEL_RPM_RANGE"


def test_compaction_batches_can_be_replayed(spark):
    good, bad = scratch_path(spark, "good"), scratch_path(spark, "bad")
    write = landing.compaction_writer(spark, "telemetry", good, bad, ["seq"])
    one = spark.createDataFrame([reading("VH-1", 0, 1), reading("VH-1", 0, 2)], TEL)
    two = spark.createDataFrame([reading("VH-1", 0, 3), reading("VH-2", 0, 4)], TEL)
    for number, batch in ((0, one), (1, two), (1, two), (0, one)):
        write(batch, number)
    assert sorted(r["seq"] for r in spark.read.parquet(good).collect()) == [1, 4]
    assert sorted(r["seq"] for r in spark.read.parquet(bad).collect()) == [2, 3]


def test_compaction_life_cycle(spark, tmp_path, monkeypatch):
    """A crash between the two outputs loses and doubles nothing; files are archived once their batch is committed."""
    landed, good, bad, archive, cp = (str(tmp_path / x) for x in ("landed", "good", "bad", "archive", "cp"))

    def land(rows):
        spark.createDataFrame(rows, TEL).coalesce(1).write.mode("append").parquet(landed)

    def run():
        landing.compact_landed(spark, "telemetry", landed, good, bad, archive, cp, TEL, ["seq"])

    def files(path):
        return len([p for p in (tmp_path / path).rglob("*.parquet")])

    land([reading("VH-1", 0, 0), reading("VH-1", 0, 1)])
    real, written = landing.settle, []

    def broken(df, label="x"):
        if label == "tagged":
            written.append(label)
            raise RuntimeError("machine lost")
        return real(df, label)

    monkeypatch.setattr(landing, "settle", broken)
    with pytest.raises(Exception):
        run()
    assert written and files("landed") == 1
    monkeypatch.setattr(landing, "settle", real)
    run()
    land([reading("VH-1", 0, 2), reading("VH-2", 0, 3)])
    run()
    run()
    assert sorted(r["seq"] for r in spark.read.parquet(good).collect()) == [0, 3]
    assert sorted(r["seq"] for r in spark.read.parquet(bad).collect()) == [1, 2]
    assert files("archive") >= 1 and files("landed") + files("archive") == 2
    plan = landing._known(spark, good, 99, (20260901, 20260901), spark.createDataFrame([], TEL))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "year" in plan.split("PartitionFilters: [")[1].split("]")[0]


def at(minute, day=1):
    return datetime(2026, 9, day, 10, minute)


KINDS = {"vehicle_id": "string", "timestamp": "timestamp_ntz", "seq": "bigint", "hit": "boolean", "rpm": "int", "score": "double"}


def frames_of(spark, parts):
    return [spark.createDataFrame(p, ", ".join(f"{k} {v}" for k, v in KINDS.items())) for p in parts]


def test_batches_in_event_time(spark, tmp_path):
    """Runs and operating time over batches out of order and run twice; late rows and rows without a time are set apart."""
    frames = frames_of(spark, [
        [("v", at(1), 1, True, 9, .1), ("v", at(3), 3, True, 9, .4), ("w", at(2), 9, True, 9, .3)],
        [("x", at(3), 20, True, 9, .3)],
        [("v", at(2), 2, True, 9, .2), ("v", at(4), 4, True, 0, .5), ("w", at(3), 10, False, 9, .6), ("w", at(4), 11, True, 9, .7), ("n", None, 0, True, 1, .1)],
        [("z", at(0, 3), 99, False, 9, .0)],
        [("v", at(5), 5, True, 9, .8), ("v", at(1, 3), 6, True, 9, .9), ("w", at(5, 2), 12, True, 9, .8), ("w", at(6, 3), 13, True, 9, .9), ("x", at(2), 21, None, 9, .3)],
    ])
    def run(writer):
        for k in (0, 1, 1, 2, 2, 3, 4, 4):
            writer(frames[k], k)
        writer.close(spark, frames[0])
        return writer

    writer = run(batches.streak_writer(str(tmp_path / "s"), "vehicle_id", "timestamp", "seq", "hit", KINDS, 3, whole=2))
    assert sorted((r["seq"], r["rpm"], r["score"]) for r in writer.results(spark).collect()) == [(3, 9, .4), (13, 9, .9)]
    late = {r["seq"]: r["batch"] for r in writer.late_rows(spark).collect()}
    assert late == {0: 2, 5: 4, 21: 4}
    writer = run(batches.active_seconds_writer(str(tmp_path / "a"), 3600, whole=2))
    got = {r["vehicle_id"]: (r["s"], r["p"]) for r in writer.results(spark).groupBy("vehicle_id").agg(F.sum("active_micros").alias("s"), F.sum("pings").alias("p")).collect()}
    assert got == {"v": (120_000_000, 5), "w": (120_000_000, 5), "x": (0, 1), "z": (0, 1)}


def test_carry_keeps_keys_that_do_not_return(spark, tmp_path):
    """A key met once is carried through many batches, of which only the changed keys are written."""
    days = [[("old", at(1), 1, True, 9, .1)]] + [[(f"k{d}", at(0, d), d, False, 9, .1)] for d in range(3, 16)]
    days += [[("old", at(0, 16), 50, True, 9, .1), ("old", at(1, 16), 51, True, 9, .1)]]
    writer = batches.streak_writer(str(tmp_path / "s"), "vehicle_id", "timestamp", "seq", "hit", KINDS, 3, whole=4)
    for number, frame in enumerate(frames_of(spark, days)):
        writer(frame, number)
    writer.close(spark, frames_of(spark, days[:1])[0])
    assert [r["seq"] for r in writer.results(spark).collect()] == [51]
    kept = sorted(int(p.name.split("=")[1]) for p in (tmp_path / "s" / "carry").iterdir() if p.is_dir())
    assert kept[0] >= 8 and len(kept) <= 8


def test_sessions_of_a_hot_vehicle(spark):
    """Sessions equal a plain loop, for a vehicle with a third of all rows, across slots and inside them."""
    rnd = random.Random(5)
    rows, t = [], 0
    for _ in range(3000):
        t += rnd.choice([1, 30, 299, 300, 301, 900, 5000])
        rows.append(("hot", t))
    rows += [(f"v{rnd.randrange(40)}", rnd.randrange(300_000)) for _ in range(6000)]
    want, last = {}, {}
    for v, s in sorted(rows):
        if v not in last or s - last[v][1] >= 300:
            last[v] = [s, s, 0]
            want[v, s] = last[v]
        last[v][1], last[v][2] = s, last[v][2] + 1
    df = spark.createDataFrame(rows, "vehicle_id string, s int").select("vehicle_id", F.timestamp_seconds("s").alias("timestamp"))
    trips = sessions.trip_sessions(df, 300)
    assert "MergingSessions" not in trips._jdf.queryExecution().executedPlan().toString()
    got = {(r.vehicle_id, int(r.a)): [int(r.a), int(r.b), r.pings] for r in trips.select("vehicle_id", F.unix_timestamp("first_ping").alias("a"), F.unix_timestamp("last_ping").alias("b"), "pings").collect()}
    assert got == want


def test_one_minute_and_session_windows(spark):
    df = spark.createDataFrame([reading("VH-1", m, m) for m in (0, 1, 4, 30)], TEL)
    assert sessions.telemetry_1m(df).count() == 4
    trips = sorted((r["first_ping"].minute, r["pings"]) for r in sessions.trip_sessions(df, 300).collect())
    assert trips == [(0, 3), (30, 1)]


def test_severe_events_with_other_field_names(spark):
    df = messages(spark, [
        {"vehicle_id": "V", "dtc_code": "P1", "diagnostic_severity": "high", "timestamp": "2026-09-01T10:00:00Z"},
        {"vehicle_id": "V", "code": "P2"}, {"vehicle_id": "V", "severity": "HIGH"}, {"code": "P3", "severity": "HIGH"},
        {"vehicle_id": "V", "code": "P4", "severity": "CRITICAL", "timestamp": "bad"},
    ])
    got = {r["code"]: r["timestamp"] for r in contracts.severe_events(df, F.lit("2026-12-01 00:00:00").cast("timestamp")).collect()}
    assert got == {"P1": datetime(2026, 9, 1, 10), "P4": datetime(2026, 12, 1)}


def test_flagged_features(spark):
    rows = [(110.0, 5.0, True), (110.0, 5.0, False), (105.0, 4.0, True), (-11.0, 1.0, True)]
    df = spark.createDataFrame(rows, "temperature double, vibration double, a boolean")
    got = [r["m"] for r in df.select(alerts.flagged_features(F.col("a")).alias("m")).collect()]
    assert got == [{"temperature": 110.0, "vibration": 5.0}, {}, {}, {"temperature": -11.0}]
