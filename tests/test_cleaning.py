"""Cleaning rules, star schema loads and lake storage on small hand-made cases."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from motorlake.functions.exact import rounded_ratio
from motorlake.functions.text import is_breakdown
from motorlake.operators import quality
from motorlake.plans import dimensions as dims, facts, silver
from motorlake.sources import lake, manifest

SNAP = "2026-09-25"
TEL = "vehicle_id string, timestamp string, rpm double, temperature double, battery double, vibration double, _ingested_at string, _row_seq long"


def verdicts(spark, dataset, schema, rows):
    df = silver.validate(spark.createDataFrame(rows, schema), dataset, SNAP)
    return [r[silver.RULE] for r in df.collect()]


def test_telemetry_rules_in_order(spark):
    nan = float("nan")
    rows = [
        ("VH-1", "t", 2000.0, 90.0, 12.0, 1.0, "a", 1),
        ("  ", "t", 2000.0, 90.0, 12.0, 1.0, "a", 2),
        ("VH-1", None, 2000.0, 90.0, 12.0, 1.0, "a", 3),
        ("VH-1", "t", None, 90.0, 12.0, 1.0, "a", 4),
        ("VH-1", "t", -0.5, 90.0, 12.0, 1.0, "a", 5),
        ("VH-1", "t", 9000.9, 90.0, 12.0, 1.0, "a", 6),
        ("VH-1", "t", 9001.0, 999.0, 12.0, 1.0, "a", 7),
        ("VH-1", "t", 1.0, nan, 12.0, 1.0, "a", 8),
        ("VH-1", "t", nan, 90.0, 12.0, 1.0, "a", 9),
        ("VH-1", "t", 1.0, 160.0, 16.0, 15.0, "a", 10),
        ("VH-1", "t", 1.0, 90.0, 8.99, 1.0, "a", 11),
        ("VH-1", "t", 1.0, 90.0, 9.0, 15.01, "a", 12),
    ]
    assert verdicts(spark, "telemetry", TEL, rows) == [
        None, "RULE_TEL_PK_NOT_NULL", "RULE_TEL_PK_NOT_NULL", "RULE_TEL_TYPE_ERROR", None, None,
        "RULE_TEL_RPM_RANGE", "RULE_TEL_TEMP_RANGE", "RULE_TEL_TYPE_ERROR", None, "RULE_TEL_BATTERY_RANGE",
        "RULE_TEL_VIB_RANGE",
    ]


def test_text_input_must_be_numeric(spark):
    schema = TEL.replace("double", "string")
    rows = [
        ("VH-1", "t", "2000", "90.5", "12", "1", "a", 1),
        ("VH-1", "t", "fast", "90.5", "12", "1", "a", 2),
        ("VH-1", "t", "2000.5", "90.5", "12", "1", "a", 3),
        ("VH-1", "t", "2000", "", "12", "1", "a", 4),
    ]
    bad = "RULE_TEL_TYPE_ERROR"
    assert verdicts(spark, "telemetry", schema, rows) == [None, bad, bad, bad]


def test_other_rules(spark):
    d = "vehicle_id string, timestamp string, code string, component string, severity string"
    assert verdicts(spark, "diagnostics", d, [
        ("V", "t", " P0217 ", "x", " high "), ("V", "t", "p0217", "x", "HIGH"), ("V", "t", "P02177", "x", "HIGH"),
        ("V", "t", " ", "x", "HIGH"), ("V", "t", "P0217", "x", "INFO"), ("V", "t", "P0217", "x", None),
    ]) == [None, "RULE_DTC_CODE_REGEX", "RULE_DTC_CODE_REGEX", "RULE_DTC_PK_NOT_NULL", "RULE_DTC_SEVERITY", "RULE_DTC_SEVERITY"]
    s = "service_id string, vehicle_id string, dealer_id string, visit_date string, issue string, cost string"
    assert verdicts(spark, "service", s, [
        ("S", "V", "D", "2026-09-25", "i", "0"), ("S", "V", "D", "2026-09-26", "i", "1"), ("S", "V", "D", "", "i", "1"),
        ("", "V", "D", "2026-09-26", "i", "x"), ("", "V", "D", "2026-09-26", "i", "-1"), ("S", "V", "D", "2026-09-26", "i", "-1"),
    ]) == [None, "RULE_SRV_DATE_VALID", None, "RULE_SRV_TYPE_ERROR", "RULE_SRV_PK_NOT_NULL", "RULE_SRV_COST_RANGE"]
    w = "claim_id string, vehicle_id string, component string, claim_date date, amount double"
    assert verdicts(spark, "warranty", w, [
        ("C", "V", "c", date(2026, 9, 1), 0.01), ("C", "V", "c", date(2026, 9, 1), 0.0), ("C", "V", "c", date(2027, 1, 1), 5.0),
    ]) == [None, "RULE_WRN_AMOUNT_POS", "RULE_WRN_DATE_VALID"]
    p = "part_id string, dealer_id string, stock int, lead_time int"
    assert verdicts(spark, "parts", p, [("P", "D", 0, 1), ("P", "D", -1, 0), ("P", "D", 3, 0), ("P", " ", 3, 2), ("P", "D", None, 2)]) == [
        None, "RULE_PRT_STOCK_RANGE", "RULE_PRT_LEAD_RANGE", "RULE_PRT_PK_NOT_NULL", "RULE_PRT_TYPE_ERROR"]


def test_duplicate_and_range_go_to_quarantine_verbatim(spark):
    rows = [
        ("VH-1", "2026-09-01 10:00:00", 2000.0, 90.0, 12.0, 1.0, "2026-09-02", 1),
        ("VH-1", "2026-09-01 10:00:00", 2100.0, 90.0, 12.0, 1.0, "2026-09-01", 2),
        (" VH-2 ", "2026-09-01 10:00:00", 12000.0, 90.0, 12.0, 1.0, "2026-09-01", 3),
    ]
    df = spark.createDataFrame(rows, TEL).withColumn("_batch_id", F.lit("B"))
    tagged = silver.tag_rows(df, "telemetry", SNAP, ["_row_seq"])
    clean = silver.clean_rows(tagged, "telemetry", "S", "now").collect()
    bad = {r["_quarantine_rule"]: r for r in silver.quarantine_rows(tagged, "now").collect()}
    assert len(clean) == 1 and clean[0]["rpm"] == 2000.0 and clean[0]["_bronze_batch_id"] == "B"
    assert set(bad) == {"DUPLICATE_KEY", "RULE_TEL_RPM_RANGE"}
    assert bad["RULE_TEL_RPM_RANGE"]["rpm"] == 12000.0 and bad["RULE_TEL_RPM_RANGE"]["vehicle_id"] == " VH-2 "
    assert silver.outcome(tagged, "telemetry").first()["conserved"]
    silver.assert_conserved(3, 1, 2, "telemetry")
    with pytest.raises(ValueError):
        silver.assert_conserved(3, 1, 1, "telemetry")


def test_bounds_fail_fast_only_on_remaining_rows(spark):
    df = spark.createDataFrame([(1, 5), (2, -5)], "id int, cost int")
    guard = {"cost": F.col("cost") >= 0}
    assert [r["cost"] for r in quality.assert_bounds(df.where("id = 1"), guard).collect()] == [5]
    with pytest.raises(Exception, match="bound violated: cost"):
        quality.assert_bounds(df, guard).collect()


def test_rounding_is_half_away_from_zero(spark):
    rows = [("0.125", 1, 0.13), ("-0.125", 1, -0.13), ("0.25", 2, 0.13), ("1.00", 3, 0.33), ("-1.00", 3, -0.33)]
    for text, n, expected in rows:
        value = F.lit(text).cast("decimal(20,3)") * 1000
        out = spark.range(1).select(rounded_ratio(value.cast("decimal(38,0)"), F.lit(n * 1000), 2).alias("x"))
        assert float(out.first()["x"]) == expected


def test_breakdown_text(spark):
    texts = ["Scheduled routine maintenance and multi-point inspection", "", None, "Coolant LEAK", " strut swap ", "Cabin check",
             "Scheduled routine maintenance and multi-point inspection and repair"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(is_breakdown(F.col("t")).alias("b"))
    assert [r["b"] for r in df.collect()] == [False, False, False, True, True, False, True]


def test_upsert_and_insert_absent(spark):
    old = spark.createDataFrame([("a", 1, 10), ("b", 2, 20)], "k string, id int, v int")
    new = spark.createDataFrame([("b", 7, None), ("c", 8, 30)], "k string, id int, v int")
    out = {r["k"]: (r["id"], r["v"]) for r in dims.upsert(old, new, ["k"], keep=["id"]).collect()}
    assert out == {"a": (1, 10), "b": (2, None), "c": (8, 30)}
    out = {r["k"]: r["v"] for r in dims.insert_absent(old, new, ["k"]).collect()}
    assert out == {"a": 10, "b": 20, "c": 30}


def test_calendar(spark):
    cal = dims.dim_date(spark)
    assert cal.count() == 4019
    r = cal.where("date_key = 20231231").first()
    assert (r["day_of_week"], r["day_name"], r["week_of_year"], r["quarter"], r["is_weekend"]) == (7, "Sunday", 52, 4, True)


def test_second_load_adds_nothing(spark, sf_dir):
    from motorlake.plans import warehouse as wh
    from motorlake.session import scratch_path

    w = wh.Warehouse(spark, scratch_path(spark, "twice"))
    clean = wh.load_silver(w, lambda n: wh.raw_set(spark, sf_dir, n))
    wh.load_dimensions(w, clean)
    wh.load_facts(w, clean)
    before = {r["table_name"]: r["rows"] for r in wh.row_counts(w).collect()}
    ids = {r["service_id"]: r["service_fact_id"] for r in w.table("fact_service").collect()}
    wh.reload_facts(w, clean)
    assert {r["table_name"]: r["rows"] for r in wh.row_counts(w).collect()} == before
    assert {r["service_id"]: r["service_fact_id"] for r in w.table("fact_service").collect()} == ids
    # another reader of the folder finds the replaced tables
    other = wh.Warehouse(spark, w.path)
    assert other.table("fact_service").inputFiles()[0].split("/")[-2] != "fact_service"
    assert {r["table_name"]: r["rows"] for r in wh.row_counts(other).collect()} == before
    for name, key in facts.FACT_IDS.items():
        assert quality.duplicates(w.table(name), [key]).count() == 0


def test_scans_read_the_folders_of_their_days(spark, sf_dir):
    from motorlake.plans import features
    from motorlake.plans import warehouse as wh

    w = wh.open_warehouse(spark, sf_dir)
    fact, vehicles = w.table("fact_telemetry"), w.table("dim_vehicle")

    def filters(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return plan.split("PartitionFilters: [")[1].split("]")[0]

    assert "date_key" in filters(features.telemetry_window_features(fact, vehicles, ["2024-01-10"]))
    part = fact.where("date_key = 20240105").drop("telemetry_fact_id", "_loaded_at")
    new = facts.new_telemetry(part.withColumn("vehicle_key", F.lit(10**9)), fact)
    assert new.count() == part.count() and facts.new_telemetry(part, fact).count() == 0
    assert any("date_key" in p for p in new._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1:])


def test_load_keeps_rejected_rows(spark, sf_dir, monkeypatch):
    from motorlake.plans import warehouse as wh
    from motorlake.session import scratch_path

    def with_copies(name):
        raw = wh.raw_set(spark, sf_dir, name)
        return raw.unionAll(raw.withColumn("_row_uid", F.concat(F.lit("again-"), F.col("_row_uid").cast("string"))))

    monkeypatch.setattr(wh, "SETS", ["dealers", "service"])
    w = wh.Warehouse(spark, scratch_path(spark, "rejected"))
    clean = wh.load_silver(w, with_copies)
    for n in wh.SETS:
        rows = 2 * wh.raw_set(spark, sf_dir, n).count()
        rejected = w.table(f"quarantine/{n}")
        assert w.table(f"bronze/{n}").count() == rows == clean[n].count() + rejected.count()
        assert rejected.where("_quarantine_rule = 'DUPLICATE_KEY' and _quarantine_reason is not null").count() >= rows // 2
    # a later load replaces all three layers; a set without rows is no error
    clean = wh.load_silver(w, lambda n: wh.raw_set(spark, sf_dir, n) if n == "dealers" else wh.raw_set(spark, sf_dir, n).limit(0), again=True)
    assert clean["dealers"].count() == w.table("bronze/dealers").count() == wh.raw_set(spark, sf_dir, "dealers").count()
    assert clean["service"].count() == w.table("quarantine/service").count() == 0
    monkeypatch.setattr(wh.silver, "quarantine_rows", lambda tagged, at: tagged.limit(0))
    with pytest.raises(ValueError):
        wh.load_silver(wh.Warehouse(spark, scratch_path(spark, "lost")), with_copies)


def test_whole_later_load(spark, sf_dir):
    """The same sets again, from raw rows to the bridge: no row, key or id changes."""
    from motorlake.plans import warehouse as wh
    from motorlake.session import scratch_path

    source = lambda n: wh.raw_set(spark, sf_dir, n)
    w = wh.Warehouse(spark, scratch_path(spark, "later"))
    clean = wh.load_silver(w, source)
    wh.load_dimensions(w, clean)
    wh.load_facts(w, clean)
    keys = {n: ("*" if n.startswith("dim_") else facts.FACT_IDS.get(n, "diagnostic_id")) for n in wh.TABLES}
    before = {n: sorted(map(str, w.table(n).select(k).collect())) for n, k in keys.items()}
    wh.load_again(w, source)
    assert {n: sorted(map(str, w.table(n).select(k).collect())) for n, k in keys.items()} == before


def test_diagnostic_id(spark):
    import hashlib

    df = spark.createDataFrame([("VH-1", datetime(2026, 9, 1, 8, 30), "P0217", "c", "HIGH")],
                               "vehicle_id string, timestamp timestamp_ntz, code string, component string, severity string")
    expected = hashlib.md5(b"VH-1|2026-09-01T08:30:00|P0217").hexdigest()
    assert facts.diagnostics_bridge(df).first()["diagnostic_id"] == expected


def test_manifest_finds_new_and_changed_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1")
    (tmp_path / "b.csv").write_text("2")
    (tmp_path / "c.tmp").write_text("3")
    files = manifest.scan_files(spark, str(tmp_path))
    assert files.count() == 2
    known = spark.createDataFrame(files.collect(), files.schema).withColumns({"ingestion_batch_id": F.lit("1"), "processed_at": F.lit("")})
    assert manifest.changed_files(files, known).where("is_changed").count() == 0
    (tmp_path / "b.csv").write_text("9")
    (tmp_path / "d.csv").write_text("4")
    changed = manifest.changed_files(manifest.scan_files(spark, str(tmp_path)), known).where("is_changed")
    assert sorted(r["path"][-5:] for r in changed.collect()) == ["b.csv", "d.csv"]


def test_a_file_is_never_a_row(spark, tmp_path):
    """A sparse file of more than 2 GB is hashed in chunks; files of the recorded size and time are not read again."""
    import hashlib
    import os

    size = (2 << 30) + 5
    with open(tmp_path / "big.bin", "wb") as f:
        f.truncate(size)
    (tmp_path / "é b.csv").write_text("x")
    scanned = {r["path"].rsplit("/", 1)[1]: r for r in manifest.scan_files(spark, str(tmp_path)).collect()}
    state, zeros = hashlib.sha256(), bytes(1 << 20)
    for _ in range(2048):
        state.update(zeros)
    state.update(bytes(5))
    assert scanned["big.bin"]["sha256"] == state.hexdigest() and scanned["big.bin"]["file_size"] == size
    assert hashlib.sha256(b"x").hexdigest() in {r["sha256"] for r in scanned.values()}
    known = spark.createDataFrame(list(scanned.values()), manifest.list_files(spark, str(tmp_path)).schema.add("sha256", "string"))
    stat = os.stat(tmp_path / "big.bin")
    with open(tmp_path / "big.bin", "r+b") as f:  # other content, same size and time: the record holds
        f.write(b"1")
    os.utime(tmp_path / "big.bin", ns=(stat.st_atime_ns, stat.st_mtime_ns))
    again = {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in manifest.scan_files(spark, str(tmp_path), manifest=known).collect()}
    assert again["big.bin"] == state.hexdigest()


def test_predictions_are_appended_once(spark, tmp_path):
    rows = lambda *v: spark.createDataFrame([(f"p{k}", datetime(2026, 9, d), k) for k, d in v], "id string, at timestamp_ntz, n int")
    path = str(tmp_path / "p")
    for batch, part in (("a", rows((1, 1), (2, 2), (2, 2))), ("b", rows((2, 2), (3, 3))), ("a", rows((1, 1), (2, 2), (2, 2))), ("c", rows((3, 3), (9, 30)))):
        table = lake.write_predictions(part, path, "id", F.col("at"), batch)
    assert sorted((r["id"], r["_batch"]) for r in table.collect()) == [("p1", "a"), ("p2", "a"), ("p3", "b"), ("p9", "c")]


def test_raw_csv_keeps_row_order_positions(spark, tmp_path):
    lines = ["dealer_id,name,region,city,bays"] + [f"D{i},n,r,c,{i}" for i in range(200)]
    (tmp_path / "dealers.csv").write_text("\n".join(lines))
    df = lake.with_audit(lake.read_raw(spark, str(tmp_path), "dealers"), "B", "2024-01-01", "dealers.csv")
    assert [r["dealer_id"] for r in df.orderBy("_row_seq").collect()] == [f"D{i}" for i in range(200)]
