"""Findings on larger tables: rows that collide, and rows that are shuffled without need."""

import re
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from motorlake.catalog import warehouse as catalog
from motorlake.learning import iforest
from motorlake.operators.dedup import latest_rows, tag_kept
from motorlake.plans import dimensions as dims, scoring, warehouse as wh
from motorlake.sources import adapters, lake

SENSORS = ["rpm", "temperature", "vibration"]


def test_readings_of_unregistered_vehicles_at_one_time_are_two_predictions(spark, tmp_path):
    at = datetime(2024, 1, 2)
    pdf = pd.DataFrame(
        {"telemetry_fact_id": range(8), "vehicle_id": ["UNKNOWN_VH"] * 2 + [f"VH-{k}" for k in range(6)], "timestamp": [at] * 8}
        | {c: [float(k * k) for k in range(8)] for c in SENSORS}
    )
    df = spark.createDataFrame(pdf)
    forest = iforest.fit(df, SENSORS, ["telemetry_fact_id"], trees=5)
    rows = scoring.sensor_anomalies(forest, df, "v", "t")
    for batch in ("a", "a", "b"):
        table = lake.write_predictions(rows, str(tmp_path / "p"), "prediction_id", F.col("window_timestamp"), batch)
    assert table.count() == 8
    assert table.select("anomaly_id").distinct().count() == 7


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_rows_without_copies_are_not_shuffled(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(3000).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("o"), F.col("id").alias("uid")).write.parquet(path)
    unique = tag_kept(spark.read.parquet(path), ["k"], [F.col("o")], ["uid"])
    assert exchanges(unique) == 0 and unique.where("_kept").count() == 3000
    few = tag_kept(spark.read.parquet(path).withColumn("k", F.when(F.col("o") < 3, F.lit("k0")).otherwise(F.col("k"))), ["k"], [F.col("o")], ["uid"])
    assert exchanges(few) == 0
    assert [r.uid for r in few.where("not _kept").orderBy("uid").collect()] == [0, 1] and few.count() == 3000


def test_query_loads_only_the_tables_it_reads(spark, sf_dir, monkeypatch):
    """Each table once and whole, after those it is made of; a step that failed is tried again."""
    loaded = []
    real = wh.load_set

    def load_set(w, source, n, *rest):
        loaded.append(n)
        if loaded.count("customers") == 1 and n == "customers":
            raise OSError("lost")
        real(w, source, n, *rest)

    monkeypatch.setattr(wh, "_open", {})
    monkeypatch.setattr(wh, "load_set", load_set)
    with pytest.raises(OSError):
        wh.open_warehouse(spark, sf_dir, "fact_service", "dim_vehicle")
    w = wh.open_warehouse(spark, sf_dir, "fact_service", "dim_vehicle")
    assert w.table("fact_service").count() == w.table("silver/service").count() > 0
    assert sorted(loaded) == sorted(["vehicles", "vehicle_customer_map", "service", "customers", "customers", "dealers"])
    assert {r["table_name"] for r in wh.row_counts(w).collect()} == set(wh.TABLES)
    assert set(loaded) == set(wh.SETS) and len(loaded) == len(wh.SETS) + 1


def test_second_load_loads_only_the_facts_it_shows(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(catalog, "_loaded_twice", {})
    w, first = catalog.loaded_twice(spark, sf_dir)
    assert first == {} and not any(n.startswith("fact_") for n in w._places)
    w, first = catalog.loaded_twice(spark, sf_dir, "fact_service")
    ids = first["fact_service"].join(w.table("fact_service"), ["service_id", "service_fact_id"])
    assert ids.count() == first["fact_service"].count() == w.table("fact_service").count() > 0


def test_rows_of_one_key_each_are_not_shuffled_to_find_the_latest(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(3000).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v")).write.parquet(path)
    rows = spark.read.parquet(path)
    unique = latest_rows(rows, ["k"], ["v"])
    assert exchanges(unique) == 0 and unique.count() == 3000
    some = latest_rows(rows.withColumn("k", F.when(F.col("k") < 3, F.lit(None)).otherwise(F.col("k"))), ["k"], ["v"])
    assert some.count() == 2998 and [r.v for r in some.where("k is null").collect()] == ["v2"]


def broadcast_keys(df) -> set[str]:
    """The left keys of the broadcast joins in a plan."""
    return set(re.findall(r"BroadcastHashJoin \[(\w+)#", df._jdf.queryExecution().executedPlan().toString()))


def test_members_are_not_broadcast_to_members(spark, tmp_path):
    """Small files may hold many members, so only what does not grow with them goes through the driver."""

    def stored(name, *columns):
        spark.range(2000).selectExpr(*columns).write.option("compression", "zstd").parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    vehicles = stored("v", "concat('VH-', id) AS vehicle_id", "'Apex' AS model", "'V' AS variant", "'2020-01-01' AS manufacture_date", "'DLR-1' AS dealer_id")
    owners = stored("o", "concat('VH-', id) AS vehicle_id", "concat('CUST-', id + 1) AS customer_id").where("vehicle_id <> 'VH-7'")
    models, dealers = stored("m", "'Apex' AS model_name", "id + 1 AS model_key").limit(1), stored("d", "concat('DLR-', id) AS dealer_id", "id AS dealer_key")
    customers, parts = stored("c", "concat('CUST-', id) AS customer_id", "id AS customer_key"), stored("p", "concat('PRT-', id) AS part_id", "concat('n', id) AS name")
    old = stored("old", "concat('VH-', id) AS vehicle_id", "id + 1 AS vehicle_key").where("vehicle_key <= 1500")
    built = dims.dim_vehicle(vehicles, owners, models, dealers, customers, old)
    assert broadcast_keys(built) <= {"model", "_bucket"}
    rows = {r.vehicle_id: r for r in built.where("vehicle_key > 0").collect()}
    assert len(rows) == 2000 and sorted(r.vehicle_key for r in rows.values()) == list(range(1, 2001))
    assert rows["VH-9"].vehicle_key == 10 and rows["VH-9"].customer_key == 10 and rows["VH-9"].selling_dealer_key == 1
    assert rows["VH-7"].customer_key == rows["VH-1999"].customer_key == -1
    named = stored("k", "concat('n', id) AS component_name", "id + 1 AS component_key").where("component_key <= 1000")
    looked_up = dims.part_lookup(parts, named)
    assert broadcast_keys(looked_up) == set()
    assert {r.part_id: r.component_key for r in looked_up.collect()} == {f"PRT-{k}": k + 1 if k < 1000 else -1 for k in range(2000)}


def test_nations_are_broadcast_not_suppliers(spark, sf_dir):
    for of in (adapters.dealers, adapters.customers):
        plan = of(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert re.findall(r"BroadcastHashJoin \[[sc]_nationkey#.*", plan)[0].split(", ")[3] == "BuildRight"
