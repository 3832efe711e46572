"""Operators against plain Python on data with one very busy key."""

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from motorlake.operators.cumulative import exact_quantiles, fractional_rank, running_totals, split_by_position
from motorlake.operators.dedup import latest_rows, tag_kept
from motorlake.operators.intervals import flag_near_events
from motorlake.operators.keys import assign_keys
from motorlake.operators.slots import active_time, non_increasing, streak_alerts

T0 = datetime(2024, 1, 1)


def busy_readings(seed, n=1500):
    """A third of the rows belong to one vehicle; times repeat and cross midnight and slots."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        vehicle = "hot" if rnd.random() < 0.34 else f"v{rnd.randint(1, 12)}"
        ts = T0 + timedelta(seconds=rnd.choice([0, 1, 299, 300, 301, 3599, 3600, 3601]) + 60 * rnd.randint(0, 4000))
        rows.append((vehicle, ts, i, rnd.random() < 0.6, rnd.choice([0, 800, 5000])))
    return rows


SCHEMA = "vehicle string, ts timestamp_ntz, id long, hit boolean, rpm int"


@pytest.mark.parametrize("seed,length", [(1, 3), (2, 3), (3, 2), (4, 5)])
def test_streaks_equal_a_sequential_count(spark, seed, length):
    rows = busy_readings(seed)
    expected = []
    count = {}
    for v, ts, i, hit, _ in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        count[v] = count.get(v, 0) + 1 if hit else 0
        if count[v] == length:
            expected.append(i)
            count[v] = 0
    df = spark.createDataFrame(rows, SCHEMA)
    got = [r["id"] for r in streak_alerts(df, "vehicle", "ts", "id", "hit", length).collect()]
    assert sorted(got) == sorted(expected)


def test_streak_spans_many_slots(spark):
    rows = [("v", T0 + timedelta(hours=5 * i), i, i != 4, 1) for i in range(12)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(r["id"] for r in streak_alerts(df, "vehicle", "ts", "id", "hit", 3).collect())
    assert got == [2, 7, 10]


@pytest.mark.parametrize("seed", [5, 6])
def test_active_time_equals_a_sequential_sum(spark, seed):
    rows = busy_readings(seed)
    expected = {}
    last = {}
    for v, ts, i, _, rpm in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        key = (v, ts.date())
        gap = (ts - last[key]).total_seconds() if key in last else 0
        expected[key] = expected.get(key, 0) + (gap if 0 < gap <= 300 and rpm > 0 else 0)
        last[key] = ts
    df = spark.createDataFrame(rows, SCHEMA).withColumn("day", F.col("ts").cast("date"))
    out = active_time(df, ["vehicle", "day"], "ts", "id", F.col("rpm") > 0, 300, {"n": (F.lit(1), "sum")}, slot_seconds=600)
    got = {(r["vehicle"], r["day"]): r["active_micros"] / 1e6 for r in out.collect()}
    assert got == expected


@pytest.mark.parametrize("seed", [7, 8])
@pytest.mark.parametrize("before,after", [(2, 6), (1.5, 4.25), (0, 3)])
def test_intervals_equal_all_pairs(spark, seed, before, after):
    rows = busy_readings(seed, 700)
    rnd = random.Random(seed + 100)
    events = [(r[0], r[1] + timedelta(hours=rnd.choice([-6, -2, 0, 2, 6, 1.5, -4.25]))) for r in rows if rnd.random() < 0.05]
    expected = {
        r[2]
        for r in rows
        if any(v == r[0] and e - timedelta(hours=before) <= r[1] <= e + timedelta(hours=after) for v, e in events)
    }
    df = flag_near_events(
        spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(events, "vehicle string, ets timestamp_ntz"),
        "vehicle", "ts", "ets", int(before * 3600), int(after * 3600), "near",
    )
    assert {r["id"] for r in df.where("near").collect()} == expected
    assert df.count() == len(rows)


def test_intervals_refuse_slots_wider_than_the_window(spark):
    df = spark.createDataFrame([("a", T0)], "k string, t timestamp_ntz")
    with pytest.raises(ValueError):
        flag_near_events(df, df, "k", "t", "t", 0, 3600, "x")


def test_non_increasing_across_blocks(spark):
    rnd = random.Random(9)
    rows = [("hot" if rnd.random() < 0.5 else f"k{rnd.randint(0, 3)}", T0 + timedelta(minutes=i + rnd.randint(-3, 3)), i) for i in range(500)]
    last, expected = {}, set()
    for k, t, i in rows:
        if k in last and t <= last[k]:
            expected.add(i)
        last[k] = t
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, i long")
    assert {r["i"] for r in non_increasing(df, "k", "t", "i", block=17).collect()} == expected


def test_latest_wins_with_hot_and_null_keys(spark):
    rows = [(None if i % 5 == 0 else ("hot" if i % 3 == 0 else f"k{i % 40}"), f"2024-01-{1 + i % 28:02d}", i) for i in range(1000)]
    best = {}
    for k, at, i in rows:
        best[k] = max(best.get(k, ("", -1)), (at, i))
    df = spark.createDataFrame(rows, "k string, at string, seq long")
    tagged = tag_kept(df, ["k"], [F.col("at"), F.col("seq")], ["seq"])
    assert tagged.count() == 1000
    assert {(r["k"], (r["at"], r["seq"])) for r in tagged.where("_kept").collect()} == set(best.items())
    first = tag_kept(df, ["k"], [F.col("seq")], ["seq"], keep="earliest").where("_kept")
    assert {r["seq"] for r in first.collect()} == {min(i for k2, _, i in rows if k2 == k) for k in best}
    assert {(r["k"], (r["at"], r["seq"])) for r in latest_rows(df, ["k"], ["at", "seq"]).collect()} == set(best.items())


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(11)
    g = rng.choice(["a", "b", "c"], 3000, p=[0.6, 0.3, 0.1])
    # a third of all rows share one value
    v = np.where(rng.random(3000) < 0.34, 7.0, np.round(rng.normal(50, 20, 3000), 2))
    pdf = pd.DataFrame({"g": g, "v": v, "id": np.arange(3000)})
    return pdf, spark.createDataFrame(pdf)


def test_running_totals(values):
    pdf, df = values
    got = running_totals(df, "v", ["g"]).toPandas()
    for g, part in pdf.groupby("g"):
        mine = got[got["g"] == g].sort_values("v")
        counts = part["v"].value_counts().sort_index()
        assert mine["v"].tolist() == counts.index.tolist()
        assert mine["n"].tolist() == counts.tolist()
        assert mine["n_before"].tolist() == (counts.cumsum() - counts).tolist()
        assert set(mine["n_total"]) == {len(part)}


def test_exact_quantiles(values):
    pdf, df = values
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.988, "e": 1.0}
    for r in exact_quantiles(df, "v", probs, ["g"]).collect():
        part = pdf[pdf["g"] == r["g"]]["v"]
        for name, p in probs.items():
            assert r[name] == pytest.approx(np.percentile(part, 100 * p), abs=1e-9)
    whole = exact_quantiles(df, "v", probs).first()
    assert whole["c"] == pytest.approx(np.median(pdf["v"]))


def test_fractional_rank(values, spark):
    pdf, df = values
    got = fractional_rank(df, "v").toPandas().set_index("id")["rank_score"]
    expected = (pdf["v"].rank(method="min") - 1) / (len(pdf) - 1)
    assert np.allclose(got.sort_index(), expected)
    assert fractional_rank(spark.createDataFrame([(1.0,)], "v double"), "v").first()["rank_score"] == 0.0


@pytest.mark.parametrize("fractions", [(0.70, 0.85), (0.1, 0.34), (0.2, 0.3)])
def test_split_by_position_inside_ties(values, fractions):
    pdf, df = values
    got = split_by_position(df, "v", "id", fractions).toPandas().set_index("id")["split"]
    order = pdf.sort_values(["v", "id"])["id"].tolist()
    cuts = [int(len(order) * f) for f in fractions]
    for position, i in enumerate(order):
        assert got[i] == sum(position >= c for c in cuts)


def test_assign_keys_are_dense_and_follow_existing(spark):
    df = spark.createDataFrame([(f"id{i}",) for i in range(500)], "nat string")
    keys = sorted(r["k"] for r in assign_keys(df, "nat", "k").collect())
    assert keys == list(range(1, 501))
    old = spark.createDataFrame([(-1,), (40,)], "k int")
    assert min(r["k"] for r in assign_keys(df, "nat", "k", existing=old).collect()) == 41
    again = {(r["nat"], r["k"]) for r in assign_keys(df.repartition(3), "nat", "k").collect()}
    assert again == {(r["nat"], r["k"]) for r in assign_keys(df, "nat", "k").collect()}
