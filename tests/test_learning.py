"""Models, metrics, drift, rules: properties and brute-force values."""

from datetime import date, datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from motorlake.learning import drift, forests, iforest, metrics, registry
from motorlake.plans import actions, features, scoring


def brute_metrics(y, s):
    pos, neg = s[y == 1], s[y == 0]
    roc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    points = [(0.0, 1.0)]
    for t in sorted(set(s), reverse=True):
        called = s >= t
        points.append((y[called].sum() / y.sum(), y[called].mean()))
    pr = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))
    return roc, pr


def test_classification_metrics_with_ties(spark):
    rng = np.random.default_rng(1)
    s = np.round(rng.random(400), 1)
    y = (rng.random(400) < s).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"s": s, "y": y}))
    m = metrics.classification_metrics(df, "s", "y", digits=9).first()
    roc, pr = brute_metrics(y, s)
    assert m["roc_auc"] == pytest.approx(roc) and m["pr_auc"] == pytest.approx(pr)
    assert m["brier"] == pytest.approx(np.mean((s - y) ** 2))
    called = s >= 0.5
    assert m["precision"] == pytest.approx(y[called].mean()) and m["recall"] == pytest.approx(y[called].sum() / y.sum())
    one = metrics.classification_metrics(df.where("y = 1"), "s", "y").first()
    assert one["roc_auc"] == 0.5


def test_forest_ranks_outliers_and_is_repeatable(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (600, 2))
    x[:6] += 9
    pdf = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "id": [f"r{i}" for i in range(600)]})
    df = spark.createDataFrame(pdf)
    forest = iforest.fit(df, ["a", "b"], ["id"], trees=40, sample=128)
    scored = df.withColumn("score", forest.score()).toPandas().set_index("id")["score"]
    assert scored.min() == 0.0 and scored.max() == 1.0
    assert {f"r{i}" for i in range(6)} <= set(scored.sort_values().index[-12:])
    again = iforest.fit(df.repartition(5), ["a", "b"], ["id"], trees=40, sample=128)
    assert np.allclose(df.withColumn("score", again.score()).toPandas().set_index("id")["score"][scored.index], scored)
    sizes = forest.nodes.groupBy("tree").agg(F.max("size").alias("s"), F.max("depth").alias("d")).collect()
    assert len(sizes) == 40 and all(r["s"] == 128 and r["d"] <= 7 for r in sizes)
    threshold = forest.calibrate(df, 98.0)
    assert threshold == pytest.approx(np.percentile(scored, 98.0))
    assert abs((scored >= threshold).mean() - 0.02) < 0.005


def test_forest_round_trip(spark, tmp_path):
    df = spark.createDataFrame(pd.DataFrame({"a": np.arange(50.0), "id": np.arange(50)}))
    forest = iforest.fit(df, ["a"], ["id"], trees=10)
    forest.threshold = 0.7
    forest.save(str(tmp_path / "m"))
    back = iforest.IsolationForest.load(spark, str(tmp_path / "m"))
    assert back.threshold == 0.7 and back.features == ["a"] and back.sample == 50
    a = [r[0] for r in df.select(forest.score()).collect()]
    assert a == [r[0] for r in df.select(back.score()).collect()]


def test_average_path():
    assert iforest.average_path(1) == 0 and iforest.average_path(2) == 1
    assert float(iforest.average_path(256)) == pytest.approx(10.244770920116851)


def test_intervals_bracket_the_mean(spark, tmp_path):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"lag_7": rng.poisson(2, 300), "lag_14": rng.poisson(2, 300), "mean_prev_7": rng.random(300) * 3,
                        "day_of_week": rng.integers(0, 7, 300), "is_weekend": rng.integers(0, 2, 300)})
    pdf["service_count"] = rng.poisson(1 + pdf["lag_7"])
    df = spark.createDataFrame(pdf)
    model = forests.fit_demand(df, trees=20)
    out = forests.predict_interval(model, df, str(tmp_path / "f")).toPandas()
    assert (out["lower_bound_80"] <= out["predicted_volume"] + 1e-9).all()
    assert (out["predicted_volume"] <= out["upper_bound_80"] + 1e-9).all()
    direct = forests.predict_demand(model, df).toPandas()["predicted_volume"]
    assert np.allclose(sorted(direct), sorted(out["predicted_volume"]))


def test_intervals_by_an_own_walk_of_the_stored_nodes(spark, tmp_path):
    rng = np.random.default_rng(5)
    names = ["lag_7", "lag_14", "mean_prev_7", "day_of_week", "is_weekend"]
    pdf = pd.DataFrame({n: rng.integers(0, 7, 200) for n in names})
    pdf["service_count"] = rng.poisson(1 + pdf["lag_7"])
    df = spark.createDataFrame(pdf)
    model = forests.fit_demand(df, trees=15)
    out = forests.predict_interval(model, df, str(tmp_path / "f"))
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 8_000  # no literals by leaf
    nodes = {(r.treeID, r.nodeData.id): r.nodeData for r in spark.read.parquet(str(tmp_path / "f" / "data")).collect()}
    for row in out.collect():
        x = [float(row[n]) for n in names]
        values = []
        for tree in range(15):
            node = nodes[tree, 0]
            while node.leftChild >= 0:
                split = node.split
                if split.numCategories < 0:
                    left = x[split.featureIndex] <= split.leftCategoriesOrThreshold[0]
                else:
                    left = x[split.featureIndex] in split.leftCategoriesOrThreshold
                node = nodes[tree, node.leftChild if left else node.rightChild]
            values.append(node.prediction)
        assert row.predicted_volume == pytest.approx(np.mean(values))
        assert row.lower_bound_80 == pytest.approx(np.percentile(values, 10))
        assert row.upper_bound_80 == pytest.approx(np.percentile(values, 90))


def test_psi_and_ks(spark):
    rng = np.random.default_rng(4)
    ref, same, far = (pd.DataFrame({"x": rng.normal(m, s, 200), "few": [1.0] * 200}) for m, s in ((85, 5), (85, 5), (115, 15)))
    r = spark.createDataFrame(ref)
    quiet = {x["feature"]: x for x in drift.drift_report(r, spark.createDataFrame(same), ["x", "missing"]).collect()}
    loud = {x["feature"]: x for x in drift.drift_report(r, spark.createDataFrame(far), ["x"]).collect()}
    assert set(quiet) == {"x"} and quiet["x"]["psi"] < 0.2 and loud["x"]["psi"] > 0.2 and loud["x"]["drift_detected"]
    a, b = np.sort(ref["x"]), np.sort(far["x"])
    grid = np.concatenate([a, b])
    ks = np.abs(np.searchsorted(a, grid, "right") / 200 - np.searchsorted(b, grid, "right") / 200).max()
    assert loud["x"]["ks_statistic"] == pytest.approx(ks, abs=1e-4)
    edges = np.percentile(ref["x"], np.linspace(0, 100, 11))
    edges[0] -= 1e-5
    edges[-1] += 1e-5
    e, c = (np.histogram(v["x"], np.unique(edges))[0] for v in (ref, far))
    pe, pc = ((n + 1e-4) / (200 + 1e-3) for n in (e, c))
    assert loud["x"]["psi"] == pytest.approx(np.sum((pc - pe) * np.log(pc / pe)), abs=1e-4)
    assert drift.overall_drift(drift.drift_report(r, spark.createDataFrame(far), ["x"])).first()["overall_drift_detected"]


def test_ks_pvalue_series(spark):
    # Kolmogorov distribution: Q(1.0) = 0.26999967, Q(0.5) = 0.96394524
    n = F.lit(200.0)
    for d, q in ((0.1, 0.2699997), (0.05, 0.9639452), (0.001, 1.0)):
        got = spark.range(1).select(drift.ks_pvalue(F.lit(d), n, n).alias("p")).first()["p"]
        assert got == pytest.approx(q, abs=1e-6)


def test_registry(spark):
    make = lambda v, m, h: registry.entry(spark, "m", v, "t", "h", ["a"], h, {"x": m}, "p")
    table = registry.register(registry.register(registry.empty_registry(spark), make("1", 1.0, {"calibrated_threshold": 0.8})), make("1", 2.0, {}))
    (row,) = table.collect()
    assert row["metrics"] == {"x": 2.0} and registry.load_threshold(table, "m", "1") == 0.8
    with pytest.raises(LookupError):
        registry.load_threshold(table, "m", "2")
    with pytest.raises(ValueError):
        registry.load_threshold(make("3", 1.0, {}), "m", "3")


def test_tiers_and_gates(spark):
    df = spark.createDataFrame([(s,) for s in (0.75, 0.7499, 0.5, 0.25, 0.2499)], "s double")
    assert [r[0] for r in df.select(metrics.risk_tier(F.col("s"))).collect()] == ["CRITICAL", "HIGH", "HIGH", "MEDIUM", "LOW"]
    m = spark.createDataFrame([(0.7, 0.35, 0.1501)], "roc_auc double, pr_auc double, brier double")
    g = metrics.gates(m, ["roc_auc", "pr_auc", "brier"]).first()
    assert g["roc_auc_pass"] and g["pr_auc_pass"] and not g["brier_pass"] and not g["overall_pass"]


def test_rule_thresholds(spark):
    p = spark.createDataFrame(
        [("a", date(2026, 9, 2), 0.70), ("b", date(2026, 9, 2), 0.6999), ("c", date(2026, 9, 1), 0.99)],
        "vehicle_id string, cutoff_date date, risk_score double",
    ).withColumn("top_features", F.create_map(F.lit("x"), F.lit(1.0)))
    (hit,) = actions.rule_failure_risk(p).collect()
    assert hit["entity_id"] == "a" and "70.0% exceeds proposed initial trigger 70%" in hit["action_taken"]
    f = spark.createDataFrame(
        [("d1", date(2026, 9, 2), 18.0), ("d2", date(2026, 9, 2), 13.0), ("d3", date(2026, 9, 2), 15.0), ("d4", date(2026, 9, 3), 99.0)],
        "dealer_id string, forecast_date date, predicted_volume double",
    )
    assert [r["entity_id"] for r in actions.rule_demand_surge(f, 12.0).collect()] == ["d1"]
    assert actions.rule_demand_surge(f, 0.0).count() == 0
    assert sorted(r["entity_id"] for r in actions.rule_demand_surge(f).collect()) == ["d1", "d2", "d3"]
    s = [("v", datetime(2026, 9, 1, 10, i), x, x >= 0.8383, i) for i, x in enumerate((0.88, 0.91, 0.94, 0.20))]
    df = spark.createDataFrame(s, "vehicle_id string, window_timestamp timestamp_ntz, anomaly_score double, is_anomaly boolean, anomaly_id int")
    (alert,) = actions.rule_sensor_streak(df, 0.8383).collect()
    assert alert["trigger_value"] == 0.94


def test_actions_are_idempotent(spark):
    d = spark.createDataFrame(
        [("V", datetime(2026, 9, 1, 10), "P0217", " critical ")] * 2 + [("V", datetime(2026, 9, 1, 11), "P0217", "low")],
        "vehicle_id string, timestamp timestamp_ntz, code string, severity string",
    )
    batch = actions.rule_severe_dtc(d, 0.84)
    log = actions.append_actions(actions.empty_log(spark), batch, "now")
    assert log.count() == 1
    assert actions.append_actions(log, batch, "later").count() == 1
    marked = actions.new_actions(batch, log).first()
    assert not marked["is_new"] and marked["suppressed"] == 2
    import hashlib

    text = "RULE_2_SEVERE_DTC:V:2026-09-01T10:00:00:1.0000"
    assert log.first()["idempotency_key"] == hashlib.sha256(text.encode()).hexdigest()


def test_cutoffs_and_splits(spark):
    c = spark.createDataFrame([(date(2026, 9, 11),), (date(2026, 9, 12),), (date(2026, 8, 1),)], "cutoff_date date")
    lit = lambda t: F.lit(t).cast("date")
    got = {str(r["cutoff_date"]): r["eligible"] for r in features.validate_cutoffs(c, lit("2026-08-27"), lit("2026-09-25")).collect()}
    assert got == {"2026-09-11": True, "2026-09-12": False, "2026-08-01": False}
    with pytest.raises(ValueError):
        features.split_by_dates(c, "cutoff_date", "2026-09-02", "2026-09-01", "2026-09-03")


def test_fingerprint_ignores_order(spark):
    df = spark.range(100).withColumn("v", F.col("id") * 2)
    a, b = features.fingerprint(df).first(), features.fingerprint(df.orderBy(F.desc("id")).repartition(7)).first()
    assert a == b and a != features.fingerprint(df.where("id > 0")).first()


def test_claim_scores_span_zero_to_one(spark):
    pdf = pd.DataFrame({"claim_id": list("abcd"), "component_id": ["x"] * 4, "claim_amount": [150.0, 200.0, 180.0, 4500.0],
                        "median_ratio": [0.8, 1.05, 0.95, 23.7], "iqr_distance": [-0.1, 0.0, 0.0, 4.0], "vehicle_claims": [1, 1, 1, 1]})
    df = spark.createDataFrame(pdf)
    out = scoring.score_claims(iforest.fit(df, ["claim_amount", "median_ratio", "iqr_distance", "vehicle_claims"], ["claim_id"]), df, "v", "t")
    got = {r["claim_id"]: r for r in out.collect()}
    assert min(r["anomaly_score"] for r in got.values()) == 0.0 and got["d"]["anomaly_score"] == 1.0
    assert got["d"]["outlier_reasons"] and not got["c"]["outlier_reasons"]
