"""Distribution drift between a reference and a current frame, all features in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from motorlake import config
from motorlake.operators.cumulative import exact_quantiles, running_totals

_EPS = 1e-4
_MIN_VALUES = 5


def _long(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, v) for every non-missing value; features the frame lacks are skipped."""
    present = [f for f in features if f in df.columns]
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in present])
    rows = df.select(F.explode(pairs).alias("x")).select("x.*")
    return rows.where(F.col("v").isNotNull() & ~F.isnan("v"))


def psi(ref: DataFrame, cur: DataFrame, features: list[str], buckets: int = 10) -> DataFrame:
    """Population stability index per feature over the reference's quantile bins.

    Bins are half open, the last one closed; current values outside all bins count only in
    the size of the current sample.
    """
    probs = {f"e{i}": i / buckets for i in range(buckets + 1)}
    r, c = _long(ref, features), _long(cur, features)
    q = exact_quantiles(r, "v", probs, ["feature"])
    raw = [F.col(e) for e in probs]
    raw[0], raw[-1] = raw[0] - 1e-5, raw[-1] + 1e-5
    edges = q.select("feature", F.array_sort(F.array_distinct(F.array(*raw))).alias("edges"))
    both = r.withColumn("side", F.lit(1)).unionByName(c.withColumn("side", F.lit(0)))
    # one row per feature name, so the broadcast is as long as the feature list
    placed = both.join(F.broadcast(edges), "feature")
    last = F.size("edges") - 1
    below = F.size(F.filter("edges", lambda e: e <= F.col("v")))
    bin_no = F.when(F.col("v") == F.element_at("edges", -1), last).otherwise(below)
    inside = (bin_no >= 1) & (bin_no <= last)
    counts = (
        placed.withColumn("bin", F.when(inside, bin_no).otherwise(0))
        .groupBy("feature", "bin")
        .agg(F.sum("side").alias("n_ref"), F.sum(1 - F.col("side")).alias("n_cur"), F.max(last).alias("bins"))
    )
    # one row per feature and bin from here on
    totals = counts.groupBy("feature").agg(
        F.sum("n_ref").alias("t_ref"), F.sum("n_cur").alias("t_cur"), F.max("bins").alias("bins")
    )
    grid = totals.where(F.col("bins") >= 1).withColumn("bin", F.explode(F.sequence(F.lit(1), F.col("bins"))))
    filled = grid.join(counts.select("feature", "bin", "n_ref", "n_cur"), ["feature", "bin"], "left").na.fill(0)
    share_ref = (F.col("n_ref") + _EPS) / (F.col("t_ref") + _EPS * F.col("bins"))
    share_cur = (F.col("n_cur") + _EPS) / (F.col("t_cur") + _EPS * F.col("bins"))
    measured = filled.groupBy("feature").agg(
        F.max("t_ref").alias("n_ref"),
        F.max("t_cur").alias("n_cur"),
        F.round(F.sum((share_cur - share_ref) * F.ln(share_cur / share_ref)), 4).alias("psi"),
    )
    return measured.withColumn(
        "psi", F.when((F.col("n_ref") == 0) | (F.col("n_cur") == 0), 0.0).otherwise(F.col("psi"))
    )


def ks_statistic(ref: DataFrame, cur: DataFrame, features: list[str]) -> DataFrame:
    """Largest distance between the two empirical distributions, per feature."""
    both = _long(ref, features).withColumn("side", F.lit(1)).unionByName(
        _long(cur, features).withColumn("side", F.lit(0))
    )
    totals = running_totals(both, "v", ["feature"], {"a": F.col("side"), "b": 1 - F.col("side")})
    gap = F.abs(
        (F.col("a_before") + F.col("a")) / F.col("a_total") - (F.col("b_before") + F.col("b")) / F.col("b_total")
    )
    return totals.groupBy("feature").agg(
        F.max(gap).alias("ks"), F.max("a_total").alias("n_ref"), F.max("b_total").alias("n_cur")
    )


def ks_pvalue(d: Column, n_ref: Column, n_cur: Column, terms: int = 100) -> Column:
    """Asymptotic two-sided p-value: the Kolmogorov series."""
    en = F.sqrt(n_ref * n_cur / (n_ref + n_cur))
    x = en * d
    k = F.sequence(F.lit(1), F.lit(terms))
    total = F.aggregate(
        k,
        F.lit(0.0),
        lambda acc, i: acc + F.when(i % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * i * i * x * x),
    )
    # below this point the series needs ever more terms while the value is one
    return F.when(x < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 * total)))


def drift_report(ref: DataFrame, cur: DataFrame, features: list[str]) -> DataFrame:
    """PSI, KS and the drift decision per feature with at least five values on both sides."""
    ks = ks_statistic(ref, cur, features)
    p = psi(ref, cur, features).select("feature", "psi")
    joined = ks.join(p, "feature").where(
        (F.col("n_ref") >= _MIN_VALUES) & (F.col("n_cur") >= _MIN_VALUES)
    )
    value = ks_pvalue(F.col("ks"), F.col("n_ref"), F.col("n_cur"))
    drifted = (F.col("psi") >= config.PSI_LIMIT) | (value < config.KS_ALPHA)
    return joined.select(
        "feature",
        "psi",
        F.round("ks", 4).alias("ks_statistic"),
        F.round(value, 4).alias("ks_pvalue"),
        drifted.alias("drift_detected"),
    )


def overall_drift(report: DataFrame) -> DataFrame:
    return report.agg(
        F.coalesce(F.max("drift_detected"), F.lit(False)).alias("overall_drift_detected"),
        F.count("*").alias("features"),
        F.count_if("drift_detected").alias("drifted"),
    )
