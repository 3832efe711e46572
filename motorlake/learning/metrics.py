"""Model metrics as aggregates: no score vector ever reaches the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from motorlake import config
from motorlake.operators.cumulative import exact_quantiles, running_totals


def classification_metrics(
    df: DataFrame, score: str, label: str, groups: list[str] | None = None, digits: int = 4
) -> DataFrame:
    """PR-AUC (trapezoid), ROC-AUC, Brier, precision and recall at 0.5, per group.

    Running counts over the distinct scores give every point of both curves; tied scores
    form one point.  A single class has a ROC-AUC of one half.
    """
    groups = groups or []
    y = F.col(label).cast("long")
    curve = running_totals(
        df.select(*groups, score, label), score, groups, {"pos": y, "neg": 1 - y}
    )
    p, n = F.col("pos_total"), F.col("neg_total")
    tp_prev = p - F.col("pos_before") - F.col("pos")
    fp_prev = n - F.col("neg_before") - F.col("neg")
    tp, fp = tp_prev + F.col("pos"), fp_prev + F.col("neg")
    precision = tp / (tp + fp)
    precision_prev = F.when(tp_prev + fp_prev > 0, tp_prev / (tp_prev + fp_prev)).otherwise(F.lit(1.0))
    area_pr = F.when(p > 0, F.col("pos") / p * (precision + precision_prev) / 2)
    pairs = F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)
    areas = curve.groupBy(*groups).agg(
        F.coalesce(F.sum(area_pr), F.lit(0.0)).alias("pr_auc"),
        F.when((F.max(p) > 0) & (F.max(n) > 0), F.sum(pairs) / F.max(p) / F.max(n)).otherwise(0.5).alias("roc_auc"),
    )
    s = F.col(score)
    hit = (s >= 0.5).cast("long")
    flat = df.groupBy(*groups).agg(
        F.avg((s - y) * (s - y)).alias("brier"),
        F.sum(hit * y).alias("_tp"),
        F.sum(hit).alias("_called"),
        F.sum(y).alias("_real"),
        F.count("*").alias("rows"),
    )
    if groups:
        joined = flat.join(areas, groups)
    else:
        joined = flat.withColumns({c: areas.select(c).scalar() for c in ("pr_auc", "roc_auc")})
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return joined.select(
        *groups,
        "rows",
        F.round("pr_auc", digits).alias("pr_auc"),
        F.round("roc_auc", digits).alias("roc_auc"),
        F.round("brier", digits).alias("brier"),
        F.round(share(F.col("_tp"), F.col("_called")), digits).alias("precision"),
        F.round(share(F.col("_tp"), F.col("_real")), digits).alias("recall"),
    )


def regression_metrics(df: DataFrame, actual: str, predicted: str, digits: int = 4) -> DataFrame:
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    total = F.sum(a)
    return df.agg(
        F.round(F.when(total > 0, F.sum(F.abs(a - p)) / (total + 1e-5)).otherwise(0.0), digits).alias("wape"),
        F.round(F.avg(F.abs(a - p)), digits).alias("mae"),
        F.round(F.sqrt(F.avg((a - p) * (a - p))), digits).alias("rmse"),
    )


def baseline_lift(df: DataFrame, actual: str, predicted: str, baseline: str, digits: int = 4) -> DataFrame:
    """Mean absolute error of a naive baseline and the model's relative gain on it."""
    a = F.col(actual).cast("double")
    naive = F.avg(F.abs(a - F.col(baseline)))
    mae = F.avg(F.abs(a - F.col(predicted)))
    return df.agg(
        F.round(naive, digits).alias("naive_mae"),
        F.round((naive - mae) / (naive + 1e-9), digits).alias("lift"),
    )


def score_summary(df: DataFrame, score: str, threshold: Column | float, digits: int = 4) -> DataFrame:
    """Mean, median, largest score and share at or above the threshold."""
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    median = exact_quantiles(df, score, {"q": 0.5}).select("q").scalar()
    flagged = (F.col(score) >= limit).cast("int")
    return df.agg(
        F.round(F.avg(score), digits).alias("mean_score"),
        F.round(F.max(score), digits).alias("max_score"),
        F.round(F.avg(flagged), digits).alias("anomaly_rate"),
    ).withColumns({"median_score": F.round(median, digits), "threshold": F.round(limit, digits)})


def triage_summary(df: DataFrame, score: str, threshold: float = config.TRIAGE_RANK, digits: int = 4) -> DataFrame:
    flagged = (F.col(score) >= threshold).cast("int")
    median = exact_quantiles(df, score, {"q": 0.5}).select("q").scalar()
    return df.agg(
        F.round(F.avg(score), digits).alias("mean_score"),
        F.round(F.max(score), digits).alias("max_score"),
        F.round(F.min(score), digits).alias("min_score"),
        F.sum(flagged).alias("triage_count"),
        F.round(F.avg(flagged), digits).alias("triage_rate"),
    ).withColumn("median_score", F.round(median, digits))


def gates(metrics: DataFrame, names: list[str]) -> DataFrame:
    """One boolean per named acceptance limit and their conjunction."""
    checks = {}
    for name in names:
        op, limit = config.GATES[name]
        checks[f"{name}_pass"] = F.col(name) >= limit if op == ">=" else F.col(name) <= limit
    overall = F.lit(True)
    for c in checks.values():
        overall = overall & c
    return metrics.withColumns({**checks, "overall_pass": overall})


def risk_tier(score: Column) -> Column:
    tier = None
    for limit, name in config.RISK_TIERS:
        tier = F.when(score >= limit, name) if tier is None else tier.when(score >= limit, name)
    return tier.otherwise(config.RISK_TIER_DEFAULT)
