"""Running totals over sorted values, ranks, quantiles and positional cuts.

A window without a partition (or with one huge partition) sorts everything in a single
task.  Here the distinct values are range partitioned, each range is accumulated on its
own, and the totals of the earlier ranges are added: one small row per range and group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from motorlake.session import settle


def running_totals(
    df: DataFrame,
    value: str,
    groups: list[str] | None = None,
    weights: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per (group, value): each weight with ``_before`` and ``_total`` columns.

    ``_before`` is the sum over strictly smaller values of the group.
    """
    groups = groups or []
    weights = weights or {"n": F.lit(1)}
    counted = df.groupBy(*groups, value).agg(*[F.sum(w).alias(k) for k, w in weights.items()])
    # The range id must be the same for both uses below, so it is written once.
    ranged = settle(
        counted.repartitionByRange(*[F.col(g) for g in groups], F.col(value)).withColumn(
            "_range", F.spark_partition_id()
        ),
        "ranges",
    )
    sub = [*groups, "_range"]
    earlier = Window.partitionBy(*sub).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.select(
        "*", *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"{k}_local") for k in weights]
    )
    sums = ranged.groupBy(*sub).agg(*[F.sum(k).alias(f"{k}_sum") for k in weights])
    whole = Window.partitionBy(*(groups or [F.lit(0)]))
    previous = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *sub,
        *[F.coalesce(F.sum(f"{k}_sum").over(previous), F.lit(0)).alias(f"{k}_off") for k in weights],
        *[F.sum(f"{k}_sum").over(whole).alias(f"{k}_total") for k in weights],
    )
    joined = local.join(offsets, [(local[c].eqNullSafe(offsets[c])) for c in sub]) if groups else local.join(
        offsets, "_range"
    )
    return joined.select(
        *[local[g] for g in groups],
        local[value],
        *[c for k in weights for c in (
            F.col(k),
            (F.col(f"{k}_local") + F.col(f"{k}_off")).alias(f"{k}_before"),
            F.col(f"{k}_total"),
        )],
    )


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: dict[str, float],
    groups: list[str] | None = None,
) -> DataFrame:
    """Quantiles by linear interpolation, exact, one row per group.

    Equals the usual continuous percentile; the value column becomes double.
    """
    groups = groups or []
    clean = df.select(*groups, F.col(value).cast("double").alias("_v")).where(
        F.col("_v").isNotNull() & ~F.isnan("_v")
    )
    totals = running_totals(clean, "_v", groups)
    picks = []
    for name, p in probs.items():
        position = (F.col("n_total") - 1) * F.lit(float(p))
        low, high = F.floor(position), F.ceil(position)
        for part, k in (("lo", low), ("hi", high)):
            holds = (F.col("n_before") <= k) & (k < F.col("n_before") + F.col("n"))
            picks.append(F.max(F.when(holds, F.col("_v"))).alias(f"{name}_{part}"))
        picks.append(F.max(position - low).alias(f"{name}_f"))
    found = totals.groupBy(*groups).agg(*picks, F.max("n_total").alias("n"))
    return found.select(
        *groups,
        "n",
        *[
            (F.col(f"{q}_lo") + (F.col(f"{q}_hi") - F.col(f"{q}_lo")) * F.col(f"{q}_f")).alias(q)
            for q in probs
        ],
    )


def fractional_rank(df: DataFrame, value: str, out: str = "rank_score") -> DataFrame:
    """(smallest rank - 1) / (n - 1) of every row, 0 for a single row."""
    totals = running_totals(df.where(F.col(value).isNotNull()), value)
    ranks = totals.select(
        F.col(value).alias("_value"),
        F.when(F.col("n_total") > 1, F.col("n_before") / (F.col("n_total") - 1))
        .otherwise(F.lit(0.0))
        .alias(out),
    )
    return df.join(ranks, df[value] == ranks["_value"], "left").drop("_value")


def split_by_position(
    df: DataFrame, order: str, tie: str, fractions: tuple[float, ...] = (0.70, 0.85)
) -> DataFrame:
    """Chronological split by row position; adds ``split`` = 0, 1, 2, ...

    Row counts are those of slicing the sorted rows at int(n * fraction).  Only where a cut
    falls between rows of the same order value are those rows ranked by ``tie`` as well.
    """
    totals = running_totals(df, order)
    before, size = F.col("n_before"), F.col("n")
    split = F.lit(0)
    for fraction in fractions:
        target = F.floor(F.col("n_total") * F.lit(fraction) + F.lit(1e-9))
        edge = (
            totals.where((before < target) & (target <= before + size))
            .select(F.col(order).alias("value"), (target - before).alias("take"), "n")
            .first()  # the one value at which the cut falls
        )
        if edge is None:  # the cut falls before the first row
            split = split + 1
            continue
        at = F.lit(edge["value"])
        after = F.col(order) > at
        if edge["take"] < edge["n"]:
            ties = running_totals(df.where(F.col(order) == at), tie)
            take = F.lit(edge["take"])
            last = ties.where((before < take) & (take <= before + size)).select(tie).first()[0]
            after = after | ((F.col(order) == at) & (F.col(tie) > F.lit(last)))
        split = split + after.cast("int")
    return df.withColumn("split", split)
