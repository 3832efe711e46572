"""Surrogate keys without a global sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def assign_keys(
    df: DataFrame,
    natural: str,
    out: str,
    existing: DataFrame | None = None,
    hex_digits: int = 3,
    order: str = "hash",
) -> DataFrame:
    """Dense keys 1..n (after the largest existing key) for distinct natural keys.

    Keys follow the md5 of the natural key, so the buckets (its first hex digits) are even
    whatever the natural keys look like; each bucket is numbered on its own and shifted by
    the size of the earlier buckets.  ``order="natural"`` numbers by the natural key itself
    and buckets by its first letters; use it for short catalogues only.
    """
    if order == "hash":
        position = F.md5(F.col(natural))
        bucket = F.substring(position, 1, hex_digits)
    else:
        position = F.col(natural)
        bucket = F.substring(position, 1, 2)
    marked = df.withColumn("_pos", position).withColumn("_bucket", bucket)
    inside = Window.partitionBy("_bucket").orderBy("_pos", natural)
    sizes = marked.groupBy("_bucket").agg(F.count("*").alias("_size"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_bucket", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_shift"))
    start = (
        existing.agg(F.greatest(F.coalesce(F.max(out), F.lit(0)), F.lit(0)).alias("m")).scalar()
        if existing is not None
        else F.lit(0)
    )
    return (
        marked.withColumn("_rn", F.row_number().over(inside))
        .join(shifts, "_bucket")
        .withColumn(out, (F.col("_rn") + F.col("_shift") + start).cast("long"))
        .drop("_pos", "_bucket", "_rn", "_shift")
    )


def extend_keys(df: DataFrame, natural: str, out: str, existing: DataFrame, **options) -> DataFrame:
    """Natural keys that ``existing`` has keep their number; only new ones are numbered, after the largest.

    The known members are never broadcast: their compressed files are far smaller than their rows in memory.
    """
    known = existing.where(F.col(out) > 0).select(F.col(natural).alias("_n"), F.col(out)).hint("merge")
    held = df.join(known, df[natural] == known["_n"], "left").drop("_n")
    fresh = assign_keys(held.where(F.col(out).isNull()).drop(out), natural, out, existing, **options)
    return held.where(F.col(out).isNotNull()).unionByName(fresh)
