"""Keep-one-per-key operators that do not gather the copies of a key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from motorlake.session import settle


def _hash(keys: list[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys])


def _twice(df: DataFrame, keys: list[str]) -> DataFrame | None:
    """_tk_h: the key hashes that more than one row has, stored; None where there are none."""
    twice = settle(df.groupBy(_hash(keys).alias("_tk_h")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_tk_h"), "twice", codec="zstd")
    return None if twice.isEmpty() else twice


def rows_with_copies(df: DataFrame, keys: list[str]) -> DataFrame | None:
    """The rows whose key may be there more than once; none at all gives None.

    Only a hash of the key is shuffled and counted.  Rows of unlike keys with one hash come along, so what
    reads this still compares the keys.
    """
    twice = _twice(df, keys)
    return None if twice is None else df.join(twice, _hash(keys) == twice["_tk_h"], "left_semi")


def tag_kept(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    uid: list[str],
    keep: str = "latest",
    flag: str = "_kept",
) -> DataFrame:
    """Mark exactly one row per key: the largest (or smallest) by ``order``, then ``uid``.

    Keys with copies are found by their hashes, and only their rows are compared: a set without copies
    is shuffled as one number a row.  The winner of each key is an aggregate, so partial aggregation
    absorbs a key that holds a large share of the rows.  The winners are stored before they are joined
    back, so the planner broadcasts them where their measured size allows and the rows are not shuffled;
    a hot key is split by the adaptive skew join otherwise.  Null keys form one group.
    """
    pick = F.max if keep == "latest" else F.min
    several = rows_with_copies(df, keys)
    if several is None:
        return df.withColumn(flag, F.lit(True))
    winners = (
        several.groupBy(*[F.col(k).alias(f"_tk_{i}") for i, k in enumerate(keys)])
        .agg(
            F.count(F.lit(1)).alias("_tk_copies"),
            pick(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], *uid)).alias("_tk_w"),
        )
        .where("_tk_copies > 1")
    )
    copied = settle(winners, "winners", codec="zstd")
    on = None
    for i, k in enumerate(keys):
        same = df[k].eqNullSafe(copied[f"_tk_{i}"])
        on = same if on is None else on & same
    wins = F.col("_tk_copies").isNull()
    mine = None
    for u in uid:
        same = F.col(u).eqNullSafe(F.col(f"_tk_w.{u}"))
        mine = same if mine is None else mine & same
    return (
        df.join(copied, on, "left")
        .withColumn(flag, wins | mine)
        .drop("_tk_copies", "_tk_w", *[f"_tk_{i}" for i in range(len(keys))])
    )


def latest_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Only the winning row of every key.

    Rows whose key hash is there once pass as they are; the others are compared, and copies are absorbed
    by partial aggregation.
    """
    twice = _twice(df, keys)
    if twice is None:
        return df
    rest = [c for c in df.columns if c not in keys]
    lead = order + [c for c in rest if c not in order]
    same = _hash(keys) == twice["_tk_h"]
    best = df.join(twice, same, "left_semi").groupBy(*keys).agg(F.max(F.struct(*lead)).alias("_best"))
    return df.join(twice, same, "left_anti").unionByName(best.select(*keys, "_best.*").select(*df.columns))
