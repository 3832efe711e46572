"""Rows lying in a window around events of the same key, without row-level fan-out."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from motorlake.operators.slots import epoch_slot


def flag_near_events(
    rows: DataFrame,
    events: DataFrame,
    key: str,
    row_ts: str,
    event_ts: str,
    before_seconds: int,
    after_seconds: int,
    out: str,
    slot_seconds: int = 3600,
) -> DataFrame:
    """True when some event e of the key has e - before <= row time <= e + after.

    Events shrink to their first and last time per (key, slot).  A slot lying wholly inside
    the reach of a row's slot settles the row at once; only the slots at either edge need a
    comparison, against one time each.  So the join adds at most one row per (key, slot),
    and a busy key is spread over its slots.
    """
    if before_seconds + after_seconds < 2 * slot_seconds:
        raise ValueError("slot_seconds must be at most half of the whole window")
    s = slot_seconds
    low_k = math.floor(-after_seconds / s)
    high_k = math.ceil(before_seconds / s)

    def kind(k: int) -> str | None:
        lo, hi = (k - 1) * s, (k + 1) * s  # open range of event time minus row time
        if hi <= -after_seconds or lo >= before_seconds:
            return None
        if lo >= -after_seconds and hi <= before_seconds:
            return "inside"
        return "late" if hi > before_seconds else "early"

    reach = [(k, kind(k)) for k in range(low_k - 1, high_k + 2) if kind(k)]
    per_slot = events.groupBy(key, epoch_slot(F.col(event_ts), s).alias("_eslot")).agg(
        F.min(event_ts).alias("_min"), F.max(event_ts).alias("_max")
    )
    offsets = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in reach])
    spread = per_slot.withColumn("_o", F.explode(offsets)).select(
        F.col(key).alias("_k"), (F.col("_eslot") - F.col("_o.k")).alias("_s"), "_min", "_max", "_o.w"
    )
    known = spread.groupBy("_k", "_s").agg(
        F.max((F.col("w") == "inside")).alias("_inside"),
        F.max(F.when(F.col("w") == "early", F.col("_max"))).alias("_early"),
        F.min(F.when(F.col("w") == "late", F.col("_min"))).alias("_late"),
    )
    timed = rows.withColumn("_rslot", epoch_slot(F.col(row_ts), s))
    gap_early = F.timestamp_diff("MICROSECOND", F.col("_early"), F.col(row_ts))
    gap_late = F.timestamp_diff("MICROSECOND", F.col(row_ts), F.col("_late"))
    hit = (
        F.coalesce(F.col("_inside"), F.lit(False))
        | F.coalesce(gap_early <= after_seconds * 1_000_000, F.lit(False))
        | F.coalesce(gap_late <= before_seconds * 1_000_000, F.lit(False))
    )
    return (
        timed.join(known, (timed[key] == known["_k"]) & (timed["_rslot"] == known["_s"]), "left")
        .withColumn(out, hit)
        .drop("_k", "_s", "_inside", "_early", "_late", "_rslot")
    )
