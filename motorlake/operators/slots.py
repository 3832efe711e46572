"""Time-ordered operators per key that split every key into time slots.

A window over a whole key would put all rows of a busy key into one task.  These operators
order rows only inside (key, slot), describe every slot by a few values, and carry those
across slots: the second step sees one row per slot, never one per reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from motorlake.functions.text import micros_between

_EPOCH = "1970-01-01"


def epoch_slot(ts: Column, seconds: int) -> Column:
    """Number of the time slot a timestamp falls in."""
    start = F.lit(_EPOCH).cast("timestamp_ntz")
    return F.floor(F.timestamp_diff("SECOND", start, ts.cast("timestamp_ntz")) / F.lit(seconds)).cast("long")


def streak_alerts(
    df: DataFrame,
    key: str,
    ts: str,
    tie: str,
    hit: str,
    length: int,
    slot_seconds: int = 3600,
) -> DataFrame:
    """Rows on which a run of consecutive hits reaches a multiple of ``length``.

    Adds ``streak`` (the position in the run).  A row without a hit ends the run; the
    counter restarts after every alert, which is what the multiple expresses.
    """
    slotted = df.withColumn("_slot", epoch_slot(F.col(ts), slot_seconds))
    inside = Window.partitionBy(key, "_slot").orderBy(ts, tie)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    miss = (~F.col(hit)).cast("int")
    ordered = slotted.withColumn("_misses", F.sum(miss).over(so_far)).withColumn(
        "_hits", F.sum(F.col(hit).cast("int")).over(so_far)
    )
    # hits since the last miss inside the slot
    ordered = ordered.withColumn(
        "_miss_hits",
        F.max(F.when(~F.col(hit), F.col("_hits"))).over(so_far),
    ).withColumn("_run", F.col("_hits") - F.coalesce(F.col("_miss_hits"), F.lit(0)))
    slots = ordered.groupBy(key, "_slot").agg(
        F.max("_misses").alias("_slot_misses"),
        F.max("_hits").alias("_slot_hits"),
        F.max(F.coalesce(F.col("_miss_hits"), F.lit(0))).alias("_last_miss_hits"),
    )
    by_slot = Window.partitionBy(key).orderBy("_slot")
    broken = (F.col("_slot_misses") > 0).cast("int")
    tail = F.col("_slot_hits") - F.col("_last_miss_hits")
    # runs of slots that start at a slot holding a miss; its tail opens the run
    chained = slots.withColumn("_chain", F.sum(broken).over(by_slot)).withColumn("_tail", tail)
    in_chain = (
        Window.partitionBy(key, "_chain").orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)
    )
    carried = chained.withColumn("_open", F.sum("_tail").over(in_chain)).withColumn(
        "_carry", F.coalesce(F.lag("_open").over(by_slot), F.lit(0))
    )
    carry = carried.where(F.col("_carry") > 0).select(
        F.col(key).alias("_k"), F.col("_slot").alias("_s"), "_carry"
    )
    return (
        ordered.join(carry, (ordered[key] == carry["_k"]) & (ordered["_slot"] == carry["_s"]), "left")
        .withColumn(
            "streak",
            F.col("_run")
            + F.when(F.col("_misses") == 0, F.coalesce(F.col("_carry"), F.lit(0))).otherwise(F.lit(0)),
        )
        .where(F.col(hit) & (F.col("streak") % length == 0))
        .drop("_slot", "_misses", "_hits", "_miss_hits", "_run", "_k", "_s", "_carry")
    )


def non_increasing(
    df: DataFrame, key: str, ts: str, position: str, block: Column | int = 100_000
) -> DataFrame:
    """Rows whose timestamp is not later than the previous row of the key in file order.

    ``position`` orders the rows of the input, which is cut into blocks so that one key never has
    to be ordered in a single task.  ``block`` is the number of positions in a block, or, where a
    position is not one number, a column that grows with it.
    """
    cut = df.withColumn("_block", F.floor(F.col(position) / F.lit(block)).cast("long") if isinstance(block, int) else block)
    inside = Window.partitionBy(key, "_block").orderBy(position)
    ordered = cut.withColumn("_prev", F.lag(ts).over(inside))
    ends = cut.groupBy(key, "_block").agg(F.max_by(ts, position).alias("_last"))
    carried = ends.select(
        F.col(key).alias("_k"),
        F.col("_block").alias("_b"),
        F.lag("_last").over(Window.partitionBy(key).orderBy("_block")).alias("_carry"),
    )
    joined = ordered.join(carried, (ordered[key] == carried["_k"]) & (ordered["_block"] == carried["_b"]))
    return (
        joined.withColumn("previous", F.coalesce("_prev", "_carry"))
        .where(F.col(ts) <= F.col("previous"))
        .drop("_block", "_prev", "_k", "_b", "_carry")
    )


def active_time(
    df: DataFrame,
    keys: list[str],
    ts: str,
    tie: str,
    running: Column,
    gap_seconds: int,
    measures: dict[str, tuple[Column, str]],
    slot_seconds: int = 900,
) -> DataFrame:
    """Per key: microseconds of activity plus mergeable measures.

    The time since the previous reading counts when it is above zero, at most
    ``gap_seconds`` and the engine runs.  ``measures`` maps a name to (expression, how)
    with how one of sum, max, min; each is taken per slot and merged.
    """
    slotted = df.withColumn("_slot", epoch_slot(F.col(ts), slot_seconds)).withColumn("_on", running)
    inside = Window.partitionBy(*keys, "_slot").orderBy(ts, tie)
    delta = micros_between(F.lag(ts).over(inside), F.col(ts))
    limit = gap_seconds * 1_000_000

    def counted(d: Column, on: Column) -> Column:
        return F.when((d > 0) & (d <= limit) & on, d).otherwise(F.lit(0))

    stepped = slotted.withColumn("_delta", delta)
    how = {"sum": F.sum, "max": F.max, "min": F.min}
    per_slot = stepped.groupBy(*keys, "_slot").agg(
        F.sum(counted(F.col("_delta"), F.col("_on"))).alias("_inside"),
        F.min(ts).alias("_first"),
        F.max(ts).alias("_last"),
        F.min(F.struct(ts, tie, "_on")).getField("_on").alias("_first_on"),
        *[how[h](c).alias(name) for name, (c, h) in measures.items()],
    )
    across = Window.partitionBy(*keys).orderBy("_slot")
    bridge = micros_between(F.lag("_last").over(across), F.col("_first"))
    bridged = per_slot.withColumn("_bridge", bridge)
    return bridged.groupBy(*keys).agg(
        F.sum(F.col("_inside") + counted(F.col("_bridge"), F.col("_first_on"))).alias("active_micros"),
        *[how[h](name).alias(name) for name, (_, h) in measures.items()],
    )


def stitched_sessions(df: DataFrame, key: str, ts: str, gap_seconds: int, slot_seconds: int = 900) -> DataFrame:
    """Sessions of a key, cut where ``gap_seconds`` or more pass without a row: key, first, last, rows.

    Two levels.  Rows are cut into sessions inside (key, slot); there only the first and the last session can
    go on into a neighbouring slot, all others are done.  These end pieces, at most two a slot, are then
    merged along the key.  Rows without a time belong to no session.
    """
    limit = gap_seconds * 1_000_000
    slotted = df.where(F.col(ts).isNotNull()).select(F.col(key), F.col(ts).alias("_ts"), epoch_slot(F.col(ts), slot_seconds).alias("_slot"))
    inside = Window.partitionBy(key, "_slot").orderBy("_ts")
    opens = F.coalesce(micros_between(F.lag("_ts").over(inside), F.col("_ts")) >= limit, F.lit(True))
    numbered = slotted.withColumn("_opens", opens.cast("int")).withColumn(
        "_n", F.sum("_opens").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    )
    pieces = numbered.groupBy(key, "_slot", "_n").agg(F.min("_ts").alias("first"), F.max("_ts").alias("last"), F.count("*").alias("rows"))
    of_slot = Window.partitionBy(key, "_slot")
    ranked = pieces.withColumn("_most", F.max("_n").over(of_slot))
    done = ranked.where((F.col("_n") > 1) & (F.col("_n") < F.col("_most")))
    along = Window.partitionBy(key).orderBy("first")
    ends = ranked.where((F.col("_n") == 1) | (F.col("_n") == F.col("_most")))
    starts = (F.col("_n") > 1) | F.coalesce(micros_between(F.lag("last").over(along), F.col("first")) >= limit, F.lit(True))
    chained = ends.withColumn("_starts", starts.cast("int")).withColumn(
        "_session", F.sum("_starts").over(along.rowsBetween(Window.unboundedPreceding, 0))
    )
    merged = chained.groupBy(key, "_session").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("rows").alias("rows"))
    columns = [key, "first", "last", "rows"]
    return merged.select(*columns).unionByName(done.select(*columns))
