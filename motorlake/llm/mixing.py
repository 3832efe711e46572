"""Mixing sources to target weights by systematic sampling.

Targets are filled like water: every source gets words by its weight until it has ``most`` times
its own size, and what is above is shared again by weight among the others.  Within a source the
expected copies of its documents are summed up along an order, one random offset is added, and a
document is emitted once for each whole number that its stretch crosses.  The order is by size
first: neighbours then have like sizes, so the words taken miss the target by at most twice the
largest document (summation by parts of errors below one copy).

Positions in the order come from counts of (source, size, slot of a hash), so that no source, not
even one with a third of all rows, is sorted in one task.

Defined results: a null text has size 0.  A null source is a source of its own, last in order.
Documents of size 0 get copies like others but no words.  Rows with one id and one text may swap
their copies; the multiset of results is the same in each run.  An empty table gives no rows.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window, functions as F

from motorlake.llm.rows import bit_of, column, free_name, located, marked, same_word, text_of
from motorlake.session import settle

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SEED = 20


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def offset_of(seed: int) -> float:
    """The random offset, a dyadic fraction strictly between 0 and 1, so that sums with it are exact."""
    return random.Random(seed).randrange(2**16) / 2**16 + 2**-17


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """Targets of (source_key, source_size); source_key sorts null last.  One row per source, so the windows are small.

    In order of source_size / weight the sources that reach their limit come first; the rest share
    what these leave.
    """
    wide = "decimal(38,0)"
    order = Window.orderBy("source_key")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = sizes.select("*", w.alias("w"))
    before = Window.orderBy(F.col("source_size") / F.col("w"), "source_key").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = weighed.select(
        "*",
        (F.sum("source_size").over(everything).cast(wide) - F.lit(most) * F.coalesce(F.sum("source_size").over(before), F.lit(0)).cast(wide)).alias("words_left"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("w_left"),
    )
    capped = left.select("*", (F.lit(most) * F.col("source_size").cast(wide) * F.col("w_left") < F.col("words_left") * F.col("w")).alias("capped"))
    rest = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.min(F.when(~F.col("capped"), F.struct((F.col("source_size") / F.col("w")).alias("r"), "source_key", "words_left", "w_left"))).over(rest)
    return capped.select(
        "source_key", "source_size", "w", "capped", first.alias("first")
    ).select(
        "source_key", "source_size",
        F.when(F.col("capped"), (F.lit(most) * F.col("source_size")).cast("double")).otherwise(
            F.col("first.words_left").cast("double") * F.col("w").cast("double") / F.col("first.w_left").cast("double")
        ).alias("target"),
    )


def source_key(source: Column) -> Column:
    """Sorts by code point with null last, and is never null."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    most: int = 3,
    seed: int = SEED,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken and its place (file, row)."""
    docs, place = located(docs)
    text = text_of(docs, text_column)
    sized = settle(
        docs.select(
            column(docs, id_column).alias("doc_id"),
            source_key(column(docs, source_column).cast("string")).alias("source_key"),
            word_count(text).alias("size"),
            F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(column(docs, id_column).cast("string"), F.lit("")))).alias("turn"),
            F.md5(text).alias("text_md5"),
            place["file"].alias("file"), place["row"].alias("row"),
        ).withColumn("slot", F.substring("turn", 1, 3)),
        "sized",
    )
    slots = sized.groupBy("source_key", "size", "slot").agg(F.count(F.lit(1)).alias("n"))
    in_size = Window.partitionBy("source_key", "size").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select("*", F.coalesce(F.sum("n").over(in_size), F.lit(0)).alias("before_slot"))
    steps = sized.groupBy("source_key", "size").agg(F.count(F.lit(1)).alias("n_size"))
    in_source = Window.partitionBy("source_key").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.select("*", F.coalesce(F.sum("n_size").over(in_source), F.lit(0)).alias("before_size"))
    targets = source_targets(sized.groupBy("source_key").agg(F.sum("size").alias("source_size")), weights, most)
    bases = settle(
        slots.join(steps, ["source_key", "size"]).join(targets, "source_key").select(
            "source_key", "size", "slot", (F.col("before_size") + F.col("before_slot")).alias("before"), "source_size", "target"
        ),
        "bases",
    )
    in_slot = Window.partitionBy("source_key", "size", "slot").orderBy("turn", "text_md5", "file", "row")
    placed = sized.withColumn("nth", F.row_number().over(in_slot)).join(bases, ["source_key", "size", "slot"])
    rank = (F.col("before") + F.col("nth")).cast("double")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    u = F.lit(offset_of(seed))
    copies = (F.floor(rank * share + u) - F.floor((rank - F.lit(1.0)) * share + u)).cast("long")
    return placed.select(
        "doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "file", "row"
    )


def emit_mix(docs: DataFrame, most: int = 3, **options) -> DataFrame:
    """The mixed rows: each row of ``docs`` once per copy, columns unchanged."""
    docs, place = located(docs)
    digits = range((most + 1).bit_length())  # of the copies in binary
    taken = marked(mix(docs, most=most, **options).where("copies > 0"), {f"_copies{d}": F.col("copies").bitwiseAND(1 << d) != 0 for d in digits})
    at = free_name(docs, "_at")
    rows = docs.select("*", place.alias(at))
    copies = F.lit(0).cast("long")
    for d in digits:
        copies = copies + F.when(taken[f"_copies{d}"].bitwiseAND(bit_of(rows[at]["row"])) != 0, F.lit(1 << d)).otherwise(F.lit(0))
    names = [rows[f"`{c}`"] for c in docs.columns]
    each = F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias(free_name(docs, "_copy"))
    return rows.join(taken, same_word(rows[at], taken)).where(copies > 0).select(*names, each).select(*[F.col(f"`{c}`") for c in docs.columns])
