"""Benchmark decontamination: size-partitioned MinHash containment search, then exact containment.

A test item is short and a document may be long, so their similarity is tiny even where the whole
item stands in the document; what counts is containment, the part of the item's word shingles that
the document has.  Items are partitioned by size (powers of two of their shingle counts).  Of each
item the k smallest shingles under a random order (a bottom-k MinHash) are kept, with k set by the
partition's upper size: a document with at least the threshold of an item's shingles misses at most
size - ceil(threshold * size) of them, so it has at least one of k > size - ceil(threshold * size)
minima, and the search loses nothing.  Candidates too small to hold the needed shingles go, and the
rest are verified on the shingles themselves, not on hashes.

The test items are the stated queries of this search and go against all documents in blocks of
about ``BLOCK_ROWS`` minima: a block is a few megabytes and is broadcast, so neither texts nor
shingles are shuffled.  A document that has a minimum is written once, with its text and candidate
items, and only those are verified.

Words are runs of letters, marks and digits in lower case.  Defined results: an item of fewer than
five words is one shingle of all its words; an item without words, or a null one, is found nowhere.
A null or empty document holds nothing.  Repeated documents and repeated items each give their own
rows; null ids are returned as null.  Empty tables give no rows.  Extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from motorlake.llm.rows import column, located, text_of, without
from motorlake.session import settle

WORDS = 5
THRESHOLD = 0.8
BLOCK_ROWS = 100_000
NO_WORD = r"[^\p{L}\p{M}\p{N}]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), NO_WORD), "")


def _starts(words: str, length: int) -> Column:
    last = F.size(words) - length + 1
    return F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))


def shingle_hashes(words: str, length: int) -> Column:
    """64-bit hashes of all shingles of ``length`` words."""
    return F.transform(_starts(words, length), lambda i: F.xxhash64(*[F.element_at(F.col(words), i + k) for k in range(length)]))


def shingle_texts(words: str, length: int) -> Column:
    """The distinct shingles of ``length`` words themselves."""
    return F.array_distinct(F.transform(_starts(words, length), lambda i: F.array_join(F.slice(F.col(words), i, F.lit(length)), " ")))


def _by_length(make, lengths: list[int]) -> Column:
    """(length, shingle) structs for the few lengths in use."""

    def tagged(length: int) -> Column:
        return F.transform(make("words", length), lambda s: F.struct(F.lit(length).alias("length"), s.alias("shingle")))

    return F.flatten(F.array(*[tagged(n) for n in lengths]))


def item_shingles(items: DataFrame, id_column: str, text_column: str, words: int) -> DataFrame:
    """item (the row's place), item_id, length, shingle, n_shingles, needed: a row for each distinct shingle."""
    items, place = located(items)
    rows = items.select(
        F.concat_ws("#", place["file"], place["row"].cast("string")).alias("item"),
        column(items, id_column).alias("item_id"),
        words_of(text_of(items, text_column)).alias("words"),
    ).where(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(words))
    shingles = F.coalesce(*[F.when(length == n, shingle_texts("words", n)) for n in range(1, words + 1)])
    return rows.select("item", "item_id", length.alias("length"), shingles.alias("all")).select(
        "item", "item_id", "length", F.size("all").alias("n_shingles"), F.explode("all").alias("shingle")
    )


def sketches(shingles: DataFrame, threshold: float, seed: int) -> DataFrame:
    """item, length, needed, hash: the k minima of each item, k by its size partition."""
    hashed = shingles.select(
        "item", "length", "n_shingles",
        F.ceil(F.lit(threshold) * F.col("n_shingles") - F.lit(1e-9)).cast("int").alias("needed"),
        F.split("shingle", " ").alias("words"),
    )
    # The hash a document gives the same shingle: of its words one by one.
    value = F.coalesce(*[F.when(F.col("length") == n, F.xxhash64(*[F.element_at("words", k + 1) for k in range(n)])) for n in range(1, WORDS + 1)])
    upper = F.pow(F.lit(2.0), F.floor(F.log2(F.col("n_shingles").cast("double"))) + 1) - 1
    k = (upper - F.ceil(F.lit(threshold) * upper - F.lit(1e-9)) + 1).cast("int")
    return (
        hashed.select("item", "length", "needed", k.alias("k"), value.alias("hash"))
        .groupBy("item", "length", "needed", "k")
        .agg(F.array_sort(F.collect_list(F.struct(F.xxhash64("hash", F.lit(seed)).alias("turn"), "hash"))).alias("ordered"))
        .select("item", "length", "needed", F.explode(F.slice("ordered", F.lit(1), F.col("k"))).alias("m"))
        .select("item", "length", "needed", F.col("m.hash").alias("hash"))
    )


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = THRESHOLD,
    seed: int = 7,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """One row per document and item it holds: doc_id, item_id, shared, n_shingles, containment, file, row."""
    docs, place = located(docs)
    shingles = settle(item_shingles(items, item_column, item_text_column, WORDS), "items")
    lengths = sorted(r["length"] for r in shingles.select("length").distinct().collect()) or [WORDS]  # five values at most
    minima = settle(sketches(shingles, threshold, seed), "sketches")

    words = docs.select(
        place["file"].alias("file"), place["row"].alias("row"), column(docs, id_column).alias("doc_id"),
        text_of(docs, text_column).alias("text"),
    ).withColumn("words", words_of(F.col("text")))
    hashed = words.select("file", "row", "doc_id", "text", F.size("words").alias("n_words"), _by_length(shingle_hashes, lengths).alias("all"))
    # explode_outer: for explode the planner would test the array's size in a filter below, by
    # computing all of it once more.  The rows of empty arrays find no match in the join.
    single = hashed.select("file", "row", "doc_id", "text", "n_words", F.explode_outer("all").alias("s")).select(
        "file", "row", "doc_id", "text", "n_words", F.col("s.length").alias("length"), F.col("s.shingle").alias("hash")
    )
    blocks = max(1, -(-minima.count() // BLOCK_ROWS))
    parts = []
    for block in range(blocks):
        queries = minima.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        hits = single.join(F.broadcast(queries), ["length", "hash"]).where(F.col("n_words") - F.col("length") + 1 >= F.col("needed"))
        # All hits of a document are in one task, so its text leaves that task once.
        parts.append(settle(hits.groupBy("file", "row", "doc_id", "text").agg(F.collect_set("item").alias("items")), "candidates"))
    candidates = reduce(DataFrame.unionByName, parts)
    pairs = candidates.select("file", "row", F.explode("items").alias("item"))
    suspects = candidates.select("file", "row", "doc_id", words_of(F.col("text")).alias("words"))
    if blocks > 1:
        suspects = suspects.dropDuplicates(["file", "row"])
    held = suspects.select("file", "row", "doc_id", F.explode(_by_length(shingle_texts, lengths)).alias("s")).select(
        "file", "row", "doc_id", F.col("s.length").alias("length"), F.col("s.shingle").alias("shingle")
    )
    # A phrase that many items share meets a document once here, and then only the document's candidates.
    known = held.join(shingles.select("length", "shingle").distinct(), ["length", "shingle"], "left_semi")
    wanted = pairs.join(shingles, "item")
    shared = (
        known.join(wanted, ["file", "row", "length", "shingle"])
        .groupBy("file", "row", "doc_id", "item", "item_id", "n_shingles")
        .agg(F.count(F.lit(1)).alias("shared"))
        .where(F.col("shared") >= F.lit(threshold) * F.col("n_shingles") - F.lit(1e-9))
    )
    return shared.select(
        "doc_id", "item_id", "shared", F.col("n_shingles").cast("long").alias("n_shingles"),
        (F.col("shared").cast("double") / F.col("n_shingles").cast("double")).alias("containment"), "file", "row",
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold a test item, columns unchanged."""
    docs, place = located(docs)
    return without(docs, place, contaminated(docs, items, **options))
