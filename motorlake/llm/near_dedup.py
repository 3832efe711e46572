"""Near-duplicates by b-bit MinHash.

Each text's set of word shingles gets 128 minima.  Groups of four make 32 band keys (two sets of
similarity .8 miss all bands with probability 5e-8); of every minimum only the low ``BITS`` bits are
kept, packed into eight longs.  Candidates from bands are first judged by bit counts on the packed
signatures, corrected for the chance that unlike minima share their low bits, and then confirmed on
the full sets.

No bucket is expanded into pairs.  Equal sets are collapsed to one representative first.  In each
bucket every member meets the least member only, and its best such pair is confirmed; further rounds
do the same with other heads.  Members that end in one component need no more comparisons.  Members
of one bucket in *different* components are then compared, so no link between components is lost: those
outside the bucket's largest component with all others, each pair once, by its first common band and block by
block, so that a bucket is spread over many tasks.  Members travel with a parity sketch of their whole set: the bits
in which two sketches differ are no more than the shingles that only one of the sets has, so a pair with too many
of them is no link, and the many pairs of a group that lie below the threshold are never rows.  Of the pairs
that are left, the likeliest of each two components is confirmed on the full sets first, and then all that are still apart.

Defined results: texts without words have an empty set, link with nothing and are kept.  A text of
fewer words than a shingle is one shingle.  Null texts count as empty.  Repeated rows are copies:
of equal ids the row that comes first in the files is kept; null ids rank last.  An empty table
gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from motorlake.llm import bytewords
from motorlake.llm.components import components
from motorlake.llm.rows import column, located, text_of, without
from motorlake.session import settle

MINIMA, ROWS, BITS = 128, 4, 4
BANDS = MINIMA // ROWS
LONGS = MINIMA * BITS // 64
#: Bits of a parity sketch.
PARITY = 1024
#: Six standard errors of the estimate below the threshold still count as candidates.
MARGIN = 0.22
#: Members outside a bucket's largest component that one block compares with all others.
BLOCK = 128
#: Rounds with other heads before what is apart is compared in full.
ROUNDS = 3
_RNG = np.random.default_rng(88)
_A = _RNG.integers(0, 2**32, MINIMA, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 2**32, MINIMA, dtype=np.uint32)
_BAND = _RNG.integers(0, 2**64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_SHIFT = np.arange(0, 64, BITS, dtype=np.uint64)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The 128 minima of a set of 64-bit hashes."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(MINIMA, np.uint32(0xFFFFFFFF), np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(low, (_A[:, None] * x[None, at : at + 2048] + _B[:, None]).min(axis=1), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    parts = bytewords.mix(low.reshape(BANDS, ROWS).astype(np.uint64) + _BAND) * _BAND
    return bytewords.mix(parts.sum(axis=1, dtype=np.uint64)).view(np.int64)


def packed(low: np.ndarray) -> np.ndarray:
    """The low bits of the minima (of a mixed form, so that they do not follow the hash's own), in longs."""
    bits = bytewords.mix(low.astype(np.uint64)) & np.uint64(2**BITS - 1)
    return np.bitwise_or.reduce(bits.reshape(LONGS, 64 // BITS) << _SHIFT, axis=1).view(np.int64)


def parity(hashes: np.ndarray) -> np.ndarray:
    """A bit for each class of hashes, set where the set has an odd number of them, in longs."""
    odd = np.bincount((bytewords.mix(hashes) >> np.uint64(32)).astype(np.int64) % PARITY, minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def may_link(a: Column, b: Column, total: Column, percent: int) -> Column:
    """False only where two sets of ``total`` shingles are surely less alike: bits that differ are at most their difference."""
    # Not written out word by word: the join's code would become too long to be compiled.
    unlike = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return unlike * (100 + percent) <= total * (100 - percent)


def estimate(a: list[Column], b: list[Column]) -> Column:
    """Similarity from packed signatures: equal fields, corrected for fields equal by chance."""
    ones = F.lit(0x1111111111111111)
    unlike = None
    for x, y in zip(a, b, strict=True):
        d = x.bitwiseXOR(y)
        spread = d.bitwiseOR(F.shiftright(d, 1)).bitwiseOR(F.shiftright(d, 2)).bitwiseOR(F.shiftright(d, 3))
        n = F.bit_count(spread.bitwiseAND(ones))
        unlike = n if unlike is None else unlike + n
    chance = 2.0**-BITS
    return (F.lit(1.0) - unlike / F.lit(float(MINIMA)) - F.lit(chance)) / F.lit(1.0 - chance)


def signatures(docs: DataFrame, place: Column, id_column: str, text_column: str, words: int) -> DataFrame:
    """rid, doc_id, file, row, n_shingles, set_key, bands, s0..s7: one row per document."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bytewords.bounded(batches, 0):
            hashes, bounds = bytewords.word_hashes(*bytewords.text_buffers(batch.column(0)))
            n = np.zeros(len(batch), np.int64)
            keys = np.zeros((len(batch), 2), np.uint64)
            bands = np.zeros((len(batch), BANDS), np.int64)
            sig = np.zeros((len(batch), LONGS), np.int64)
            for k in range(len(batch)):
                s = bytewords.shingles(hashes[bounds[k] : bounds[k + 1]], words)
                if not len(s):
                    continue
                n[k] = len(s)
                keys[k] = s.sum(dtype=np.uint64), bytewords.mix(s + np.uint64(77)).sum(dtype=np.uint64)
                low = minima(s)
                bands[k], sig[k] = band_keys(low), packed(low)
            many = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(batch) + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel()))
            keys = keys.view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), batch.column(3), pa.array(n), pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()), many, *[pa.array(sig[:, j].copy()) for j in range(LONGS)]],
                names=["doc_id", "file", "row", "n_shingles", "key_a", "key_b", "bands", *[f"s{j}" for j in range(LONGS)]],
            )

    rows = docs.select(text_of(docs, text_column).alias("text"), column(docs, id_column).alias("doc_id"), place["file"].alias("file"), place["row"].alias("row"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    made = rows.mapInArrow(
        sign,
        f"doc_id {kind}, file string, row bigint, n_shingles bigint, key_a bigint, key_b bigint, bands array<bigint>, "
        + ", ".join(f"s{j} bigint" for j in range(LONGS)),
    )
    return made.withColumn("rid", F.monotonically_increasing_id())


def full_sets(docs: DataFrame, place: Column, wanted: DataFrame, text_column: str, words: int) -> DataFrame:
    """rid, the whole shingle set and its parity sketch of the documents in ``wanted`` (rid, file, row)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bytewords.bounded(batches, 1):
            hashes, bounds = bytewords.word_hashes(*bytewords.text_buffers(batch.column(1)))
            sets = [bytewords.shingles(hashes[bounds[k] : bounds[k + 1]], words) for k in range(len(batch))]
            lists = []
            for each in ([s.view(np.int64) for s in sets], [parity(s) for s in sets]):
                ends = np.cumsum([0, *map(len, each)]).astype(np.int32)
                flat = np.concatenate(each) if each else np.zeros(0, np.int64)
                lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["rid", "shingles", "parity"])

    text = docs.select(place["file"].alias("file"), place["row"].alias("row"), text_of(docs, text_column).alias("text"))
    # By shuffle at every size: the wanted rows grow with the documents.
    return text.join(wanted.hint("shuffle_hash"), ["file", "row"]).select("rid", "text").mapInArrow(cut, "rid bigint, shingles array<bigint>, parity array<bigint>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough."""
    left = sets.select(F.col("rid").alias("u"), F.col("shingles").alias("a"))
    right = sets.select(F.col("rid").alias("v"), F.col("shingles").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return (
        pairs.join(left, "u").join(right, "v")
        .where(F.lit(100) * both >= F.lit(percent) * (F.size("a") + F.size("b") - both))
        .select("u", "v")
    )


def merged_roots(links: DataFrame, rooted: DataFrame) -> DataFrame:
    """root, into: components of components after ``links`` (u, v) between members with roots (rid, root)."""
    a, b = rooted.select(F.col("rid").alias("u"), F.col("root").alias("ru")), rooted.select(F.col("rid").alias("v"), F.col("root").alias("rv"))
    edges = links.join(a, "u").join(b, "v").select(F.col("ru").alias("u"), F.col("rv").alias("v"))
    return settle(components(edges), "merged").select(F.col("node").alias("root"), F.col("root").alias("into"))


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept and its place (file, row)."""
    docs, place = located(docs)
    signed = settle(signatures(docs, place, id_column, text_column, words), "signed")
    # Copies of one set: the least rid stands for all.  Empty sets stand for themselves.
    key = [F.col("n_shingles"), F.col("key_a"), F.when(F.col("n_shingles") == 0, F.col("rid")).otherwise(F.col("key_b"))]
    keyed = signed.select("rid", "doc_id", "file", "row", *[c.alias(f"k{i}") for i, c in enumerate(key)])
    # Stored before it is joined back, so that a hot set is split by the adaptive join; most sets have no copies.
    first = settle(keyed.groupBy("k0", "k1", "k2").agg(F.min("rid").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "copied")
    base = keyed.join(first, ["k0", "k1", "k2"], "left").select("rid", F.coalesce("rep", "rid").alias("rep"), "doc_id", "file", "row", F.col("k0").alias("n_shingles"))
    base = settle(base, "base")

    sig = [f"s{j}" for j in range(LONGS)]
    reps = base.where("rid = rep AND n_shingles > 0").select("rid")
    own = settle(signed.join(reps, "rid", "left_semi").select("rid", "bands", *sig), "representatives")
    bucketed = own.select(F.explode("bands").alias("band"), "rid")
    heads = settle(
        bucketed.groupBy("band").agg(F.min("rid").alias("head"), F.count(F.lit(1)).alias("members")).where("members > 1"), "heads"
    )

    # Each member with the least member of each of its buckets; the best estimate is confirmed.
    least = percent / 100 - MARGIN
    head_sig = own.select(F.col("rid").alias("head"), *[F.col(s).alias(f"h_{s}") for s in sig])
    member_sig = own.select("rid", *sig)
    stars = bucketed.join(heads, "band").where("rid != head").select("rid", "head").distinct()
    scored = stars.join(member_sig, "rid").join(head_sig, "head").select(
        "rid", "head", estimate([F.col(s) for s in sig], [F.col(f"h_{s}") for s in sig]).alias("similarity")
    )
    best = settle(
        scored.where(F.col("similarity") >= least).groupBy("rid").agg(F.max(F.struct("similarity", (-F.col("head")).alias("n"))).alias("b"))
        .select(F.col("rid").alias("u"), (-F.col("b.n")).alias("v")),
        "stars",
    )
    def sets_of(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.explode(F.array("u", "v")).alias("rid")).distinct()
        wanted = settle(base.join(ends, "rid", "left_semi").select("rid", "file", "row"), "wanted")
        return settle(full_sets(docs, place, wanted, text_column, words), "sets")

    roots = settle(components(confirmed(best, sets_of(best), percent)), "roots").select(F.col("node").alias("rid"), "root")

    # Buckets whose members ended in different components, and what is needed to compare them.
    bucketed = bucketed.join(heads.select("band"), "band").join(roots, "rid", "left")
    placed = settle(bucketed.select("band", "rid", F.coalesce("root", "rid").alias("root0")), "placed")
    apart = settle(placed.groupBy("band").agg(F.min("root0").alias("lo"), F.max("root0").alias("hi")).where("lo != hi").select("band"), "apart")
    inside = settle(placed.join(apart, "band", "left_semi"), "inside")
    everyone = settle(inside.groupBy("rid").agg(F.first("root0").alias("root0")), "everyone")
    wanted = settle(base.join(everyone, "rid", "left_semi").select("rid", "file", "row"), "wanted")
    sets = settle(full_sets(docs, place, wanted, text_column, words), "sets")
    sized = settle(own.join(base.select("rid", "n_shingles"), "rid").join(sets.select("rid", "parity"), "rid"), "sized")
    moved = settle(everyone.select("root0").distinct().withColumn("root", F.col("root0")), "roots")

    def side(rows: DataFrame, name: str, more: list[str]) -> DataFrame:
        return rows.join(sized, "rid").select(
            *more, F.col("rid").alias(name), F.col("root").alias(f"r{name}"), F.col("n_shingles").alias(f"n{name}"),
            F.col("bands").alias(f"b{name}"), F.col("parity").alias(f"p{name}"), *[F.col(s).alias(f"{name}_{s}") for s in sig],
        )

    like = estimate([F.col(f"u_{s}") for s in sig], [F.col(f"v_{s}") for s in sig])
    fits = (F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * percent) & (like >= least) & may_link(F.col("pu"), F.col("pv"), F.col("nu") + F.col("nv"), percent)

    # More rounds with another member at the head of each bucket: every one is linear in the members,
    # and those that the first head did not reach join through later ones.
    for turn in range(ROUNDS):
        now = inside.join(moved, "root0")
        leads = settle(
            now.groupBy("band").agg(F.min_by(F.struct("rid", "root"), F.xxhash64("rid", F.lit(turn))).alias("h"), F.min("root").alias("lo"), F.max("root").alias("hi"))
            .where("lo != hi").select("band", F.col("h.rid").alias("head"), F.col("h.root").alias("head_root")), "leads",
        )
        pairs = now.join(leads, "band").where("root != head_root").select("rid", "root", "head", "head_root").distinct()
        u = side(pairs, "u", ["head", "head_root"])
        v = sized.select(F.col("rid").alias("head"), F.col("n_shingles").alias("nv"), F.col("parity").alias("pv"), *[F.col(s).alias(f"v_{s}") for s in sig])
        best = settle(
            u.join(v, "head").where(fits).groupBy("u").agg(F.max_by("head", like).alias("v")), "best"
        )
        merged = merged_roots(confirmed(best, sets, percent), everyone.join(moved, "root0").select("rid", "root"))
        moved = settle(moved.join(merged, "root", "left").select("root0", F.coalesce("into", "root").alias("root")), "roots")

    # What is still apart is compared in full.  Only members of different roots can bring a link, so in each
    # bucket those outside its largest root meet all others: a cluster that has merged costs its size times the
    # strays beside it.  Both travel with their signatures only; the outsiders are cut in blocks.  A pair is told by
    # the first of the bands that both are in.
    now = inside.join(moved, "root0")
    shares = settle(now.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n")), "shares")
    sizes = settle(
        shares.groupBy("band").agg(F.max_by("root", F.struct("n", "root")).alias("top"), (F.sum("n") - F.max("n")).alias("outside")).where("outside > 0"), "sizes"
    )
    rows = settle(now.join(sizes, "band").select("band", "top", "outside", "rid", "root"), "members")
    blocks = F.ceil(F.col("outside") / F.lit(BLOCK)).cast("int")
    outside = rows.where("root != top").withColumn("block", F.pmod(F.xxhash64("rid"), blocks).cast("int"))
    every = rows.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    earlier = F.array_position("bu", F.col("band")).cast("int") - 1
    new = ~F.arrays_overlap(F.slice("bu", F.lit(1), earlier), F.slice("bv", F.lit(1), earlier))
    # Of two outsiders each pair once; with a member of the largest root it comes once anyway.
    other = (F.col("ru") != F.col("rv")) & ((F.col("rv") == F.col("top")) | (F.col("ru") < F.col("rv")))
    near = side(outside, "u", ["band", "block", "top"]).join(side(every, "v", ["band", "block"]), ["band", "block"]).where(other & fits & new)
    near = settle(near.select("u", "v", "ru", "rv", like.alias("like")), "near")
    # One link joins two roots: the likeliest pair of each two is confirmed first, then what is still apart.
    pair = [F.least("ru", "rv"), F.greatest("ru", "rv")]
    best = near.groupBy(pair[0].alias("r0"), pair[1].alias("r1")).agg(F.max_by(F.struct("u", "v"), F.struct("like", "u", "v")).alias("p")).select("p.u", "p.v")
    merged = merged_roots(confirmed(settle(best, "best"), sets, percent), everyone.join(moved, "root0").select("rid", "root"))
    moved = settle(moved.join(merged, "root", "left").select("root0", F.coalesce("into", "root").alias("root")), "roots")
    into = merged.withColumnRenamed("root", "r")
    left = (
        near.join(into.withColumnRenamed("into", "iu"), F.col("ru") == F.col("r"), "left").drop("r")
        .join(into.withColumnRenamed("into", "iv"), F.col("rv") == F.col("r"), "left").drop("r")
        .where(F.coalesce("iu", "ru") != F.coalesce("iv", "rv")).select("u", "v")
    )
    linked = confirmed(settle(left, "left"), sets, percent)
    merged = merged_roots(settle(linked, "links"), everyone.join(moved, "root0").select("rid", "root"))
    moved = moved.join(merged, "root", "left").select("root0", F.coalesce("into", "root").alias("into"))

    final = (
        base.join(roots.withColumnRenamed("rid", "rep"), "rep", "left")
        .select("doc_id", "file", "row", "n_shingles", F.coalesce("root", "rep").alias("root0"))
        .join(moved, "root0", "left").select("doc_id", "file", "row", "n_shingles", F.coalesce("into", "root0").alias("component"))
    )
    final = settle(final, "components")
    stays = settle(
        final.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "file", "row")).alias("stays")), "stays"
    )
    return final.join(stays, "component").select(
        "doc_id", "n_shingles", F.col("stays.doc_id").alias("component_id"),
        ((F.col("file") == F.col("stays.file")) & (F.col("row") == F.col("stays.row"))).alias("kept"), "file", "row",
    )


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group, columns unchanged."""
    docs, place = located(docs)
    return without(docs, place, near_duplicates(docs, **options).where("not kept"))
