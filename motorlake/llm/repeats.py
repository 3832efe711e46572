"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

A suffix is ordered through its first ``width`` bytes only, by passes from the most significant
digit on; a class of one suffix is finished, and classes of more at full depth are exactly the
repeated windows.  Passes never see every suffix: windows are led by their anchor (``anchors``), so

1. the first digit is the anchor's 40 bytes: anchors that stand alone end here;
2. the next is the whole context of the anchor's windows: equal contexts are all repeated;
3. where one anchor has several contexts, one of each goes on in blocks of 16 windows: first by the
   bytes common to the block (a block whose common bytes stand alone has no repeated window), then
   by all its bytes (equal blocks are all repeated);
4. blocks that agree in the common bytes only are ordered by single windows.

Equality is by 64-bit hashes on top of the equal anchor's 64-bit hash, i.e. by 128 bits.  Every byte
of a text that a repeated window covers is removed.  Texts travel compressed and only to their own
row of the table; no group of equal windows is gathered, they are counted and joined back.

Defined results: a null text is empty; texts shorter than the width keep everything.  Repeated rows
are texts like others, so both lose what they share.  Overlaps within one text count.  An empty
table gives no rows.  Extra columns are not read; null ids are returned as null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from motorlake.llm import bytewords
from motorlake.llm.anchors import anchors, hashes_of
from motorlake.llm.rows import column, located, text_of
from motorlake.session import settle

WIDTH = 200
BLOCK = 16
U = np.uint64
#: Result columns of one document.
RESULT = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _identity(place: Column) -> list[Column]:
    """A row's place in two numbers (files are few)."""
    return [F.xxhash64(place["file"]).alias("fid"), place["row"].alias("row")]


def _list(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays).astype(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _longs(col: pa.Array) -> list[np.ndarray]:
    """Each row's list as numbers; null lists are empty."""
    return [np.array([], np.int64) if v is None else np.asarray(v, np.int64) for v in col.to_numpy(zero_copy_only=False)]


def anchor_rows(docs: DataFrame, place: Column, text_column: str, width: int) -> DataFrame:
    """gram, context, fid, row, at: one row per anchor; ``at`` packs start, count and depth."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "context", "fid", "row", "at"]
        for batch in bytewords.bounded(batches, 2):
            data, offsets = bytewords.text_buffers(batch.column(2))
            fid, row = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            parts, size = [], 0
            for k in range(len(batch)):
                own = data[offsets[k] : offsets[k + 1]]
                if len(own) < width:
                    continue
                gram, context, start, count, depth = anchors(own, width)
                at = start << 16 | count << 8 | depth
                parts.append((gram.view(np.int64), context.view(np.int64), np.full(len(at), fid[k]), np.full(len(at), row[k]), at))
                size += len(at)
                if size > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=names)
                    parts, size = [], 0
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=names)

    texts = docs.select(*_identity(place), text_of(docs, text_column).alias("text")).where(F.octet_length("text") >= width)
    return texts.mapInArrow(make, "gram bigint, context bigint, fid bigint, row bigint, at bigint")


def _covered(size: int, ranges: np.ndarray, width: int) -> np.ndarray:
    """Bytes covered by windows; a range packs the first window and their number."""
    edge = np.zeros(size + 1, np.int64)
    start, count = ranges >> 8, ranges & 255
    np.add.at(edge, start, 1)
    np.add.at(edge, start + count - 1 + width, -1)
    return np.cumsum(edge[:-1]) > 0


def _outcome(data: np.ndarray, ranges: np.ndarray, width: int) -> tuple[int, int, int, str]:
    gone = _covered(len(data), ranges, width)
    spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (gone[0] if len(gone) else 0))
    return len(data), int(gone.sum()), spans, hashlib.sha256(data[~gone].tobytes()).hexdigest()


def _first_outcome(rows: DataFrame, width: int, kind: str) -> DataFrame:
    """Documents whose anchors are settled get their result; the others are held with their text."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            whole, grams, open_at = (_longs(batch.column(i)) for i in (4, 5, 6))
            held = [len(x) > 0 for x in open_at]
            out = []
            for k, packed in enumerate(batch.column(3)):
                raw = unpack.decompress(packed.as_buffer())
                data = np.frombuffer(raw, np.uint8)
                out.append((len(data), None, None, None) if held[k] else _outcome(data, whole[k], width))
            kept = [None if not h else t for h, t in zip(held, batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), batch.column(2), pa.array([t.as_py() if t is not None else None for t in kept], pa.binary()),
                    _list(whole), _list(grams), _list(open_at), *[pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                ],
                names=["fid", "row", "doc_id", "packed", "whole", "grams", "open_at", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return rows.select("fid", "row", "doc_id", "packed", "whole", "grams", "open_at").mapInArrow(
        look, f"fid bigint, row bigint, doc_id {kind}, packed binary, whole array<bigint>, grams array<bigint>, open_at array<bigint>, {RESULT}"
    )


def _block_rows(held: DataFrame, width: int) -> DataFrame:
    """class, core, union, fid, row, windows: one row per block of windows of the held contexts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            grams, open_at = _longs(batch.column(3)), _longs(batch.column(4))
            fid, row = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for k, packed in enumerate(batch.column(2)):
                data = np.frombuffer(unpack.decompress(packed.as_buffer()), np.uint8)
                at = open_at[k]
                start, count, depth = at >> 16, at >> 8 & 255, at & 255
                first, last = (depth - count + 1) // BLOCK, depth // BLOCK
                per = last - first + 1
                own = np.repeat(np.arange(len(at)), per)
                block = first[own] + np.arange(len(own)) - np.repeat(np.cumsum(per) - per, per)
                low = np.maximum(depth[own] - count[own] + 1, block * BLOCK)
                high = np.minimum(depth[own], block * BLOCK + BLOCK - 1)
                anchor = start[own] + depth[own]
                core = hashes_of(data, anchor - block * BLOCK, anchor - block * BLOCK - BLOCK + 1 + width)
                begin, windows = anchor - high, high - low + 1
                union = hashes_of(data, begin, begin + windows - 1 + width)
                union = bytewords.mix(union + (low << 8 | high).astype(U))
                label = bytewords.mix(grams[k].view(U)[own] + block.astype(U))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(label.view(np.int64)), pa.array(core.view(np.int64)), pa.array(union.view(np.int64)), pa.array(np.full(len(own), fid[k])), pa.array(np.full(len(own), row[k])), pa.array(begin << 8 | windows)],
                    names=["label", "core", "union", "fid", "row", "windows"],
                )

    return held.select("fid", "row", "packed", "grams", "open_at").mapInArrow(
        cut, "label bigint, core bigint, union bigint, fid bigint, row bigint, windows bigint"
    )


def _window_rows(blocks: DataFrame, width: int) -> DataFrame:
    """label, hash, fid, row, window: one row per window of the blocks (fid, row, packed, labels, windows)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            labels, windows = _longs(batch.column(3)), _longs(batch.column(4))
            fid, row = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for k, packed in enumerate(batch.column(2)):
                data = np.frombuffer(unpack.decompress(packed.as_buffer()), np.uint8)
                start, count = windows[k] >> 8, windows[k] & 255
                own = np.repeat(np.arange(len(start)), count)
                at = start[own] + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
                value = hashes_of(data, at, at + width).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(labels[k][own]), pa.array(value), pa.array(np.full(len(own), fid[k])), pa.array(np.full(len(own), row[k])), pa.array(at << 8 | 1)],
                    names=["label", "hash", "fid", "row", "window"],
                )

    return blocks.select("fid", "row", "packed", "labels", "windows").mapInArrow(
        cut, "label bigint, hash bigint, fid bigint, row bigint, window bigint"
    )


def _last_outcome(rows: DataFrame, width: int, kind: str) -> DataFrame:
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            whole, more = _longs(batch.column(4)), _longs(batch.column(5))
            out = [
                _outcome(np.frombuffer(unpack.decompress(p.as_buffer()), np.uint8), np.concatenate([a, b]), width)
                for p, a, b in zip(batch.column(3), whole, more, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), *[pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return rows.select("fid", "row", "doc_id", "packed", "whole", "marks").mapInArrow(look, f"doc_id {kind}, {RESULT}")


def _packed_texts(docs: DataFrame, place: Column, id_column: str, text_column: str) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            small = pa.array([tool.compress(t.as_buffer()) for t in batch.column(3).cast(pa.binary())], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], small], names=["fid", "row", "doc_id", "packed"])

    texts = docs.select(*_identity(place), column(docs, id_column).alias("doc_id"), text_of(docs, text_column).alias("text"))
    return texts.mapInArrow(pack, f"fid bigint, row bigint, doc_id {texts.schema['doc_id'].dataType.simpleString()}, packed binary")


def remove_repeats(docs: DataFrame, width: int = WIDTH, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    docs, place = located(docs)
    key = ["fid", "row"]
    # 1. Anchors' own bytes.  The anchors are computed twice rather than stored.
    found = anchor_rows(docs, place, text_column, width)
    # Counts that are joined back are stored first: the adaptive skew join splits a hot value only
    # where both sides of a join are shuffled for it.
    again = settle(found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "again")
    shared = settle(found.join(again, "gram", "left_semi"), "anchors")

    # 2. Whole contexts.
    contexts = settle(
        shared.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("fid", "row", "at")).alias("one")), "contexts"
    )
    several = settle(contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("gram", F.lit(True).alias("open")), "several")
    judged = contexts.join(several, "gram", "left").select("gram", "context", (F.col("n") > 1).alias("all"), F.coalesce("open", F.lit(False)).alias("open"), "one")
    own = (F.col("open") & (F.struct("fid", "row", "at") == F.col("one"))).alias("goes_on")
    marked = shared.join(judged, ["gram", "context"]).select("fid", "row", "gram", "at", "all", own).where("all or goes_on")
    lists = marked.groupBy(*key).agg(
        F.collect_list(F.when(F.col("all"), F.shiftrightunsigned("at", 8))).alias("packed_whole"),
        F.collect_list(F.when(F.col("goes_on"), F.struct("gram", "at"))).alias("next"),
    ).select(
        *key,
        # start << 8 | count
        F.col("packed_whole").alias("whole"), F.col("next.gram").alias("grams"), F.col("next.at").alias("open_at"),
    )
    texts = _packed_texts(docs, place, id_column, text_column)
    kind = texts.schema["doc_id"].dataType.simpleString()
    first = settle(_first_outcome(texts.join(lists, key, "left"), width, kind), "held")
    held = first.where("packed is not null")

    # 3. Blocks of windows, by their common bytes and then by all bytes.
    blocks = settle(_block_rows(held, width), "blocks")
    cores = settle(
        blocks.groupBy("label", "core").agg(F.count(F.lit(1)).alias("n"), F.min("union").alias("lo"), F.max("union").alias("hi")).where("n > 1"), "cores"
    )
    alike = settle(blocks.join(cores.select("label", "core", (F.col("lo") != F.col("hi")).alias("differ")), ["label", "core"]), "alike")
    unions = alike.groupBy("label", "core", "union", "differ").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("fid", "row", "windows")).alias("one"))
    whole_blocks = alike.join(unions.where("m > 1").select("label", "core", "union"), ["label", "core", "union"]).select("fid", "row", F.col("windows").alias("mark"))

    # 4. Single windows of blocks that agree in part.
    parts = unions.where("differ").select("one.fid", "one.row", "one.windows", "label").groupBy(*key).agg(F.collect_list(F.struct("label", "windows")).alias("b"))
    wanted = parts.select(*key, F.col("b.label").alias("labels"), F.col("b.windows").alias("windows"))
    windows = settle(_window_rows(held.select(*key, "packed").join(wanted, key), width), "windows")
    equal = windows.groupBy("label", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("label", "hash")
    single = windows.join(equal, ["label", "hash"], "left_semi").select("fid", "row", F.col("window").alias("mark"))

    marks = whole_blocks.unionByName(single).groupBy(*key).agg(F.collect_list("mark").alias("marks"))
    last = _last_outcome(held.select(*key, "doc_id", "packed", "whole").join(marks, key, "left"), width, kind)
    done = first.where("packed is null").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return done.unionByName(last)
