"""Alignment of two tokenizers over a corpus: which of their ids stand for the same bytes.

Where a token of A and one of B end at the same byte, both token lists are cut; what lies between two
cuts is a group, and every A token of a group is linked with every B token of it.  The count of an id
pair is the number of documents that hold it linked.

Method: the B id with the same bytes as each A id is an array made once.  Such a pair, which is all that a
group of one token a side can hold, is counted in a vector as long as the vocabulary, one a task.  Only the
pairs of irregular groups are shuffled, and those as (block of documents, pair, documents of the block),
so a pair that every document holds is one row a block and no key is hot.  Blocks then meet the
counts of their own pairs and add them up by document.  What a block knows of its segments is kept as packed bytes
and in row groups of a few blocks, so executors hold and shuffle little of it at once.

Defined results: a text that is null or empty, or whose bytes either tokenizer does not give back
after a space, has zeros and ''.  Strings that look like special tokens are plain text.  Rows with equal or null
ids are documents of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from motorlake.llm import wordcuts
from motorlake.llm.packing import vocabulary_path
from motorlake.llm.rows import column, ship, text_of
from motorlake.session import settle

A_VOCABULARY, B_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Text of a block of documents, what a document counts besides its text, and segments a task remembers.
BLOCK_CHARS, DOCUMENT_CHARS, REMEMBERED = 1 << 20, 128, 250_000
#: Blocks in a row group, which a task reads as one.
GROUP_BLOCKS = 8
#: Segments aligned in one call: both libraries are slower on long strings.
AT_ONCE = 2_000


@functools.lru_cache(maxsize=1)
def _byte_signs() -> dict[str, int]:
    """The byte for each character of a byte-level vocabulary: printable ones stand for themselves, others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class ByteLevel:
    """Tokenizer A: ids of a text, and the bytes of each id."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are what runs in parallel
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True
        names, signs = self.own.get_vocab(with_added_tokens=True), _byte_signs()
        self.bytes = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.bytes[i] = bytes(signs[c] for c in name) if all(c in signs for c in name) else name.encode()
        self.widths = np.asarray([len(b) for b in self.bytes], np.int64)

    def encode(self, text: str) -> np.ndarray:
        return np.asarray(self.own.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.int64)


class Pieces:
    """Tokenizer B, which puts a space before every text."""

    def __init__(self, path: str):
        import sentencepiece

        self.own = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [self._bytes(i) for i in range(self.own.get_piece_size())]
        self.widths = np.asarray([len(b) for b in self.bytes], np.int64)
        self.space = self.own.piece_to_id("▁")

    def _bytes(self, i: int) -> bytes:
        name = self.own.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if self.own.is_byte(i) else name.replace("▁", " ").encode()

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text that starts with a space or a line feed."""
        if text[0] == " ":
            return np.asarray(self.own.encode(text[1:], num_threads=1), dtype=np.int64)
        found = np.asarray(self.own.encode(text, num_threads=1), dtype=np.int64)
        return found[1:] if len(found) and found[0] == self.space else found


@functools.lru_cache(maxsize=2)
def _pair(a_path: str, b_path: str) -> tuple[ByteLevel, Pieces, np.ndarray]:
    a, b = ByteLevel(a_path), Pieces(b_path)
    return a, b, same_bytes(a.bytes, b.bytes, [b.own.is_byte(i) for i in range(len(b.bytes))])


def same_bytes(a: list[bytes], b: list[bytes], single: list[bool]) -> np.ndarray:
    """For each A id the B id with the same bytes, or -1; a piece of text goes before one that names a byte."""
    by_bytes = {b[i]: i for i in sorted(range(len(b)), key=lambda i: (not single[i], -i))}
    return np.asarray([by_bytes.get(x, -1) if x else -1 for x in a], np.int64)


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    ordered = np.sort(values)
    return ordered[np.flatnonzero(np.diff(ordered, prepend=ordered[:1] - 1))]


def packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 in their narrowest type, compressed; the first byte is the type's width."""
    width = np.min_scalar_type(int(values.max(initial=0))).itemsize
    return bytes([width]) + zlib.compress(values.astype(f"<u{width}").tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), f"<u{data[0]}").astype(np.int64)


class Aligner:
    """Groups and links of segments, each aligned once as long as it is remembered.  A pair is one number, a * |B| + b."""

    def __init__(self, a: ByteLevel, b: Pieces, remembered: int = REMEMBERED):
        self.a, self.b, self.remembered = a, b, remembered
        self.names = [str(i) for i in range(max(len(a.bytes), len(b.bytes)))]
        self.forget()

    def forget(self) -> None:
        self.known, self.links, self.strings = wordcuts.Numbering(), wordcuts.Ragged(np.int64), []
        #: n_a, n_b, n_groups, and whether the bytes were given back.
        self.sizes = wordcuts.Ragged(np.int64)

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """The segments of each text by number."""
        found = [self.known.numbers(wordcuts.keys(t)) for t in texts]
        new, self.known.new = self.known.new, []
        start = 0
        while start < len(new):  # odd segments stand alone, others side by side
            stop = start + 1
            if not wordcuts.is_odd(new[start]):
                while stop < len(new) and stop < start + AT_ONCE and not wordcuts.is_odd(new[stop]):
                    stop += 1
            self._align([wordcuts.segment(k) for k in new[start:stop]])
            start = stop
        return found

    def _align(self, parts: list[str]) -> None:
        text = "".join(parts)
        a, b, whole = self.a.encode(text), self.b.encode(text), text.encode()
        if b"".join(map(self.a.bytes.__getitem__, a.tolist())) != whole or b"".join(map(self.b.bytes.__getitem__, b.tolist())) != whole:
            if len(parts) > 1:
                for part in parts:
                    self._align([part])
                return
            self.links.extend(np.empty(0, np.int64), np.zeros(1, np.int64))
            self.sizes.extend(np.zeros(4, np.int64), np.full(1, 4))
            self.strings.append("")
            return
        end_a, end_b = np.cumsum(self.a.widths[a]), np.cumsum(self.b.widths[b])
        ends = np.sort(np.concatenate([end_a, end_b]))
        ends = ends[:-1][ends[1:] == ends[:-1]]
        group_a, group_b = np.searchsorted(ends, end_a), np.searchsorted(ends, end_b)
        many_a, many_b = np.bincount(group_a, minlength=len(ends)), np.bincount(group_b, minlength=len(ends))
        first_b = np.cumsum(many_b) - many_b
        links = np.repeat(a, many_b[group_a]) * len(self.b.bytes) + b[wordcuts.spans(first_b[group_a], many_b[group_a])]

        stops = np.cumsum([len(p.encode()) for p in parts])
        def upto(places):
            return np.searchsorted(places, stops, "right")

        groups = upto(ends)
        self.links.extend(links, np.diff(np.concatenate([[0], np.cumsum(many_a * many_b)])[groups], prepend=0))
        sizes = [np.diff(upto(e), prepend=0) for e in (end_a, end_b, ends)] + [np.ones(len(parts), np.int64)]
        self.sizes.extend(np.stack(sizes, axis=1).ravel(), np.full(len(parts), 4))
        self._write(a, b, group_a, group_b, many_a, first_b, upto(end_a) + upto(end_b))

    def _write(self, a, b, group_a, group_b, many_a, first_b, stops) -> None:
        """The groups of each segment as text, A's ids before B's, a ';' after every group."""
        ids, marks = np.empty(len(a) + len(b), np.int64), np.zeros(len(a) + len(b), np.int64)
        at_a = np.arange(len(a)) + first_b[group_a]
        at_b = np.arange(len(b)) + np.cumsum(many_a)[group_b]
        ids[at_a], ids[at_b] = a, b
        marks[at_a[np.flatnonzero(np.diff(group_a, append=-1))]] = 1
        marks[at_b[np.flatnonzero(np.diff(group_b, append=-1))]] = 2
        signs = [self.names[i] + ",|;"[m] for i, m in zip(ids.tolist(), marks.tolist(), strict=True)]
        start = 0
        for stop in stops.tolist():
            self.strings.append("".join(signs[start:stop]))
            start = stop


@functools.lru_cache(maxsize=1)
def _aligner(a_path: str, b_path: str) -> Aligner:
    """The aligner of this Python worker, which serves one task after the other."""
    return Aligner(*_pair(a_path, b_path)[:2])


#: Packed columns of a block: segments of each document by number, then the links of each distinct segment.
PACKED = ("n_segments", "segments", "n_own", "own")


def _blocks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per block of documents: their figures and segments, the segments' links, and the block's pairs;
    at the end of a task one row of its vector.
    """
    kind = docs.schema["doc_id"].dataType
    long, integer = pa.list_(pa.int64()), pa.list_(pa.int32())

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, twin = _pair(a_path, b_path)
        aligner, vector = _aligner(a_path, b_path), np.zeros(len(a.bytes), np.int64)
        count, task = len(b.bytes), TaskContext.get().partitionId()
        kinds = {"n_a": long, "n_b": long, "n_groups": long, "n_links": long, "sha": pa.list_(pa.string())}
        kinds |= {n: pa.binary() for n in PACKED} | {"pair": integer, "docs": integer, "same": integer, "same_docs": long}
        block = 0

        def row(ids: pa.Array | None, figures: dict) -> pa.RecordBatch:
            nonlocal block
            columns = [pa.array([(task << 32) + block])]
            if ids is None:
                columns.append(pa.nulls(1, pa.list_(id_type)))
            else:
                columns.append(pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids))
            for name, of in kinds.items():
                values = figures.get(name)
                if values is None:
                    columns.append(pa.nulls(1, of))
                elif name in PACKED:
                    columns.append(pa.array([packed(values)], of))
                else:
                    columns.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, of.value_type)))
            block += 1
            return pa.RecordBatch.from_arrays(columns, names=["block", "doc_id", *kinds])

        def finished(ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
            if len(aligner.known) > aligner.remembered:
                aligner.forget()
            found = aligner.numbers(texts)
            good = [bool(len(n)) and bool(aligner.sizes.flat[4 * n + 3].all()) for n in found]
            found = [n if ok else n[:0] for n, ok in zip(found, good, strict=True)]
            lengths = np.asarray([len(n) for n in found], np.int64)
            flat = np.concatenate(found) if found else np.empty(0, np.int32)
            own = _distinct(flat)
            local = np.searchsorted(own, flat)
            ends = np.concatenate([[0], np.cumsum(lengths)])

            def by_document(values):
                return np.diff(np.concatenate([[0], np.cumsum(values)])[ends])

            strings = aligner.strings
            sha = [hashlib.sha256("".join(map(strings.__getitem__, n.tolist()))[:-1].encode()).hexdigest() if len(n) else "" for n in found]
            figures = {"n_a": by_document(aligner.sizes.flat[4 * flat]), "n_b": by_document(aligner.sizes.flat[4 * flat + 1])}
            figures |= {"n_groups": by_document(aligner.sizes.flat[4 * flat + 2]), "n_links": by_document(aligner.links.lengths(flat))}
            # Pairs of each document, once.
            once = _distinct(np.repeat(np.arange(len(texts)), lengths) * len(own) + local)
            doc, segment = np.divmod(once, max(len(own), 1))
            many = aligner.links.lengths(own[segment])
            held = np.sort(_distinct((np.repeat(doc, many) << 32) + aligner.links.take(own[segment])) & 0xFFFFFFFF)
            first = np.flatnonzero(np.diff(held, prepend=-1))
            pair, n_docs = held[first], np.diff(first, append=len(held))
            left, right = np.divmod(pair, count)
            twins = twin[left] == right
            vector[left[twins]] += n_docs[twins]
            figures |= {"sha": sha, "n_segments": lengths, "segments": local, "n_own": aligner.links.lengths(own), "own": aligner.links.take(own)}
            return row(ids, figures | {"pair": pair[~twins], "docs": n_docs[~twins]})

        ids, texts, size = [], [], 0
        id_type = None
        for batch in batches:
            id_type, start = batch.column(0).type, 0
            for k, text in enumerate(batch.column(1).to_pylist(), 1):
                texts.append(text)
                size += len(text) + DOCUMENT_CHARS
                if size >= BLOCK_CHARS or k == batch.num_rows:
                    ids.append(batch.column(0).slice(start, k - start))
                    start = k
                if size >= BLOCK_CHARS:
                    yield finished(pa.concat_arrays(ids), texts)
                    ids, texts, size = [], [], 0
        if texts:
            yield finished(pa.concat_arrays(ids), texts)
        if id_type is not None:
            seen = np.flatnonzero(vector)
            yield row(None, {"same": seen, "same_docs": vector[seen]})

    lists = "n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, sha array<string>"
    lists += "".join(f", {n} binary" for n in PACKED)
    lists += ", pair array<int>, docs array<int>, same array<int>, same_docs array<bigint>"
    return docs.mapInArrow(align, f"block bigint, doc_id array<{kind.simpleString()}>, {lists}")


def align(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    a_vocabulary: str | None = None,
    b_vocabulary: str | None = None,
) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    ship(docs.sparkSession)
    a_path, b_path = a_vocabulary or vocabulary_path(A_VOCABULARY), b_vocabulary or vocabulary_path(B_VOCABULARY)
    blocks, pairs, same = pair_counts(docs.select(column(docs, id_column).alias("doc_id"), text_of(docs, text_column).alias("text")), a_path, b_path)
    a, b, twin = _pair(a_path, b_path)
    n_a, n_b = len(a.bytes), len(b.bytes)
    # Both vectors are as long as A's vocabulary, whatever the corpus.
    same_docs, best = np.zeros(n_a, np.int64), np.zeros(n_a, np.int64)
    for r in same.collect():
        same_docs[r.a] = best[r.a] = r.n
    for r in pairs.groupBy(F.expr(f"int(pair div {n_b})").alias("a")).agg(F.max("n").alias("n")).collect():
        best[r.a] = max(best[r.a], r.n)
    told = pairs.groupBy("block").agg(F.collect_list("pair").alias("pairs"), F.collect_list("n").alias("counts"))  # a block is bounded
    kind = docs.schema[id_column].dataType.simpleString()
    met = blocks.where("doc_id is not null").drop("pair", "docs", "same", "same_docs").join(told, "block", "left")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                def get(name):
                    values = batch.column(name)[k].values
                    return np.empty(0, np.int64) if values is None else values.to_numpy(zero_copy_only=False)

                ids = batch.column("doc_id")[k].values
                n_segments, segments, n_own, own = (unpacked(batch.column(n)[k].as_py()) for n in PACKED)
                pair, counts = get("pairs").astype(np.int64), get("counts")
                order = np.argsort(pair)
                pair, counts = pair[order], counts[order]
                left, right = np.divmod(own, n_b)
                twins = twin[left] == right
                count = np.where(twins, same_docs[left], 0)
                count[~twins] = counts[np.searchsorted(pair, own[~twins])]
                ends = np.concatenate([[0], np.cumsum(n_own)])
                by_doc = np.concatenate([[0], np.cumsum(n_segments)])
                sums = []
                for values in (count == best[left], count):
                    segment = np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[ends])
                    sums.append(np.diff(np.concatenate([[0], np.cumsum(segment[segments])])[by_doc]))
                plain = [pa.array(get(n)) for n in ("n_a", "n_b", "n_groups", "n_links")]
                yield pa.RecordBatch.from_arrays(
                    [ids, *plain, *map(pa.array, sums), batch.column("sha")[k].values],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
                )

    counts = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint"
    return met.mapInArrow(add_up, f"doc_id {kind}, {counts}, groups_sha256 string")


def pair_counts(docs: DataFrame, a_path: str, b_path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks of the documents (doc_id, text); (block, pair, n) of irregular pairs, n over all blocks; (a, n) of pairs of equal bytes."""
    blocks = settle(_blocks(docs, a_path, b_path), "blocks", options={"parquet.block.row.count.limit": GROUP_BLOCKS})
    each = blocks.select("block", F.explode(F.arrays_zip("pair", "docs")).alias("p")).select("block", "p.pair", "p.docs")
    pairs = each.select("block", "pair", F.sum("docs").over(Window.partitionBy("pair")).alias("n"))
    same = blocks.select(F.explode(F.arrays_zip("same", "same_docs")).alias("p")).groupBy(F.col("p.same").alias("a")).agg(F.sum("p.same_docs").alias("n"))
    return blocks, settle(pairs, "pairs"), same


def dictionary(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", a_vocabulary: str | None = None, b_vocabulary: str | None = None) -> DataFrame:
    """All linked id pairs with the number of documents that hold them: a, b, n_docs."""
    ship(docs.sparkSession)
    a_path, b_path = a_vocabulary or vocabulary_path(A_VOCABULARY), b_vocabulary or vocabulary_path(B_VOCABULARY)
    a, b, twin = _pair(a_path, b_path)
    narrow = docs.select(column(docs, id_column).alias("doc_id"), text_of(docs, text_column).alias("text"))
    _, pairs, same = pair_counts(narrow, a_path, b_path)
    irregular = pairs.groupBy("pair").agg(F.max("n").alias("n_docs"))
    twins = docs.sparkSession.createDataFrame([(k, int(t)) for k, t in enumerate(twin) if t >= 0], "a int, b int")
    equal = same.join(twins, "a").select("a", "b", F.col("n").alias("n_docs"))
    return irregular.selectExpr(f"int(pair div {len(b.bytes)}) AS a", f"int(pair % {len(b.bytes)}) AS b", "n_docs").unionByName(equal)
