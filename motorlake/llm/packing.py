"""Best-fit packing of tokenised documents into sequences, by large-item matching.

A document is its ids and an end id.  Only documents longer than a sequence are cut: the first piece
takes the remainder, all others are full.  Packing looks at lengths alone, and a capacity of C has at
most C of them, so the plan is made from the number of pieces of each length: it has at most a few
runs of like sequences per length, however many pieces there are.

1. Full pieces are sequences of their own.
2. Large pieces, above a third of the capacity, share a sequence at most in twos.  From the longest
   on, each is matched with the longest large piece that still fits beside it, which is the best
   possible for such pieces.
3. Smaller pieces, from the longest on, go where they leave the smallest gap.  Sequences of one gap are
   filled together: what one of them takes best, the next takes too.

Which piece takes which place of the plan is settled by its rank among pieces of its length: its
place in its task, plus those in the tasks before it.  No piece is compared with another.

Defined results: a null or empty text is its end id alone.  Strings that look like special tokens are
read as the library's default reads them.  Repeated rows and null ids are packed row by row; an empty
table gives no rows; columns other than id and text are not read.  Sequence ids have no gaps.
"""

from __future__ import annotations

import functools
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from motorlake.llm import wordcuts
from motorlake.llm.rows import column, ship, text_of
from motorlake.session import settle

VOCABULARY = "byte_bpe_50k.json"
CAPACITY, END = 1024, 2
#: Segments whose ids a task remembers.
REMEMBERED = 400_000
#: More pieces of one length than any table has.
_RANKS = 1 << 50


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are what runs in parallel
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Ids of texts; a segment is encoded once as long as it is remembered."""

    def __init__(self, tokenizer, remembered: int = REMEMBERED):
        self.tokenizer, self.remembered = tokenizer, remembered
        names = tokenizer.get_vocab(with_added_tokens=True)
        self.widths = np.zeros(max(names.values()) + 1, np.int64)
        self.widths[list(names.values())] = [len(n) for n in names]  # one character stands for a byte
        self._forget()

    def _forget(self) -> None:
        self.known, self.ids = wordcuts.Numbering(), wordcuts.Ragged(np.uint32)

    def _encode(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.int64)

    def learn(self) -> None:
        """Encode the segments that are new; odd ones stand alone."""
        new, self.known.new = self.known.new, []
        odd = [k for k, key in enumerate(new) if wordcuts.is_odd(key)]
        plain = [wordcuts.segment(key) for key in new if not wordcuts.is_odd(key)]
        ids, counts = wordcuts.encode_joined(plain, self._encode, self.widths)
        if odd:
            alone = {k: self._encode(wordcuts.segment(new[k])) for k in odd}
            rows = iter(np.split(ids, np.cumsum(counts)[:-1]) if plain else [])
            each = [alone[k] if k in alone else next(rows) for k in range(len(new))]
            ids, counts = np.concatenate(each), np.asarray([len(e) for e in each])
        self.ids.extend(ids, counts)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > self.remembered:
            self._forget()
        cut = [wordcuts.keys(t) for t in texts]
        numbers = [self.known.numbers(c[1:]) for c in cut]
        self.learn()
        heads = [self._encode(c[0].removeprefix(" ")) if c else np.empty(0, np.int64) for c in cut]  # no space before it
        return [np.concatenate([h, self.ids.take(n)]).astype("<u4") for h, n in zip(heads, numbers, strict=True)]


@dataclass
class Plan:
    """Runs of places for pieces of one length: (length, first rank, first sequence, pieces a sequence, offset)."""

    capacity: int
    sequences: int = 0
    runs: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    used: Counter = field(default_factory=Counter)

    def place(self, length: int, count: int, sequence: int, each: int, offset: int) -> None:
        self.runs.append((length, self.used[length], sequence, each, offset))
        self.used[length] += count

    def open(self, count: int) -> int:
        self.sequences += count
        return self.sequences - count


def make_plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Places for ``counts[length]`` pieces of each length."""
    plan = Plan(capacity)
    left = {k: n for k, n in counts.items() if n}
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
    full = left.pop(capacity, 0)
    if full:
        plan.place(capacity, full, plan.open(full), 1, 0)

    large = sorted((k for k in left if 3 * k > capacity), reverse=True)
    for length in large:
        while left[length]:
            mate = next((m for m in large if m <= min(length, capacity - length) and left[m] > (m == length)), None)
            if mate is None:
                count = left[length]
                first = plan.open(count)
            elif mate == length:
                count = left[length] // 2
                first = plan.open(count)
                plan.place(mate, count, first, 1, length)
                left[mate] -= count
            else:
                count = min(left[length], left[mate])
                first = plan.open(count)
                plan.place(mate, count, first, 1, length)
                left[mate] -= count
            plan.place(length, count, first, 1, 0)
            left[length] -= count
            gaps[capacity - length - (mate or 0)].append((first, count))

    for length in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[length]:
            gap = min((g for g, runs in gaps.items() if g >= length and runs), default=None)
            if gap is None:
                gap, each = capacity, capacity // length
                need = -(-left[length] // each)
                gaps[gap].append((plan.open(need), need))
            first, bins = gaps[gap].pop()
            each = gap // length
            filled, rest = divmod(min(left[length], each * bins), each)
            if filled:
                plan.place(length, filled * each, first, each, capacity - gap)
                gaps[gap - each * length].append((first, filled))
            if rest:
                plan.place(length, rest, first + filled, rest, capacity - gap)
                gaps[gap - rest * length].append((first + filled, 1))
            left[length] -= filled * each + rest
            untouched = bins - filled - (rest > 0)
            if untouched:
                gaps[gap].append((first + bins - untouched, untouched))
    return plan


def _pieces(docs: DataFrame, id_column: str, text_column: str, path: str, capacity: int, end: int, with_ids: bool) -> DataFrame:
    """Every piece with its task and its place among the task's pieces of its length."""
    narrow = docs.select(column(docs, id_column).alias("doc_id"), text_of(docs, text_column).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen, task = Encoder(_tokenizer(path)), Counter(), TaskContext.get().partitionId()
        for batch in batches:
            rows, ids_of = [], []
            for k, found in enumerate(encoder.encode(batch.column(1).to_pylist())):
                ids = np.append(found, np.uint32(end)).astype("<u4")
                start, piece = 0, 0
                while start < len(ids):
                    length = (len(ids) - start - 1) % capacity + 1
                    part = ids[start : start + length]
                    rows.append((k, piece, start, length, zlib.crc32(part), seen[length]))
                    if with_ids:
                        ids_of.append(part.astype(np.int32))
                    seen[length] += 1
                    start, piece = start + length, piece + 1
            at = np.asarray(rows, dtype=np.int64).reshape(-1, 6)
            columns = [batch.column(0).take(pa.array(at[:, 0])), pa.array(at[:, 1].astype(np.int32))]
            columns += [pa.array(at[:, k].copy()) for k in range(2, 6)]
            columns += [pa.array(np.full(len(rows), task, dtype=np.int64))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "nth", "task"]
            if with_ids:
                columns, names = [*columns, pa.array(ids_of, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, nth bigint, task bigint"
    return narrow.mapInArrow(cut, schema + (", ids array<int>" if with_ids else ""))


def pack(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    vocabulary: str | None = None,
    capacity: int = CAPACITY,
    end: int = END,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for)."""
    ship(docs.sparkSession)
    found = settle(_pieces(docs, id_column, text_column, vocabulary or vocabulary_path(), capacity, end, with_ids), "pieces")
    tasks = settle(found.groupBy("task", "length").agg(F.count("*").alias("n")), "lengths")
    counts = {r.length: r.n for r in tasks.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity``
    runs = sorted(make_plan(counts, capacity).runs)
    length, rank, sequence, each, offset = (np.asarray(c, dtype=np.int64) for c in (zip(*runs, strict=True) if runs else [()] * 5))
    starts = length * _RANKS + rank

    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = tasks.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = found.join(base, ["task", "length"]).select(*found.columns, (F.col("before") + F.col("nth")).alias("rank"))
    carried = [c for c in found.columns if c not in ("nth", "task")]
    names = [*carried, "sequence_id", "offset"]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, nth = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            run = np.searchsorted(starts, size * _RANKS + nth, "right") - 1
            bin_, slot = np.divmod(nth - rank[run], each[run])
            columns = [batch.column(c) for c in carried]
            columns += [pa.array(sequence[run] + bin_), pa.array(offset[run] + slot * size)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema if f.name in carried)
    return ranked.mapInArrow(put, f"{schema}, sequence_id bigint, offset bigint")


def sequences(docs: DataFrame, **options) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, doc_ids in their order."""
    parts = pack(docs, with_ids=True, **options)
    inside = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id")))  # at most ``capacity`` ids
    whole = parts.groupBy("sequence_id").agg(inside.alias("parts"))
    return whole.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"))
