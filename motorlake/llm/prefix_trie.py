"""Prefix trie of conversations by truncation peeling.

A node is a distinct sequence of first turns.  A turn is told by the md5 of its role and text and by
the bytes of its text, 20 bytes together; a conversation's path is these joined, so prefixes of turns are
prefixes of paths.  Equal conversations are one row before the trie is built, however many there are.

Peeling: from the maximum depth downwards, conversations that end at a depth are merged with the nodes that
survived from the depth below; each node found is counted, its last turn is stripped and what is left is
regrouped, so its figures reach its parent.  Nodes are discovered and aggregated in this one pass.  Paths
are dealt by range, so a chunk of neighbouring paths peels alone; nodes on the first and the last path
of a chunk may have members elsewhere: they survive as two rows a chunk and are peeled again with those of
the other chunks, until one chunk is left.  A chunk's size is bounded, whatever prefix is common.

The ids of conversations that end at one node go through its hash in order: blocks of up to 4,096 ids
are gathered first and streamed, so nothing grows with the node but the time of that hash.

Defined results: null role or text is empty; rows of equal turn are ordered by the md5 of
their content, repeated rows are turns of their own; rows without conversation id belong to no conversation.  A conversation without turns ends at
the root.  An empty table has no node, not even a root.  A path must fit in a row (2 GB, 100 million turns).
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from motorlake.llm.rows import column, ship
from motorlake.session import settle

#: Bytes of a turn in a path: its md5 and the length of its text.
STEP = 20
NO_ENDS = hashlib.sha256(b"").hexdigest()
#: Rows and path bytes of a chunk.  It has four rows at least, so that each round leaves fewer.
CHUNK_ROWS, CHUNK_BYTES, LEAST_ROWS = 20_000, 32 << 20, 4
ID_BLOCK_BITS = 12

_FIGURES = {"n": "array<bigint>", "low": "array<bigint>", "leaves": "array<bigint>", "saved": "array<bigint>", "kids": "array<bigint>", "sha": "array<string>"}
_NODE = {
    "depth": "bigint", "conv_id": "bigint", "parent_conv_id": "bigint", "n_convs": "bigint", "n_children": "bigint",
    "n_leaves": "bigint", "saved_tokens": "bigint", "ends_sha256": "string", "own_key": "binary", "parent_key": "binary",
}
_SCHEMA = ", ".join(f"{k} {v}" for k, v in ({"path": "binary"} | _FIGURES | _NODE).items())
_ARROW = pa.schema(
    [("path", pa.binary())]
    + [(k, pa.list_(pa.string() if k == "sha" else pa.int64())) for k in _FIGURES]
    + [(k, pa.string() if v == "string" else pa.binary() if v == "binary" else pa.int64()) for k, v in _NODE.items()]
)


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order, as hexadecimal steps of a path."""
    role, text = (F.coalesce(column(conversations, c).cast("string"), F.lit("")) for c in ("role", "text"))
    step = F.concat(
        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)), F.lpad(F.hex(F.octet_length(text)), 8, "0")
    )
    conv_id = column(conversations, "conv_id").cast("long")
    rows = conversations.where(conv_id.isNotNull()).select(
        conv_id.alias("conv_id"),
        (conv_id - conv_id % 5).alias("family"),
        F.struct(column(conversations, "turn").alias("turn"), step.alias("step")).alias("t"),
    )
    # Dealt once, by family: both later groupings stay within a task.
    return rows.repartition("family").groupBy("family", "conv_id").agg(F.sort_array(F.collect_list("t"))["step"].alias("steps"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id and path of every conversation c after its first h turns became those of c - c % 5; h = crc32(c) % 9."""
    families = turns(conversations).groupBy("family").agg(F.collect_list(F.struct("conv_id", "steps")).alias("members"))
    heads = F.filter("members", lambda m: m["conv_id"] == F.col("family"))
    each = families.select(heads.alias("heads"), F.explode("members").alias("m"))
    h = (F.crc32(F.col("m.conv_id").cast("string")) % 9).cast("int")
    head = F.coalesce(F.get(F.col("heads"), F.lit(0))["steps"], F.array().cast("array<string>"))
    own = F.slice("m.steps", h + 1, F.greatest(F.size("m.steps"), F.lit(1)))
    path = F.unhex(F.array_join(F.concat(F.slice(head, F.lit(1), h), own), ""))
    return each.select(F.col("m.conv_id").alias("conv_id"), path.alias("path"))


def _endings(members: DataFrame) -> DataFrame:
    """Each distinct path as (n, low, sha): its conversations, the smallest, and the hash of their ids in order."""
    block = F.shiftright("conv_id", ID_BLOCK_BITS)
    blocks = members.groupBy(F.unhex(F.md5("path")).alias("key"), block.alias("block")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, n, low = None, hashlib.sha256(), 0, 0
        for batch in chain(batches, [None]):
            done = []
            keys = batch.column("key").to_pylist() if batch else [None]
            ids = batch.column("ids").to_pylist() if batch else [[]]
            for key, block in zip(keys, ids, strict=True):
                if key != at:
                    if at is not None:
                        done.append((n, low, state.hexdigest()))
                    at, state, n, low = key, hashlib.sha256(), 0, block[0] if block else 0
                state.update(("," * (n > 0) + ",".join(map(str, block))).encode())
                n += len(block)
            columns = list(zip(*done, strict=True)) or [()] * 3
            kinds = (pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["n", "low", "sha"])

    return blocks.repartition("key").sortWithinPartitions("key", "block").mapInArrow(stream, "n bigint, low bigint, sha string")


class Node:
    """Figures of one sequence of turns as far as its members have been met."""

    __slots__ = ("n", "low", "leaves", "saved", "kids", "sha", "waiting")

    def __init__(self):
        self.n = self.leaves = self.saved = self.kids = 0
        self.low = self.sha = None
        self.waiting: list[dict] = []

    def add(self, n, low, leaves, saved, kids, sha) -> None:
        self.n += n
        self.leaves += leaves
        self.saved += saved
        self.kids += kids
        self.sha = sha or self.sha
        if low is not None and (self.low is None or low < self.low):
            self.low = low


def peel(rows: list[dict], whole: bool, keyed: bool) -> Iterator[dict]:
    """Nodes of sorted ``rows`` (path, and figures of its last turns), and the rows that survive.

    With ``whole``, these are all rows there are, and none survives; with ``keyed``, nodes are
    told by a key, as their children may be in earlier results.
    """
    first, last = rows[0]["path"], rows[-1]["path"]
    ended = defaultdict(list)
    for row in rows:
        depth = len(row["path"]) // STEP
        for back, figures in enumerate(zip(*(reversed(row[f]) for f in _FIGURES), strict=True)):
            ended[depth - back].append((row["path"][: STEP * (depth - back)], figures))
    nodes: dict[bytes, Node] = {}
    surviving: dict[bytes, Node] = {}
    for depth in range(max(ended), -1, -1):
        for path, figures in ended.pop(depth, ()):
            if path not in nodes:
                nodes[path] = Node()
            nodes[path].add(*figures)
        stripped: dict[bytes, Node] = {}
        for path, node in nodes.items():
            parent = stripped.setdefault(path[:-STEP], Node()) if depth else None
            if not whole and (first.startswith(path) or last.startswith(path)):
                surviving[path] = node
                key = hashlib.md5(path).digest()
                yield from (child | {"parent_key": key} for child in node.waiting)
                continue
            node.leaves += not node.kids
            node.saved += (node.n - 1) * int.from_bytes(path[-4:]) if depth else 0
            yield from (child | {"parent_conv_id": node.low} for child in node.waiting)
            found = {
                "depth": depth, "conv_id": node.low, "n_convs": node.n, "n_children": node.kids, "n_leaves": node.leaves,
                "saved_tokens": node.saved, "ends_sha256": node.sha or NO_ENDS, "own_key": hashlib.md5(path).digest() if keyed else None,
            }
            if parent is None:
                yield found
            else:
                parent.add(node.n, node.low, node.leaves, node.saved, 1, None)
                parent.waiting.append(found)
        nodes = stripped
    if surviving:
        yield _survivor(first, 0, surviving)
        if last != first:
            common = next(d for d in range(len(last) // STEP, -1, -1) if first.startswith(last[: STEP * d]))
            if common < len(last) // STEP:
                yield _survivor(last, common + 1, surviving)


def _survivor(path: bytes, start: int, nodes: dict[bytes, Node]) -> dict:
    on = [nodes[path[: STEP * d]] for d in range(start, len(path) // STEP + 1)]
    return {"path": path} | {f: [getattr(node, f) for node in on] for f in _FIGURES}


def _chunks(batches: Iterable[pa.RecordBatch], most: int | None) -> Iterator[list[dict]]:
    rows, size = [], 0
    for batch in batches:
        for row in batch.to_pylist():
            rows.append(row)
            size += len(row["path"])
            if most and len(rows) >= LEAST_ROWS and (len(rows) >= most or size >= CHUNK_BYTES):
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def _peel_all(dealt: DataFrame, most: int | None, keyed: bool) -> DataFrame:
    """Each task's paths in order, peeled by chunks of ``most`` rows, or as one that is all there is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, most):
            found = []
            for row in peel(chunk, most is None, keyed):
                found.append(row)
                if len(found) >= 5000:
                    yield pa.RecordBatch.from_pylist(found, schema=_ARROW)
                    found = []
            yield pa.RecordBatch.from_pylist(found, schema=_ARROW)

    return settle(dealt.sortWithinPartitions("path").mapInArrow(run, _SCHEMA), "peeled")


def trie(members: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Nodes of the trie of ``members`` (conv_id, unique, and path)."""
    ship(members.sparkSession)
    members = settle(members, "paths")
    ends = _endings(members).withColumnRenamed("low", "conv_id")
    rows = ends.join(members, "conv_id").select(
        "path", F.array("n").alias("n"), F.array("conv_id").alias("low"), *[F.array(F.lit(0).cast("long")).alias(c) for c in ("leaves", "saved", "kids")], F.array("sha").alias("sha")
    )
    found, dealt, most = [], rows.repartitionByRange("path"), chunk_rows
    while True:
        peeled = _peel_all(dealt, most, keyed=bool(found))
        found.append(peeled.where("path IS NULL").select(*_NODE))
        if most is None:
            break
        left = peeled.where("path IS NOT NULL").select("path", *_FIGURES)
        n, size = left.select(F.count("*"), F.coalesce(F.sum(F.length("path")), F.lit(0))).first()
        if n <= LEAST_ROWS or (n <= chunk_rows and size <= CHUNK_BYTES):
            dealt, most = left.repartition(1), None
        else:
            parts = max(-(-n // chunk_rows), -(-size // CHUNK_BYTES))
            dealt = left.repartitionByRange(max(1, min(parts, n // LEAST_ROWS)), "path")
    nodes = found[0]
    for more in found[1:]:
        nodes = nodes.unionByName(more)
    # Children that were finished before their parent learn its smallest member from its key.
    parents = nodes.where("own_key IS NOT NULL").select(F.col("own_key").alias("parent_key"), F.col("conv_id").alias("of"))
    waiting = nodes.where("parent_key IS NOT NULL").join(parents, "parent_key")
    named = waiting.withColumn("parent_conv_id", F.col("of")).select(*_NODE)
    return nodes.where("parent_key IS NULL").unionByName(named).drop("own_key", "parent_key")


def prefix_trie(conversations: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    return trie(rebuilt(conversations), chunk_rows).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )
