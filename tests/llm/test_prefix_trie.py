import hashlib
import random
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import types as T

from motorlake.llm import prefix_trie, sql

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))
from check import compare, duck

CONVERSATIONS = T.StructType(
    [T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]
    + [T.StructField(n, T.StringType()) for n in ("family", "path", "key", "depth", "n", "t")]
)


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [t for *_, t in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
        ends[whole].append(c)
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
    kids, leaves, saved = Counter(), Counter(), Counter()
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    sha = {p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest() for p in members}
    return Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], sha[p]) for p, m in members.items())


def found(df):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return Counter(tuple(r[n] for n in names) for r in df.collect())


def talks(seed, n=400):
    """A hot conversation, hot first turns, one of 300 turns, nulls, ties, repeated rows, turnless rebuilds."""
    rnd, rows = random.Random(seed), []
    for c in range(0, n * 2, rnd.choice([1, 2])):
        kind = rnd.random()
        length = 300 if c == 35 else rnd.randrange(1, 9)
        for turn in range(length):
            text = f"hot {turn}" if kind < 0.35 or (kind < 0.6 and turn < 2) else rnd.choice(["", "é", "yes", "no", f"{rnd.random()}"])
            rows.append((c, turn, ("user", "assistant")[turn % 2], text))
    rows += [(7, None, None, None), (7, None, "user", None), (7, 1, "user", "tie"), (8, 0, None, "é"), (8, 0, None, "é"), (None, 0, "user", "x"), (10**12, 0, "user", "y")]
    rnd.shuffle(rows)
    return [(*r, *["z"] * 6) for r in rows]


@pytest.mark.parametrize("chunk", [6, 20_000])
def test_talks_in_chunks(spark, chunk):
    rows = talks(chunk)
    assert found(prefix_trie.prefix_trie(spark.createDataFrame(rows, CONVERSATIONS), chunk)) == brute(rows)


def test_chunks_of_any_size_give_the_same_nodes():
    rnd = random.Random(3)
    paths = sorted({bytes(b for _ in range(rnd.randrange(7)) for b in [rnd.randrange(3)] * 16 + [0, 0, 0, 5]) for _ in range(300)})
    rows = [{"path": p, "n": [k % 4 + 1], "low": [rnd.randrange(10**6)], "leaves": [0], "saved": [0], "kids": [0], "sha": [f"{k}"]} for k, p in enumerate(paths)]

    def nodes(size):
        at, out, keyed = rows, [], False
        while True:
            whole = len(at) <= 8 if size else True
            parts = [at] if whole else [at[k : k + size] for k in range(0, len(at), size)]
            made = [r for part in parts for r in prefix_trie.peel(part, whole, keyed)]
            out += [r for r in made if "path" not in r]
            if whole:
                break
            at, keyed, size = sorted((r for r in made if "path" in r), key=lambda r: r["path"]), True, size * 10
        names = {r["own_key"]: r["conv_id"] for r in out if r.get("own_key")}
        return Counter((r["depth"], r["conv_id"], r.get("parent_conv_id", names.get(r.get("parent_key"))), *(r[c] for c in ("n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))) for r in out)

    want = nodes(None)
    for size in (1, 2, 5, 40):
        assert nodes(size) == want


def test_no_conversation(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], CONVERSATIONS)).count() == 0


def test_sql_agrees(spark, sf_dir):
    con = duck(sf_dir)
    ok, why, _ = compare(prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")), con, sql.TRIE)
    assert ok, why
