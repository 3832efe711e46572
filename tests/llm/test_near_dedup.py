import random
import re

import pytest

from motorlake.llm import components, near_dedup
from tests.llm.conftest import DOCS, edited, rows, words


def sets(texts, n):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        out.append({tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set())
    return out


def classes(ids, shingle_sets):
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(shingle_sets):
        for j in range(i):
            b = shingle_sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for k, i in enumerate(ids):
        least[root(k)] = min(least.get(root(k), i), i)
    return [least[root(k)] for k in range(len(ids))]


def check(docs, n):
    data = [(r.doc_id, r.text) for r in docs.where("doc_id is not null").collect()]
    found = sets([t for _, t in data], n)
    want = {i: (len(s), c) for (i, _), s, c in zip(data, found, classes([i for i, _ in data], found), strict=True)}
    got = near_dedup.near_duplicates(docs, words=n).where("doc_id is not null").collect()
    assert len(got) == len(data)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert {r.doc_id for r in got if r.kept} == {c for _, c in want.values()}


@pytest.mark.parametrize("n", [2, 5])
def test_awkward_rows(awkward, n):
    check(awkward, n)


def test_members_far_from_the_bucket_head(spark):
    """Copies that each link with the original only: no two of them are close enough."""
    rnd = random.Random(9)
    origin = words(rnd, 200, 100_000)
    texts = [edited(rnd, origin, 0.05) for _ in range(60)]
    texts.insert(30, origin)
    chain = [words(rnd, 150, 100_000)]
    for _ in range(15):
        chain.append(edited(rnd, chain[-1], 0.04))
    check(spark.createDataFrame(rows(texts + chain), DOCS), 2)


def test_merged_giant_beside_strays(spark, monkeypatch):
    """A large cluster, exact copies of it, and texts just too far from it, some of which only a late member links."""
    rnd = random.Random(11)
    origin = words(rnd, 120, 100_000)
    cluster = [edited(rnd, origin, 0.03) for _ in range(260)]
    strays = [edited(rnd, origin, 0.16) for _ in range(50)]
    late = [edited(rnd, cluster[k], 0.05) for k in range(0, 40, 4)]
    other = [edited(rnd, strays[0], 0.03) for _ in range(150)]
    docs = spark.createDataFrame(rows(cluster + [cluster[7]] * 90 + strays + late + other), DOCS)
    check(docs, 2)


def test_pairs_below_the_threshold_are_not_confirmed(spark, monkeypatch):
    """All two of a group are nearly alike enough: looking each pair up in full costs the group's square."""
    rnd = random.Random(12)
    origin = words(rnd, 200, 100_000)
    texts = [edited(rnd, origin, 0.05) for _ in range(150)] + [edited(rnd, origin, 0.02) for _ in range(4)]
    looked, confirmed = [], near_dedup.confirmed
    monkeypatch.setattr(near_dedup, "confirmed", lambda pairs, *rest: looked.append(pairs.count()) or confirmed(pairs, *rest))
    check(spark.createDataFrame(rows(texts), DOCS), 2)
    assert sum(looked) < 10 * len(texts)


def test_parity_bounds_the_difference():
    rnd = random.Random(13)
    for n in (0, 1, 30, 3000):
        a, b = ({rnd.randrange(2**64) for _ in range(n)} for _ in range(2))
        b |= set(rnd.sample(sorted(a), n // 2))
        bits = [near_dedup.parity(near_dedup.np.array(sorted(s), near_dedup.np.uint64)).view(near_dedup.np.uint64) for s in (a, b)]
        assert sum(int(x).bit_count() for x in bits[0] ^ bits[1]) <= len(a ^ b)


def test_components(spark):
    rnd = random.Random(2)
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(50)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = root(u), root(v)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}


def test_filter_and_empty(awkward, nothing):
    kept = near_dedup.drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns
    assert kept.count() == near_dedup.near_duplicates(awkward).where("kept").count()
    assert near_dedup.near_duplicates(nothing).count() == 0
