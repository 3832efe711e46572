import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from motorlake.llm import anchors, repeats
from tests.llm.conftest import DOCS, edited, rows, words


def brute(texts, width):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[s : s + width] for b in data for s in range(len(b) - width + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - width + 1):
            if seen[b[s : s + width]] > 1:
                gone[s : s + width] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + (gone[0] if len(b) else 0))
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("width", [200, 64])
def test_against_brute_force(spark, width):
    rnd = random.Random(width)
    base = [words(rnd, n, 9000) for n in (20, 60, 400, 1500)]
    passages = [words(rnd, 40, 9000) for _ in range(4)]
    texts = [None, "", "x" * 199, "y" * 1000, "y" * 1000 + "z", "ab" * 500, *base, base[0], base[2] + "!"]
    texts += [edited(rnd, base[2], 0.02) for _ in range(6)]
    texts += [words(rnd, rnd.randrange(3, 40), 9000) + p[: rnd.randrange(150, len(p))] + words(rnd, rnd.randrange(3, 40), 9000) for p in passages * 5]
    texts += [base[1][k : k + 203] for k in range(0, 40, 7)] + [passages[0] * 3, "é" * 120, "ü" + "é" * 120]
    got = repeats.remove_repeats(spark.createDataFrame(rows(texts), DOCS), width).collect()
    want = brute(texts, width)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == dict(enumerate(want))
    assert sum(w[1] for w in want) > 3000


def test_segments_of_long_texts(monkeypatch, spark):
    rnd = random.Random(7)
    long = words(rnd, 9000, 9000)
    texts = [long, long[13_000:], words(rnd, 50) + long[20_000:31_000]]
    whole = [(r.doc_id, r.n_removed, r.kept_sha256) for r in repeats.remove_repeats(spark.createDataFrame(rows(texts), DOCS)).collect()]
    data = np.frombuffer(long.encode(), np.uint8)
    one = anchors.anchors(data, 200)
    monkeypatch.setattr(anchors, "SEGMENT", 5000)
    cut = anchors.anchors(data, 200)
    assert one[3].sum() == cut[3].sum() == len(data) - 199
    assert sorted(whole) == sorted((k, w[1], w[3]) for k, w in enumerate(brute(texts, 200)))


def test_repeated_rows_and_empty(awkward, nothing):
    got = repeats.remove_repeats(awkward)
    assert got.count() == awkward.count()
    assert repeats.remove_repeats(nothing).count() == 0
