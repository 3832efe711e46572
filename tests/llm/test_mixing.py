import re

import pytest

from motorlake.llm import mixing


def targets(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight, with what is above the limit shared again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, out = sum(sizes.values()), set(order), {}
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_awkward_rows(awkward):
    sizes, docs = {}, awkward.select("doc_id", "text", "source").collect()
    for r in docs:
        sizes[r.source] = sizes.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    want = sorted((n, t) for n, t in ((sizes[s], t) for s, t in targets(sizes).items()))
    got = mixing.mix(awkward).collect()
    assert len(got) == len(docs)
    seen = sorted({(r.source_size, r.target) for r in got})
    assert [n for n, _ in seen] == [n for n, _ in want]
    assert [t for _, t in seen] == pytest.approx([t for _, t in want])
    largest = max(r.size for r in got)
    for n, t in seen:
        of = [r for r in got if r.source_size == n]
        assert abs(sum(r.taken for r in of) - t) <= 2 * largest
        assert all(r.taken == r.copies * r.size and 0 <= r.copies <= 3 for r in of)
    again = mixing.mix(awkward.repartition(3)).collect()
    assert sorted((r.size, r.taken) for r in again) == sorted((r.size, r.taken) for r in got)


def test_close_to_target(spark):
    rows = [(k, "w " * (k % 90 + 1), "abc"[k % 3] if k % 2 else "a") for k in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source_size", "target").sum("taken").collect()
    assert len(got) == 3
    assert all(abs(r["sum(taken)"] - r.target) <= 180 for r in got)


def test_emitted_rows_and_empty(awkward, nothing):
    plan = mixing.mix(awkward)
    out = mixing.emit_mix(awkward)
    assert out.columns == awkward.columns
    assert out.count() == plan.groupBy().sum("copies").first()[0]
    assert mixing.mix(nothing).count() == 0 and mixing.emit_mix(nothing).count() == 0
