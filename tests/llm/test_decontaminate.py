import random

from motorlake.llm import decontaminate
from tests.llm.conftest import DOCS, rows, words


def shingles(text, n=5):
    import regex

    w = regex.findall(r"[\p{L}\p{M}\p{N}]+", (text or "").lower())
    return w, {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_against_brute_force(spark):
    rnd = random.Random(3)
    items = [words(rnd, n, 3000) for n in (1, 3, 5, 14, 40, 200)] + ["", None, "!!!"]
    items.append(items[4])
    texts = [None, "", words(rnd, 20_000, 3000)]
    for it in items[:6]:
        parts = it.split(" ")
        texts += [words(rnd, 50) + " " + it.upper() + ", " + words(rnd, 50), it]
        broken = parts[:]
        broken[len(parts) // 2] = "other"
        texts += [words(rnd, 10) + " " + " ".join(broken), " ".join(parts[: max(1, int(len(parts) * 0.85))])]
    texts += texts[3:5]
    docs = spark.createDataFrame(rows(texts), DOCS)
    bench = spark.createDataFrame([(k if k != 3 else None, t, "x") for k, t in enumerate(items)], "item_id long, text string, item string")
    want = set()
    for d, t in enumerate(texts):
        for k, it in enumerate(items):
            w, _ = shingles(it)
            n = min(5, len(w))
            if not n:
                continue
            need, have = shingles(it, n)[1], shingles(t, n)[1]
            if len(need & have) * 10 >= 8 * len(need):
                want.add((d, k if k != 3 else None, len(need & have), len(need)))
    got = decontaminate.contaminated(docs, bench)
    found = [(r.doc_id, r.item_id, r.shared, r.n_shingles) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {d for d, *_ in want}


def test_blocks_give_the_same(spark, monkeypatch):
    rnd = random.Random(5)
    items = [words(rnd, 30, 3000) for _ in range(9)]
    docs = spark.createDataFrame([(k, words(rnd, 40, 3000) + " " + t + " " + items[0]) for k, t in enumerate(items)], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_ROWS", 20)
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert found == {(k, k) for k in range(9)} | {(k, 0) for k in range(9)}


def test_phrase_that_many_items_share(spark):
    rnd = random.Random(6)
    phrase = "which of the following is the"
    items = [phrase + " " + words(rnd, 12, 3000) for _ in range(40)]
    texts = [phrase + " " + words(rnd, 30, 3000), *[words(rnd, 9) + " " + items[k] for k in (3, 3, 17)], " ".join(items)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = set()
    for d, t in enumerate(texts):
        have = shingles(t)[1]
        want |= {(d, k) for k, it in enumerate(items) if 10 * len(have & shingles(it)[1]) >= 8 * len(shingles(it)[1])}
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == want
    assert len(want) >= 43


def test_empty_tables(spark, awkward, nothing):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.contaminated(awkward, none).count() == 0
    assert decontaminate.contaminated(nothing, some).count() == 0
    assert decontaminate.drop_contaminated(awkward, none).count() == awkward.count()
