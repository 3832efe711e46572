import random

import numpy as np

from motorlake.llm import quality
from tests.llm.conftest import DOCS, words

LABELS = "doc_id long, quality int, toxic int, extra string"


def corpus(rnd, n):
    docs, truth = [], {}
    for k in range(n):
        text, kind = words(rnd, rnd.randrange(30, 200), 900), k % 5
        if kind == 1:
            text = " ".join(w for w in text.split(" ")[:20] for _ in range(6))
        if kind == 2:
            parts = text.split(" ")
            parts[len(parts) // 2] = rnd.choice(["vileness", "vilely", "vilest"])
            text = " ".join(parts)
        docs.append((k, text, "en", f"s{k % 7}", len(text), *["z"] * 12))
        truth[k] = kind in (1, 2)
    return docs, truth


def test_held_out_documents(spark):
    docs, truth = corpus(random.Random(6), 1500)
    labels = [(k, 0 if k % 5 == 1 else 1, int(k % 5 == 2), "x") for k in range(0, 1500) if k % 2 == 0]
    labels += [(4, None, None, "x"), (None, 0, 0, "x"), (3001, 1, 0, "x")]
    frame = spark.createDataFrame(docs, DOCS)
    told = spark.createDataFrame(labels, LABELS)
    got = {r.doc_id: r for r in quality.assess(frame, told).collect()}
    assert len(got) == 1500
    unseen = [k for k in truth if k % 2]
    assert np.mean([got[k].kept for k in unseen if not truth[k]]) > 0.98
    assert np.mean([not got[k].kept for k in unseen if truth[k]]) > 0.95
    kept = quality.drop_rejected(frame, told)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if r.kept}


def test_pseudo_labels_reach_the_other_view(spark):
    """No labelled row has the source "new", but the text view is sure of its documents."""
    rnd = random.Random(2)
    docs = []
    for k in range(900):
        bad = k % 3 == 0
        text = words(rnd, 40, 500) + (" rotten" if bad else "")
        docs.append((k, text, "en", ("new" if k >= 300 else "old") if bad else "good", 100, *["z"] * 12))
    labels = [(k, int(k % 3 != 0), 0, "x") for k in range(0, 300)]
    frame, told = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    alone = {r.doc_id: r.meta_score for r in quality.assess(frame, told, rounds=0).collect()}
    taught = {r.doc_id: r.meta_score for r in quality.assess(frame, told).collect()}
    new = [k for k in range(300, 900) if k % 3 == 0]
    assert np.mean([taught[k] for k in new]) > 0.6 > np.mean([alone[k] for k in new]) + 0.1


def test_awkward_rows(spark, awkward, nothing):
    some = spark.createDataFrame([(k, k % 2, 0, "x") for k in range(0, 40)], LABELS)
    got = quality.assess(awkward, some)
    assert got.count() == awkward.count()
    for labels in (spark.createDataFrame([], LABELS), spark.createDataFrame([(3, 1, 0, "x")], LABELS)):
        out = quality.assess(awkward, labels)
        assert out.where("kept and score is null").count() == awkward.count()
    assert quality.assess(nothing, some).count() == 0
    assert quality.drop_rejected(nothing, some).count() == 0


def test_calibration_and_fit():
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=4000)
    y = (rnd.random(4000) < 1 / (1 + np.exp(-(2 * x - 1)))).astype(float)
    (slope,), shift = quality.logistic(x[:, None], y)
    assert abs(slope - 2) < 0.25 and abs(shift + 1) < 0.2


def test_a_repeated_id_is_fitted_once(spark):
    from motorlake.llm.rows import located

    docs, place = located(spark.createDataFrame([(1, f"copy {k}") for k in range(50)] + [(2, "two"), (3, "three"), (None, "none")], "doc_id long, text string"))
    ids = spark.createDataFrame([(1,), (2,)], "_sampled long")
    assert sorted(r.doc_id for r in quality.one_row_each(docs, place, ids, "doc_id").collect()) == [1, 2]
