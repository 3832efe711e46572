from collections import Counter

from pyspark.sql import functions as F

from motorlake.llm import exact_dedup
from motorlake.session import scratch_path


def expected(pairs):
    groups = {}
    for i, t in pairs:
        groups.setdefault(t or "", []).append(i)
    return {t: (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


def check(docs, **options):
    pairs = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = expected(pairs)
    got = exact_dedup.exact_duplicates(docs, **options).collect()
    assert len(got) == len(pairs)
    sizes = Counter((r.keep_id, r.group_size) for r in got)
    assert sizes == Counter(x for t, x in want.items() for _ in range(x[1]))
    assert sum(r.kept for r in got) == len(want)  # one row of each text, also among repeated rows
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_awkward_rows(awkward):
    check(awkward)


def test_equal_digests_are_not_equal_texts(awkward):
    check(awkward, digest=lambda t: F.unhex(F.lpad(F.hex(F.length(t) % 3), 4, "0")))


def test_small_batches_give_the_same(awkward):
    check(awkward, bytes_per_batch=1)


def test_state_outlives_a_run(spark):
    log_path, state = scratch_path(spark, "log"), scratch_path(spark, "state")
    first = spark.createDataFrame([(b"a", 1, "f", 0), (b"b", 2, "f", 1)], "digest binary, doc_id long, file string, row long")
    first.write.parquet(log_path)
    log = spark.read.parquet(log_path)
    exact_dedup.stream_decisions(log, log_path, state, 1 << 20)
    spark.createDataFrame([(b"a", 9, "g", 0)], first.schema).write.mode("append").parquet(log_path)
    now = {bytes(r.digest): (r.stays.doc_id, r.seen) for r in exact_dedup.stream_decisions(log, log_path, state, 1 << 20).collect()}
    assert now == {b"a": (9, 2), b"b": (2, 1)}


def test_second_run_goes_on(spark, tmp_path):
    """Results over two runs are those of all documents so far, also where digests collide, and a repeated run adds nothing."""
    first = [(1, "a"), (2, "b"), (3, "b"), (4, "ccc"), (None, "lonely"), (5, None)]
    second = [(9, "a"), (1, "b"), (7, "ddd"), (8, "new"), (6, ""), (8, "new"), (0, "lonely")]
    places = []
    for k, data in enumerate((first, second)):
        places.append(str(tmp_path / f"in put {k}.parquet"))
        spark.createDataFrame(data, "doc_id long, text string").repartition(2).write.parquet(places[-1])
    all_rows = expected(first + second)
    for digest in (exact_dedup.sha256, lambda t: F.unhex(F.lpad(F.hex(F.length(t) % 3), 4, "0"))):
        state = scratch_path(spark, "state")
        runs = [exact_dedup.exact_duplicates(spark.read.parquet(p), state_path=state, digest=digest).collect() for p in (places[0], places[1], places[1])]
        assert len(runs[0]) == len(first)
        for run in runs[1:]:
            assert sorted((r.doc_id, r.keep_id, r.group_size) for r in run) == sorted((i, *all_rows[t or ""]) for i, t in second)
            assert sum(r.kept for r in run) == 5  # one of each text but "b", whose largest id came first


def test_filter_and_empty(awkward, nothing):
    kept = exact_dedup.drop_exact_duplicates(awkward)
    assert kept.columns == awkward.columns
    assert kept.count() == awkward.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert exact_dedup.exact_duplicates(nothing).count() == 0
