"""Nothing is lost or doubled: feeds, samples, keys and grains."""

import pytest
from pyspark.sql import functions as F

from motorlake.learning import iforest
from motorlake.operators.dedup import tag_kept
from motorlake.operators.slots import non_increasing
from motorlake.plans import actions, facts
from motorlake.plans.dimensions import upsert
from motorlake.session import scratch_root


def test_feed_delivers_a_whole_batch(spark):
    """Twelve actions share one created_at: polls of five give all of them, in order, once."""
    log = spark.createDataFrame([(f"id{k:02d}", "2024-01-20 00:00:00", k) for k in range(12)], "action_id string, created_at string, n int")
    seen, at, last = [], "2024-01-19", None
    while rows := actions.actions_since(log, at, 5, last).collect():
        seen += [r.n for r in rows]
        at, last = rows[-1].created_at, rows[-1].action_id
    assert seen == list(range(12))


def test_trees_draw_from_all_rows(spark):
    """The pool of a hundred trees is 25,600 rows from all of 200,000; every tree takes 256, few rows or many."""
    rows = spark.range(200_000).select("id", F.rand(1).alias("a"), F.col("id").cast("double").alias("b"))
    forest = iforest.fit(rows, ["a", "b"], ["id"], trees=100)
    sizes = forest.nodes.where("depth = 0").select("size").collect()
    assert [r["size"] for r in sizes] == [256] * 100
    # Cuts of the second feature come from its whole range.
    cuts = sorted(r["split"] for r in forest.nodes.where("depth = 0 AND feature = 1").collect())
    assert cuts[0] < 40_000 and cuts[-1] > 160_000
    for n, size in ((1, 1), (2, 2), (300, 256), (700, 256)):
        few = iforest.fit(rows.where(F.col("id") < n), ["a", "b"], ["id"], trees=7)
        assert [r["size"] for r in few.nodes.where("depth = 0").collect()] == [size] * 7


def test_upsert_refuses_a_key_twice(spark):
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "b"), (1, "c")], "k int, v string")
    with pytest.raises(ValueError, match="more than once"):
        upsert(old, new, ["k"])


def test_parts_of_unknown_dealers_keep_the_grain(spark):
    """Two dealers without a dimension row share the key -1; loading twice leaves one row a key."""
    resolved = spark.createDataFrame(
        [("P1", -1, 7, 20240301, 5, 2, "B"), ("P1", -1, 7, 20240301, 9, 3, "B"), ("P1", 4, 7, 20240301, 1, 1, "B")],
        "part_id string, dealer_key long, component_key long, date_key int, stock int, lead_time int, _silver_batch_id string",
    )
    first = facts.number_rows(facts.one_per_key(resolved, "fact_parts"), "fact_parts")
    again = facts.merge_fact(first, resolved, "fact_parts")
    assert sorted((r.dealer_key, r.stock) for r in again.collect()) == [(-1, 9), (4, 1)]


def test_kept_rows_of_hot_and_null_keys(spark):
    rows = [(None, k, k) for k in range(4)] + [("hot", k % 7, 10 + k) for k in range(50)] + [("one", 1, 99)]
    got = tag_kept(spark.createDataFrame(rows, "k string, o int, uid int"), ["k"], [F.col("o")], ["uid"]).where("_kept").collect()
    assert sorted(r.uid for r in got) == [3, 58, 99]
    assert len(got) == 3


def test_order_of_lines_is_not_packed(spark):
    """Parts and suppliers beyond a million still stand in their own order."""
    rows = [(1, 1, 5_000_000_000, 1, "2024-01-05"), (1, 1, 5_000_000_000, 2_000_000, "2024-01-04"), (1, 2, 1, 1, "2024-01-06")]
    df = spark.createDataFrame(rows, "o int, line int, part long, supp long, day string")
    df = df.select("o", "supp", "day", F.struct("line", "part", "supp").alias("position"))
    assert [r.supp for r in non_increasing(df, "o", "day", "position", F.col("position.line")).collect()] == [2_000_000]


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Conf:
        def get(self, name, default=None):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_root(Session())
