import pytest
from pyspark.sql import functions as F

from motorlake.llm import mixing, rows


@pytest.fixture
def docs(spark, tmp_path):
    spark.range(0, 60_000, 1, 3).select(F.col("id").alias("doc_id"), F.concat(F.lit("w "), F.sha2(F.col("id").cast("string"), 256)).alias("text"), F.lit("a").alias("source")).write.parquet(str(tmp_path / "d"))
    return spark.read.parquet(str(tmp_path / "d"))


def test_texts_are_not_shuffled_to_lists_of_places(spark, docs):
    with rows.settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "40k"}):
        docs, place = rows.located(docs)
        gone = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
        kept = rows.without(docs, place, docs.where(gone).select(place["file"].alias("file"), place["row"].alias("row")))
        assert "Exchange hashpartitioning" not in kept._jdf.queryExecution().executedPlan().toString()
        assert kept.columns == docs.columns
        assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in docs.where(~gone).select("doc_id").collect()}
        mixed = mixing.emit_mix(docs)
        assert "Exchange hashpartitioning" not in mixed._jdf.queryExecution().executedPlan().toString()
        assert mixed.select("doc_id").distinct().count() == mixed.count() == 60_000
