"""The stored action log: a keyed append that can be repeated, batch by batch, and reads by trigger date.

Rows lie below trigger_date, source and batch.  An idempotency key holds its trigger time, so a key can only
be known below the dates of the batch: an append reads those folders and no others.  A batch that is
run again does not count its own rows as known and overwrites exactly its own folders.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from motorlake.plans.actions import LOG_SCHEMA, unseen


class ActionLog:
    def __init__(self, path: str):
        self.path = path

    def read(self, spark: SparkSession, first: str | None = None, last: str | None = None) -> DataFrame:
        """Actions whose trigger date lies in the range, with their source and batch."""
        schema = f"{LOG_SCHEMA}, trigger_date date, source string, batch bigint"
        try:
            rows = spark.read.schema(schema).parquet(self.path)
        except AnalysisException as e:  # nothing logged yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return spark.createDataFrame([], schema)
        if first is not None:
            rows = rows.where(F.col("trigger_date") >= F.lit(first).cast("date"))
        if last is not None:
            rows = rows.where(F.col("trigger_date") <= F.lit(last).cast("date"))
        return rows

    def append(self, candidates: DataFrame, source: str, number: int) -> None:
        """Log the unseen candidates of one batch of ``source``; they are stamped with the batch's latest trigger time."""
        spark = candidates.sparkSession
        span = candidates.agg(
            F.min(F.to_date("trigger_timestamp")).cast("string").alias("first"),
            F.max(F.to_date("trigger_timestamp")).cast("string").alias("last"),
            F.date_format(F.max("trigger_timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"),
        ).first()
        if span["first"] is None:
            return
        own = (F.col("source") == source) & (F.col("batch") == number)
        known = self.read(spark, span["first"], span["last"]).where(~own)
        rows = unseen(candidates, known).withColumns(
            {
                "action_id": F.md5("idempotency_key"), "created_at": F.lit(span["at"]), "trigger_date": F.to_date("trigger_timestamp"),
                "source": F.lit(source), "batch": F.lit(number).cast("bigint"),
            }
        )
        folders = ["trigger_date", "source", "batch"]
        columns = [*spark.createDataFrame([], LOG_SCHEMA).columns, *folders]
        rows.select(*columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(self.path)
