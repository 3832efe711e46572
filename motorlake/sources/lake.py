"""Raw files, bronze, silver and quarantine storage, and stage measurements."""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from motorlake import config
from motorlake.schemas import raw_text_schema


def read_raw(spark: SparkSession, directory: str, name: str, as_text: bool = True) -> DataFrame:
    """A raw CSV set with a header.  Every row is kept: columns are text until cleaning."""
    schema = raw_text_schema(name)
    return spark.read.schema(schema).option("header", True).csv(f"{directory}/{name}.csv")


def with_audit(
    df: DataFrame, batch_id: str, ingested_at: str, source: str | None = None
) -> DataFrame:
    """Append ingestion time, source file, batch and the row's position in the batch.

    The position is generated once, when bronze is written; file splits are read in order,
    so it follows the row order inside a file.
    """
    file = F.lit(source) if source else F.col("_metadata.file_name")
    return df.withColumns(
        {
            "_ingested_at": F.lit(ingested_at),
            "_source_file": file,
            "_batch_id": F.lit(batch_id),
            "_row_seq": F.monotonically_increasing_id(),
        }
    )


def write_events(df: DataFrame, path: str, ts: str = "timestamp", mode: str = "append") -> None:
    """Hive-partitioned by the year, month and day text of the event time."""
    text = F.col(ts).cast("string")
    parts = df.withColumns(
        {
            "year": F.substring(text, 1, 4),
            "month": F.substring(text, 6, 2),
            "day": F.substring(text, 9, 2),
        }
    )
    _spread(parts, ["year", "month", "day"]).write.mode(mode).partitionBy("year", "month", "day").parquet(path)


def write_snapshot(df: DataFrame, path: str, snapshot_date: str) -> None:
    """One partition per snapshot date; writing a date again replaces only that date."""
    (
        df.withColumn("snapshot_date", F.lit(snapshot_date))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("snapshot_date")
        .parquet(path)
    )


def _spread(df: DataFrame, partitions: list[str]) -> DataFrame:
    """Let AQE rebalance so partition folders get few, evenly sized files; a day holding most
    of the rows is split over several tasks."""
    return df.hint("rebalance", *[F.col(c) for c in partitions])


def read_lake(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Hive-partitioned scan; partition folders stay text so zero padding survives."""
    df = spark.read.option("inferSchema", False).parquet(path)
    return df.select(*columns) if columns else df


def write_silver(
    df: DataFrame, path: str, dataset: str, snapshot_date: str | None = None, rebuild: bool = True
) -> None:
    """Clean rows: events by integer year, month and day, snapshots by snapshot date.

    A rebuild replaces the whole set, so days that the input no longer has go; otherwise only the
    partitions that ``df`` has rows of are replaced.
    """
    if dataset in config.EVENT_DATASETS:
        parts = df.withColumns(
            {"year": F.year("timestamp"), "month": F.month("timestamp"), "day": F.dayofmonth("timestamp")}
        )
        keys = ["year", "month", "day"]
    else:
        if "snapshot_date" not in df.columns:
            df = df.withColumn("snapshot_date", F.lit(snapshot_date))
        parts, keys = df, ["snapshot_date"]
    (
        _spread(parts, keys).write.mode("overwrite")
        .option("partitionOverwriteMode", "static" if rebuild else "dynamic")
        .option("compression", "snappy").partitionBy(*keys).parquet(path)
    )


def write_quarantine(df: DataFrame, path: str) -> None:
    """Rejected rows, raw values verbatim."""
    df.write.mode("append").option("compression", "snappy").parquet(path)


def archive_predictions(df: DataFrame, path: str, written_at: str) -> None:
    """Append predictions below the year and month of the write time."""
    at = F.lit(written_at).cast("timestamp")
    (
        df.withColumns({"year": F.date_format(at, "yyyy"), "month": F.date_format(at, "MM")})
        .write.mode("append")
        .partitionBy("year", "month")
        .parquet(path)
    )


def write_predictions(df: DataFrame, path: str, key: str, day: Column, batch: str) -> DataFrame:
    """Append predictions to the operational table below ``path``, each key once; gives the table.

    Rows lie below _day and _batch.  A key holds its day, so only the batch's own days are read for known keys,
    and a batch that is written again overwrites its own folders and adds nothing.
    """
    spark = df.sparkSession
    rows = df.dropDuplicates([key]).withColumns({"_day": day.cast("date"), "_batch": F.lit(batch)})
    try:
        table = spark.read.schema(rows.schema).parquet(path)
    except AnalysisException as e:  # the first batch
        if "PATH_NOT_FOUND" not in str(e):
            raise
    else:
        low, high = (rows.agg(f("_day").alias("d")).scalar() for f in (F.min, F.max))
        known = table.where(F.col("_day").between(low, high) & (F.col("_batch") != batch)).select(key)
        rows = rows.join(known, key, "left_anti")
    rows.select(*df.columns, "_day", "_batch").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_day", "_batch").parquet(path)
    return spark.read.schema(rows.select(*df.columns, "_day", "_batch").schema).parquet(path)


def write_predictions_jdbc(df: DataFrame, url: str, table: str, batch: int = 2000, **options: str) -> None:
    """The same rows into a database table, where one is wanted."""
    df.write.mode("append").format("jdbc").options(url=url, dbtable=table, batchsize=batch, **options).save()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system its path names; one that is not there is no error."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, name: str, kind: str) -> DataFrame:
    """A model as a view (recomputed) or a table (stored)."""
    spark = df.sparkSession
    if kind == "view":
        df.createOrReplaceTempView(name)
    elif kind == "table":
        df.write.mode("overwrite").format("parquet").saveAsTable(name)
    else:
        raise ValueError(f"unknown materialisation {kind!r}")
    return spark.table(name)


def measured(stage: str, df: DataFrame, path: str) -> dict:
    """Write one stage and report rows, seconds and rows per second, counted in the same job."""
    seen = Observation(stage)
    start = time.perf_counter()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    seconds = time.perf_counter() - start
    rows = seen.get["rows"]
    size = (
        df.sparkSession.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .agg(F.sum("length").alias("bytes"))
        .first()["bytes"]
    )
    return {
        "stage": stage,
        "rows": rows,
        "seconds": seconds,
        "rows_per_second": rows / seconds if seconds else 0.0,
        "bytes": size,
    }
