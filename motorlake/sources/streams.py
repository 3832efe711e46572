"""Event stream sources: Kafka where its connector is installed, files otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_kafka(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """Raw messages from the earliest offset; offsets live in the query's checkpoint."""
    df = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .options(**options)
        .load()
    )
    return df.select(
        F.col("value").cast("string").alias("value"),
        F.col("key").cast("string").alias("key"),
        "topic",
        "partition",
        "offset",
        "timestamp",
    )


def read_json_files(
    spark: SparkSession,
    directory: str,
    topic: str,
    files_per_trigger: int = 1000,
    archive: str | None = None,
    delete: bool = False,
) -> DataFrame:
    """One message per line.  Consumed files may be archived or deleted by the source."""
    reader = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_trigger)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    elif delete:
        reader = reader.option("cleanSource", "delete")
    return reader.load(directory).select(
        "value",
        F.lit(None).cast("string").alias("key"),
        F.lit(topic).alias("topic"),
        F.lit(None).cast("int").alias("partition"),
        F.lit(None).cast("long").alias("offset"),
        F.current_timestamp().alias("timestamp"),
    )


def pending_files(spark: SparkSession, directory: str) -> DataFrame:
    """Number and size of landed files that have not been compacted yet."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet")
        .load(directory)
        .agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
    )
