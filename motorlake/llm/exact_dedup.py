"""Exact dedup by stateful streaming.

A log of arrivals (digest, stable id, content locator) is written once from the texts and
streamed through a keyed state on disk (RocksDB, no watermark, so nothing ever expires).  The
state holds for each digest the row that stays and the number of rows seen.  A digest is not proof:
every hit is compared with the bytes of the row that stays, fetched through its locator, and texts
that differ in spite of equal digests are grouped by their bytes.

A later run with the same ``state_path`` goes on from there: its documents are added to the log below
that folder, hits are compared with the earlier files, which must still be in their place, and the
results are those of all documents so far, for the rows of this run.  A place (file, row) enters the
log once, so a run that is repeated, whole or after a failure, counts nothing twice.

Defined results: a null text counts as empty, so all null and empty texts are one group.  Of equal
texts the largest id stays; null ids rank below all others, and between rows of one id the larger
locator stays, so exactly one row of a group is kept.  An empty table gives no rows.  Extra columns
are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from motorlake.llm.rows import column, located, settings, text_of, without
from motorlake.session import scratch_path, settle

STATE = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    # A store is closed when its task ends, so that open stores (files, memory) do not grow with partitions.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "300",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _ranked(*names: str) -> Column:
    return F.struct(*[F.col(n) for n in names])


def arrivals(docs: DataFrame, place: Column, id_column: str, text_column: str, digest: Callable[[Column], Column]) -> DataFrame:
    """The log: one narrow row for each document."""
    return docs.select(
        digest(text_of(docs, text_column)).alias("digest"),
        column(docs, id_column).alias("doc_id"),
        place["file"].alias("file"),
        place["row"].alias("row"),
    )


def stream_decisions(log: DataFrame, log_path: str, state_path: str, bytes_per_batch: int) -> DataFrame:
    """Run the log through the keyed state; the newest decision of each digest.

    Each micro-batch writes the digests it touched below its own batch number, so a batch that is
    replayed after a failure overwrites its own output.
    """
    spark = log.sparkSession
    out = f"{state_path}/decisions"
    stream = spark.readStream.schema(log.schema).option("maxBytesPerTrigger", str(bytes_per_batch)).parquet(log_path)
    state = stream.groupBy("digest").agg(
        F.max(_ranked("doc_id", "file", "row")).alias("stays"), F.count(F.lit(1)).alias("seen")
    )

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with settings(spark, STATE):
        run = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", f"{state_path}/state")
            .trigger(availableNow=True)
            .foreachBatch(write)
            .start()
        )
        run.awaitTermination()
    schema = T.StructType([*state.schema.fields, T.StructField("batch", T.LongType())])
    told = spark.read.schema(schema).option("basePath", out).parquet(out)
    newest = told.groupBy("digest").agg(F.max_by(F.struct("stays", "seen"), "batch").alias("d"))
    return newest.select("digest", "d.stays", "d.seen")


def _earlier(spark: SparkSession, log_path: str, schema: T.StructType) -> DataFrame | None:
    """The log of earlier runs, or None in the first one."""
    try:
        return settle(spark.read.schema(schema).parquet(log_path), "earlier")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _contents_elsewhere(hits: DataFrame, new: DataFrame, text_column: str) -> DataFrame:
    """file, row, bytes of the hits whose files are of earlier runs.

    The names of those files are listed in the driver, as those of any scan are.
    """
    spark = hits.sparkSession
    other = hits.select("file", "row").join(new.select("file", "row"), ["file", "row"], "left_anti")
    files = [unquote(r["file"]) for r in other.select("file").distinct().collect()]
    if not files:
        return spark.createDataFrame([], "file string, row long, bytes string")
    docs, place = located(spark.read.option("mergeSchema", "true").parquet(*files))
    rows = docs.select(place["file"].alias("file"), place["row"].alias("row"), text_of(docs, text_column).alias("bytes"))
    return rows.join(other, ["file", "row"], "left_semi")


def exact_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    digest: Callable[[Column], Column] = sha256,
    bytes_per_batch: int = 8 << 30,
    state_path: str | None = None,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest and its place (file, row).

    ``digest`` may be any function of the text: results are the same, as hits are checked by bytes.
    ``bytes_per_batch`` bounds a micro-batch of the log, which holds about 100 bytes a document.
    """
    spark = docs.sparkSession
    docs, place = located(docs)
    state_path = state_path or scratch_path(spark, "dedup")
    log_path = f"{state_path}/arrivals"
    new = arrivals(docs, place, id_column, text_column, digest)
    earlier = _earlier(spark, log_path, new.schema)
    if earlier is None:
        new.write.parquet(log_path)
    else:
        new = settle(new, "arrivals")
        new.join(earlier.select("file", "row"), ["file", "row"], "left_anti").select(*new.columns).write.mode("append").parquet(log_path)
    log = spark.read.schema(new.schema).parquet(log_path)
    decided = stream_decisions(log, log_path, state_path, bytes_per_batch)
    if earlier is not None:  # other digests have no row to report
        touched = new.select("digest").distinct()
        log, decided = log.join(touched, "digest", "left_semi"), decided.join(touched, "digest", "left_semi")

    # Most digests were seen once; only the others travel to the rows.  They are stored first: the
    # adaptive skew join splits a hot digest only where both sides are shuffled for the join.
    several = settle(decided.where("seen > 1").select("digest", "stays"), "several")
    marked = settle(
        log.join(several, "digest", "left").select(
            "*", ((F.col("file") == F.col("stays.file")) & (F.col("row") == F.col("stays.row"))).alias("first")
        ),
        "marked",
    )
    single = marked.where("stays is null").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "digest", "file", "row",
    )

    # Full bytes of all hits and of the rows they hit, found by locator.
    hits = marked.where("stays is not null").select("digest", "doc_id", "file", "row", "first")
    content = docs.select(place["file"].alias("file"), place["row"].alias("row"), text_of(docs, text_column).alias("bytes"))
    if earlier is not None:
        content = content.unionByName(_contents_elsewhere(hits, new, text_column))
    fetched = settle(hits.join(content, ["file", "row"]), "fetched")
    firsts = fetched.where("first").select("digest", F.col("bytes").alias("held"))
    checked = fetched.where("not first").join(firsts, "digest").select(
        "digest", "doc_id", "file", "row",
        (F.col("bytes") != F.col("held")).alias("differs"),
        F.when(F.col("bytes") != F.col("held"), F.col("bytes")).otherwise("").alias("own"),
    ).unionByName(fetched.where("first").select(
        "digest", "doc_id", "file", "row", F.lit(False).alias("differs"), F.lit("").alias("own")
    ))
    key = ["digest", "differs", "own"]
    groups = settle(
        checked.groupBy(*key).agg(F.max(_ranked("doc_id", "file", "row")).alias("stays"), F.count(F.lit(1)).alias("group_size")), "groups"
    )
    grouped = checked.join(groups, key).select(
        "doc_id", F.col("stays.doc_id").alias("keep_id"), "group_size",
        ((F.col("file") == F.col("stays.file")) & (F.col("row") == F.col("stays.row"))).alias("kept"),
        "digest", "file", "row",
    )
    told = single.unionByName(grouped)
    return told if earlier is None else told.join(new.select("file", "row"), ["file", "row"], "left_semi").select(*single.columns)


def drop_exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one row of each text, columns unchanged."""
    docs, place = located(docs)
    return without(docs, place, exact_duplicates(docs, id_column, text_column).where("not kept"))
