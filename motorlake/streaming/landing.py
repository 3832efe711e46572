"""Landing valid events and dead letters as files, and compacting what has landed."""

from __future__ import annotations

import threading
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from motorlake import config
from motorlake.operators.dedup import tag_kept
from motorlake.plans import silver
from motorlake.session import settle
from motorlake.streaming.contracts import PARSERS, business_cols, to_dlq


def observed(parsed: DataFrame, name: str = "contract") -> DataFrame:
    """Count valid and rejected events of every micro-batch where the rows pass anyway."""
    return parsed.observe(
        name,
        F.count_if(F.col("_reject").isNull()).alias("valid"),
        F.count_if(F.col("_reject").isNotNull()).alias("rejected"),
    )


class ContractCounts(StreamingQueryListener):
    """Sums the observed counts of all micro-batches of one query, however many there are."""

    def __init__(self):
        self.query = f"landing-{uuid.uuid4().hex[:12]}"
        self.valid = self.rejected = 0
        self.ended = threading.Event()
        self._run = None

    def onQueryStarted(self, event):
        if event.name == self.query:
            self._run = event.runId

    def onQueryProgress(self, event):
        seen = event.progress.observedMetrics.get("contract")
        if event.progress.runId == self._run and seen is not None:
            self.valid += seen["valid"]
            self.rejected += seen["rejected"]

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        if event.runId == self._run:
            self.ended.set()


def _start(
    df: DataFrame, path: str, checkpoint: str, partitions: list[str], now: bool, name: str | None = None
) -> StreamingQuery:
    writer = df.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    if name:
        writer = writer.queryName(name)
    if partitions:
        writer = writer.partitionBy(*partitions)
    writer = writer.trigger(availableNow=True) if now else writer.trigger(processingTime="2 seconds")
    return writer.start(path)


def land_stream(
    messages: DataFrame, kind: str, path: str, checkpoint: str, now: bool = True, name: str | None = None
) -> StreamingQuery:
    """Valid events below year/month/day/hour folders.

    The file sink commits a micro-batch once; offsets and files cannot drift apart.  Rows are
    written where they were read, without a shuffle: a live batch lies in one hour, and all tasks
    share its writing, whatever vehicle is busy.  Compaction merges the files.
    """
    t = F.col("timestamp")
    events = business_cols(observed(PARSERS[kind](messages)), kind).withColumns(
        {
            "year": F.date_format(t, "yyyy"),
            "month": F.date_format(t, "MM"),
            "day": F.date_format(t, "dd"),
            "hour": F.date_format(t, "HH"),
        }
    )
    folders = ["year", "month", "day", "hour"]
    return _start(events, path, checkpoint, folders, now, name)


def dlq_stream(messages: DataFrame, kind: str, path: str, checkpoint: str, now: bool = True) -> StreamingQuery:
    """Rejected messages, one folder per dead-letter topic."""
    return _start(to_dlq(PARSERS[kind](messages)), path, checkpoint, ["_dlq_topic"], now)


def compaction_keys(kind: str) -> dict[str, Column]:
    keys = {"k_vehicle": F.col("vehicle_id"), "k_time": F.col("timestamp")}
    if kind == "diagnostics":
        keys["k_code"] = F.upper("code")
    return keys


def compact(
    batch: DataFrame, existing: DataFrame, kind: str, arrival: list[str], snapshot_date: str | None = None
) -> DataFrame:
    """Tag landed rows: the first of each key is clean unless silver already holds the key.

    ``arrival`` orders the batch and identifies its rows.  With a snapshot date the cleaning
    rules run on the survivors too, so nothing reaches silver that a load would refuse.
    """
    keys = compaction_keys(kind)
    keyed = batch.withColumns(keys)
    first = tag_kept(keyed, list(keys), [F.col(a) for a in arrival], arrival, keep="earliest", flag="_first")
    # the time is part of the key: only silver of the batch's own span can hold it, and the
    # scan skips the rest
    span = batch.agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    low, high = span.select("lo").scalar(), span.select("hi").scalar()
    near = existing.where((F.col("timestamp") >= low) & (F.col("timestamp") <= high))
    held = near.withColumns(keys).select(*keys).distinct()
    held = held.select(*[F.col(k).alias(f"_{k}") for k in keys])
    on = None
    for k in keys:
        same = F.col(k) == F.col(f"_{k}")
        on = same if on is None else on & same
    tagged = first.join(held, on, "left")
    fresh = F.col("_first") & F.col("_k_vehicle").isNull()
    tagged = tagged.withColumn("_fresh", fresh).drop("_first", *keys, *[f"_{k}" for k in keys])
    if snapshot_date:
        tagged = silver.validate(tagged, kind, snapshot_date)
    else:
        tagged = tagged.withColumns(
            {silver.RULE: F.lit(None).cast("string"), silver.REASON: F.lit(None).cast("string")}
        )
    shown = F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.col(k).cast("string")) for k in config.BUSINESS_KEYS[kind]])
    why = F.concat(F.lit("Duplicate record for key ("), shown, F.lit(")"))
    return tagged.withColumns(
        {
            silver.RULE: F.when(~F.col("_fresh"), config.DUPLICATE_RULE).otherwise(F.col(silver.RULE)),
            silver.REASON: F.when(~F.col("_fresh"), why).otherwise(F.col(silver.REASON)),
        }
    ).drop("_fresh")


def _known(spark: SparkSession, path: str, number: int, days: tuple[int, int] | None, like: DataFrame) -> DataFrame:
    """Silver rows of other batches in the folders of the given days; no others are listed into the scan."""
    try:
        rows = spark.read.parquet(path)
    except AnalysisException as e:  # nothing compacted yet
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return like.limit(0)
    low, high = days or (0, 0)
    day = F.col("year") * 10_000 + F.col("month") * 100 + F.col("day")
    return rows.where((F.col("_batch") != number) & day.between(low, high))


def compaction_writer(spark: SparkSession, kind: str, silver_path: str, quarantine_path: str, arrival: list[str]):
    """foreachBatch function: every batch is stored below its own number, so a batch that is
    run again replaces itself instead of adding rows twice.

    The batch is read once and its tags are stored once, before they are split into both outputs.
    """

    def write(batch: DataFrame, number: int) -> None:
        t = F.col("timestamp")
        met = Observation()
        days = F.year(t) * 10_000 + F.month(t) * 100 + F.dayofmonth(t)
        rows = settle(batch.observe(met, F.min(days).alias("low"), F.max(days).alias("high")), "landed")
        span = (met.get["low"], met.get["high"]) if met.get.get("low") is not None else None
        parts = {"year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t), "_batch": F.lit(number)}
        tagged = settle(compact(rows, _known(spark, silver_path, number, span, rows), kind, arrival), "tagged").withColumns(parts)
        clean = tagged.where(F.col(silver.RULE).isNull()).drop(silver.RULE, silver.REASON)
        for part, path in ((clean, silver_path), (tagged.where(F.col(silver.RULE).isNotNull()), quarantine_path)):
            (
                part.write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy(*parts)
                .parquet(path)
            )

    return write


def compact_landed(
    spark: SparkSession, kind: str, landed: str, silver_path: str, quarantine_path: str, archive: str, checkpoint: str, schema: str, arrival: list[str]
) -> None:
    """Compact all landed files that no earlier run has compacted, and archive those whose batch is committed.

    Two phases.  The source's log records which files a batch has; the batch's number names its outputs,
    so a run that stopped in between is repeated without loss or doubles.  Only then are the files
    moved below ``archive``: those of the last batch by the next run, as its commit must be on record first.
    """
    stream = (
        spark.readStream.schema(schema).option("cleanSource", "archive").option("sourceArchiveDir", archive)
        .option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(landed)
    )
    write = compaction_writer(spark, kind, silver_path, quarantine_path, arrival)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def dedup_stream(events: DataFrame, keys: list[str], watermark: str = "1 day", ts: str = "timestamp") -> DataFrame:
    """Continuous first-seen deduplication.  Copies vanish silently, so where they must be kept
    use the compaction above; state is dropped once the watermark has passed."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return timed.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(keys)
