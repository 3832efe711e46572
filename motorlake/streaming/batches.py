"""Time-ordered operators over the micro-batches of a stream, in event time.

A watermark lies a fixed delay behind the latest event of all earlier batches.  Rows below it come too late:
they are stored and counted, but change no result.  Rows above the new watermark wait in a stored
folder, as earlier ones may still come.  What lies between is complete and goes through the slot
operators, so results are those of the ordered rows, whatever order they arrived in.

All state is files below the batch's number.  A batch reads what its predecessors wrote and overwrites
its own files, so a batch that is run again gives the same result.  What a key carries on is written only
where it changed; every ``WHOLE`` batches the carry is written whole and older files are removed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from motorlake import config
from motorlake.operators.slots import active_time, streak_alerts
from motorlake.session import settle
from motorlake.sources.lake import remove

#: Takes complete rows and the carry; gives what to write and the carry of the keys that were met.
Step = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]
WHOLE = 16


class EventTimeWriter:
    """foreachBatch function; folders below ``path``: out, late, held, carry and clock.

    ``then`` is told the results of each batch and its number, again when a batch is run again.
    """

    def __init__(
        self, path: str, ts: str, step: Step, key: str, carry: str, delay: str = config.LATE_AFTER, whole: int = WHOLE,
        then: Callable[[DataFrame, int], None] | None = None,
    ):
        self.path, self.ts, self.step, self.key, self.carry = path, ts, step, key, carry
        self.delay, self.whole, self.then = delay, whole, then

    def __call__(self, batch: DataFrame, number: int) -> None:
        self._advance(batch, number, final=False)

    def close(self, spark: SparkSession, like: DataFrame) -> None:
        """Give out what still waits, once the source has ended; ``like`` has the columns of the rows."""
        last = spark.read.parquet(f"{self.path}/clock").agg(F.max("batch")).first()[0]
        self._advance(like.limit(0), last + 1, final=True)

    def _part(self, spark: SparkSession, kind: str, number: int) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{kind}/batch={number}")

    def _write(self, rows: DataFrame, kind: str, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{kind}/batch={number}")

    def carried(self, spark: SparkSession, number: int) -> DataFrame:
        """The newest carry of each key before batch ``number``."""
        empty = spark.createDataFrame([], self.carry)
        if number == 0:
            return empty
        since = (number - 1) // self.whole * self.whole
        folders = [f"{self.path}/carry/batch={n}" for n in range(since, number)]
        rows = spark.read.schema(f"{self.carry}, batch int").option("basePath", f"{self.path}/carry").parquet(*folders)
        values = [c for c in empty.columns if c != self.key]
        newest = rows.groupBy(self.key).agg(F.max_by(F.struct(*values), "batch").alias("_v"))
        return newest.select(self.key, *[F.col(f"_v.{c}").alias(c) for c in values])

    def _advance(self, rows: DataFrame, number: int, final: bool) -> None:
        spark, ts = rows.sparkSession, F.col(self.ts).cast("timestamp_ntz")
        seen = self._part(spark, "clock", number - 1).first()["seen"] if number else None
        mark = F.lit(seen).cast("timestamp_ntz") - F.expr(f"interval {self.delay}") if seen is not None else None
        late = ts.isNull() if mark is None else ts.isNull() | (ts < mark)
        rows = rows.withColumn("_late", late)
        if number:
            rows = rows.unionByName(self._part(spark, "held", number - 1).withColumn("_late", F.lit(False)))
        # The batch is read once; its latest time and its late rows are counted as they pass.
        met = Observation()
        rows = settle(rows.observe(met, F.max(ts).alias("newest"), F.count_if("_late").alias("late")), "events")
        newest, n_late = met.get.get("newest"), met.get.get("late", 0)
        late_rows, fresh = rows.where("_late").drop("_late"), rows.where("NOT _late").drop("_late")
        if n_late:
            self._write(late_rows, "late", number)
        else:
            remove(spark, f"{self.path}/late/batch={number}")
        seen = max((t for t in (seen, newest) if t is not None), default=None)
        ready = F.lit(True) if final else ts < F.lit(seen).cast("timestamp_ntz") - F.expr(f"interval {self.delay}")
        self._write(fresh.where(~F.coalesce(ready, F.lit(False))), "held", number)
        before = self.carried(spark, number)
        out, after = self.step(fresh.where(ready), before)
        self._write(out, "out", number)
        if number % self.whole == 0:
            after = after.unionByName(before.join(after.select(self.key), self.key, "left_anti"))
        self._write(after, "carry", number)
        if self.then is not None:
            self.then(spark.read.schema(out.schema).parquet(f"{self.path}/out/batch={number}"), number)
        clock = spark.createDataFrame([(seen,)], "seen timestamp_ntz")
        self._write(clock.coalesce(1), "clock", number)
        if number and (number - 1) % self.whole == 0:  # the whole carry before this batch is known to be complete
            for n in range(max(0, number - 1 - self.whole), number - 1):
                remove(spark, f"{self.path}/carry/batch={n}")
        if number > 1:
            remove(spark, f"{self.path}/held/batch={number - 2}")

    def results(self, spark: SparkSession, schema: str | None = None) -> DataFrame:
        reader = spark.read.schema(schema) if schema else spark.read
        return reader.parquet(f"{self.path}/out").drop("batch")

    def late_rows(self, spark: SparkSession) -> DataFrame:
        """Rows that came too late, with the batch that brought them."""
        held = spark.read.parquet(f"{self.path}/held")
        try:
            return spark.read.schema(held.schema).parquet(f"{self.path}/late")
        except AnalysisException as e:  # none yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return held.limit(0)


def streak_writer(path: str, key: str, ts: str, tie: str, hit: str, kinds: dict[str, str], length: int = config.STREAK_LENGTH, **options) -> EventTimeWriter:
    """Write the events that complete a run of consecutive hits, with all their columns.

    A vehicle's open run comes in as so many hits before its first event.  ``kinds`` are the types of the columns.
    """

    def step(ready: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
        rows = ready.withColumn(hit, F.coalesce(hit, F.lit(False)))
        first = rows.groupBy(key).agg(F.min(ts).alias("_first"))
        held = before.where("n > 0").join(first, key).select(
            key, (F.col("_first") - F.expr("interval 1 second")).cast(kinds[ts]).alias(ts),
            F.explode(F.sequence(F.lit(1).cast("bigint"), "n").cast(f"array<{kinds[tie]}>")).alias(tie), F.lit(True).alias(hit),
        )
        every = rows.unionByName(held, allowMissingColumns=True)
        alerts = streak_alerts(every, key, ts, tie, hit, length).drop("streak")
        last_miss = rows.where(~F.col(hit)).groupBy(F.col(key).alias("_k")).agg(F.max(F.struct(ts, tie)).alias("_miss"))
        runs = every.select(key, ts, tie, hit).join(last_miss, F.col(key) == F.col("_k"), "left")
        open_hits = F.count_if(F.col(hit) & (F.col("_miss").isNull() | (F.struct(ts, tie) > F.col("_miss"))))
        return alerts, runs.groupBy(key).agg((open_hits % length).alias("n"))

    return EventTimeWriter(path, ts, step, key, f"`{key}` {kinds[key]}, n bigint", **options)


def active_seconds_writer(path: str, gap_seconds: int = config.SESSION_GAP_SECONDS, **options) -> EventTimeWriter:
    """Write the increments of operating time per vehicle and day; their sum is the daily time.

    A vehicle's last reading of earlier batches comes in as a reading at rest.
    """

    def step(ready: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
        rows = ready.select("vehicle_id", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "rpm", "seq", F.lit(1).alias("ping"))
        met = rows.groupBy("vehicle_id").agg(F.max("timestamp").alias("last"))
        held = before.join(met.select("vehicle_id"), "vehicle_id", "left_semi").select(
            "vehicle_id", F.col("last").alias("timestamp"), F.lit(0).alias("rpm"), F.lit(None).cast(dict(rows.dtypes)["seq"]).alias("seq"), F.lit(0).alias("ping"),
        )
        daily = active_time(
            rows.unionByName(held).withColumn("_day", F.to_date("timestamp")), ["vehicle_id", "_day"], "timestamp", "seq",
            F.coalesce("rpm", F.lit(0)) > 0, gap_seconds, {"pings": (F.col("ping"), "sum")},
        )
        increments = daily.where("pings > 0").select(
            "vehicle_id", F.unix_date("_day").cast("bigint").alias("day"), F.col("active_micros").cast("bigint").alias("active_micros"), "pings"
        )
        return increments, met

    return EventTimeWriter(path, "timestamp", step, "vehicle_id", "vehicle_id string, last timestamp_ntz", **options)


def run_batches(stream: DataFrame, writer: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Run ``writer`` over what the stream has now."""
    q = stream.writeStream.foreachBatch(lambda batch, number: writer(batch, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
