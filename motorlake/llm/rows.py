"""Row identity, column access and session settings shared by the corpus operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from motorlake.session import settle

#: A row's place: ids may be null or repeated, (file, position in the file) is not.
LOCATOR = T.StructType([T.StructField("file", T.StringType()), T.StructField("row", T.LongType())])


#: Bounds of an Arrow batch: texts are long, and a batch is held on both sides of the pipe.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let the tasks of this application import this package, wherever they run, in small batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp()  # the driver serves the bundle from here as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    bundle = Path(folder, f"{package.name}.zip")
    with zipfile.ZipFile(bundle, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(bundle))
    _shipped.add(context.applicationId)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, lengthened until no column of ``df`` has it (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def column(df: DataFrame, name: str) -> Column:
    return df[f"`{name}`"]


def text_of(df: DataFrame, name: str = "text") -> Column:
    """A text column whose nulls count as empty."""
    return F.coalesce(column(df, name).cast("string"), F.lit(""))


def _place(df: DataFrame) -> Column:
    meta = df.metadataColumn("_metadata")
    return F.struct(meta["file_path"].alias("file"), meta["row_index"].alias("row"))


def located(docs: DataFrame) -> tuple[DataFrame, Column]:
    """``docs`` and the column that holds each row's place in its files.

    Rows that do not come straight from Parquet files are stored in the shared folder first.
    """
    ship(docs.sparkSession)
    try:
        place = _place(docs)
        docs.select(place)
        return docs, place
    except AnalysisException:
        docs = settle(docs, "rows")
        return docs, _place(docs)


def bit_of(row: Column) -> Column:
    """The bit of a row in the word of its 64 neighbours."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(row, F.lit(64)).cast("int"))


def marked(places: DataFrame, marks: dict[str, Column]) -> DataFrame:
    """_file, _word and, for each mark, the bits of the rows that have it: one row for 64 places (columns file, row).

    Stored, so the planner knows that it is small and the documents' texts stay where they are; at sizes it does not
    broadcast, words are joined by shuffle.
    """
    bits = [F.coalesce(F.bit_or(F.when(has, bit_of(F.col("row")))), F.lit(0).cast("long")).alias(name) for name, has in marks.items()]
    return settle(places.groupBy(F.col("file").alias("_file"), F.shiftright("row", 6).alias("_word")).agg(*bits), "marked")


def same_word(place: Column, words: DataFrame) -> Column:
    return (place["file"] == words["_file"]) & (F.shiftright(place["row"], 6) == words["_word"])


def without(docs: DataFrame, place: Column, dropped: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose place is not in ``dropped`` (columns file, row), columns unchanged."""
    at = free_name(docs, "_at")
    gone = marked(dropped, {"_gone": F.lit(True)})
    kept = docs.select("*", place.alias(at))
    bit = gone["_gone"].bitwiseAND(bit_of(kept[at]["row"]))
    return kept.join(gone, same_word(kept[at], gone) & (bit != 0), "left_anti").drop(at)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Runtime settings for the time of a block, put back afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
