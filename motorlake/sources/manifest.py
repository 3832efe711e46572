"""Change detection for landed files: size and time first, content hash where those differ."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

_SKIP = r"(^\..*)|(\.tmp$)|(\.lock$)"  # fixed values: hidden, temporary and lock files
CHUNK = 8 << 20
MANIFEST = "path string, file_size bigint, modified timestamp, sha256 string, ingestion_batch_id string, processed_at string"


def list_files(spark: SparkSession, directory: str, recursive: bool = True) -> DataFrame:
    """Path, size and time of every file below a directory; no content is read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(directory)
        .select("path", F.col("length").alias("file_size"), F.col("modificationTime").alias("modified"))
    )
    return files.where(~F.element_at(F.split("path", "/"), -1).rlike(_SKIP))


def with_digest(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``files`` with the SHA-256 of their contents, read in chunks in the tasks: a file is never a row, whatever its size."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            found = []
            for path in batch.column("path").to_pylist():
                scheme, rest = path.split(":", 1)
                if scheme == "file":  # with or without an empty host
                    system, name = fs.LocalFileSystem(), "/" + rest.lstrip("/")
                else:
                    system, name = fs.FileSystem.from_uri(quote(path, safe="/:@%"))
                state = hashlib.sha256()
                with system.open_input_stream(name) as source:
                    while block := source.read(chunk):
                        state.update(block)
                found.append(state.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, "sha256"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema)
    return files.repartition("path").mapInArrow(digest, f"{kinds}, sha256 string")


def scan_files(spark: SparkSession, directory: str, recursive: bool = True, manifest: DataFrame | None = None) -> DataFrame:
    """Path, size, time and SHA-256 of every file.  With a manifest, files of the recorded size and time keep the
    recorded hash and are not read.
    """
    files = list_files(spark, directory, recursive)
    if manifest is None:
        return with_digest(files)
    known = manifest.select("path", "file_size", "modified", "sha256")
    same = files.join(known, ["path", "file_size", "modified"])
    return same.unionByName(with_digest(files.join(known, ["path", "file_size", "modified"], "left_anti")))


def changed_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Every scanned file with ``is_changed``: unseen, or of another size or hash."""
    known = manifest.select(
        F.col("path").alias("_path"), F.col("file_size").alias("_size"), F.col("sha256").alias("_sha")
    )
    same = (F.col("_size") == F.col("file_size")) & (F.col("_sha") == F.col("sha256"))
    return files.join(known, files["path"] == known["_path"], "left").select(
        "path", "file_size", "modified", "sha256", (~F.coalesce(same, F.lit(False))).alias("is_changed")
    )


def record_processed(manifest: DataFrame, files: DataFrame, batch_id: str, processed_at: str) -> DataFrame:
    """The manifest after a batch: processed files replace their earlier entries."""
    done = files.select(
        "path", "file_size", "modified", "sha256", F.lit(batch_id).alias("ingestion_batch_id"), F.lit(processed_at).alias("processed_at")
    )
    return manifest.join(done.select("path"), "path", "left_anti").unionByName(done, allowMissingColumns=True)


def empty_manifest(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], MANIFEST)


def read_changed(changed: DataFrame, read: Callable[[list[str]], DataFrame]) -> DataFrame | None:
    """The rows of changed files only, or None where no file changed.

    The paths go through the driver, as a reader's list of files does anyway.
    """
    paths = [r["path"] for r in changed.where("is_changed").select("path").collect()]
    return read(paths) if paths else None
