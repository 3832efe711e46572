"""Session settings the library relies on, and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply runtime settings; sizes (partitions, memory) are the session builder's."""
    for name, value in _SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder serves a single-machine session; on a cluster other
    machines would not see it, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{scratch_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def settle(df: DataFrame, label: str = "settled", path: str | None = None, codec: str = "snappy", options: dict[str, object] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder (to ``path``, where one is given; with the writer's ``options``) and read it back.

    Cuts lineage and pins values that would differ if recomputed (partition ids,
    generated ids), and survives the loss of executors because the rows are in files.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, label)
    df.write.mode("overwrite").options(compression=codec, **(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def side_by_side(jobs: list[Callable[[], object]], at_once: int = 8) -> list[object]:
    """Run independent jobs at the same time, so that small ones do not leave executors idle."""
    with ThreadPoolExecutor(max_workers=at_once) as pool:
        return [f.result() for f in [pool.submit(j) for j in jobs]]
