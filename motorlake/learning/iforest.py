"""Isolation forest: trees grown in parallel from small samples, scoring in Arrow batches."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from motorlake import config
from motorlake.operators.cumulative import exact_quantiles
from motorlake.session import settle

_NODE = "tree int, node int, heap bigint, feature int, split double, left int, right int, size int, depth int"
#: Path lengths are added up in these units, so that a sum does not depend on its order.
_UNITS = 1e9


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    value = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, value, np.where(n == 2, 1.0, 0.0))


def unit_draw(text: str) -> float:
    """A number in [0, 1) from the md5 of a text; any engine can form it."""
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2.0**52


def _unit(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(2.0**52)


def _grow(features: list[str], seed: int, depth_limit: int):
    """Builder of one tree from its sample (at most a few hundred rows).

    A node's feature and cut are drawn by the seed, the tree and the node's place (root 1, children
    2 k and 2 k + 1), so the tree depends on its sample alone.
    """

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = pdf[features].to_numpy(dtype=float)
        rows: list[list] = []
        todo = [(np.arange(len(x)), 0, 1, None)]
        while todo:
            idx, depth, heap, parent = todo.pop()
            me = len(rows)
            rows.append([tree, me, heap, -1, 0.0, -1, -1, len(idx), depth])
            if parent is not None:
                rows[parent][5 + heap % 2] = me
            part = x[idx]
            low, high = (part.min(axis=0), part.max(axis=0)) if len(idx) else (None, None)
            if depth >= depth_limit or len(idx) <= 1 or not (high > low).any():
                continue
            varying = np.flatnonzero(high > low)
            f = int(varying[int(unit_draw(f"{seed}:{tree}:{heap}:feature") * len(varying))])
            cut = float(low[f] + (high[f] - low[f]) * unit_draw(f"{seed}:{tree}:{heap}:cut"))
            goes_left = part[:, f] <= cut
            rows[me][3], rows[me][4] = f, cut
            todo.append((idx[goes_left], depth + 1, 2 * heap, me))
            todo.append((idx[~goes_left], depth + 1, 2 * heap + 1, me))
        names = ["tree", "node", "heap", "feature", "split", "left", "right", "size", "depth"]
        return pd.DataFrame(rows, columns=names)

    return build


@dataclass
class IsolationForest:
    """Node table plus what scoring needs."""

    nodes: DataFrame
    features: list[str]
    sample: int
    min_raw: float = -1.0
    max_raw: float = 0.0
    threshold: float = 0.5
    _shared: Broadcast | None = field(default=None, repr=False, compare=False)

    def _packed(self) -> Broadcast:
        """The trees as arrays, sent to the executors once for the forest."""
        if self._shared is not None:
            return self._shared
        # at most trees x (2 * sample - 1) small rows, whatever the size of the data
        table = self.nodes.orderBy("tree", "node").toPandas()
        packed = []
        for _, t in table.groupby("tree"):
            leaf = np.rint((average_path(t["size"].to_numpy()) + t["depth"].to_numpy()) * _UNITS).astype(np.int64)
            packed.append(
                (t["feature"].to_numpy(), t["split"].to_numpy(), t["left"].to_numpy(), t["right"].to_numpy(), leaf)
            )
        self._shared = self.nodes.sparkSession.sparkContext.broadcast(packed)
        return self._shared

    def raw_score(self) -> Column:
        """Minus the anomaly score: the lower, the more isolated."""
        shared = self._packed()
        norm = float(average_path(self.sample))
        names = self.features

        @F.pandas_udf("double")
        def score(batch: pd.DataFrame) -> pd.Series:
            x = batch[names].to_numpy(dtype=float)
            total = np.zeros(len(x), dtype=np.int64)
            every = np.arange(len(x))
            for feature, split, left, right, leaf in shared.value:
                at = np.zeros(len(x), dtype=np.int64)
                inner = feature[at] >= 0
                while inner.any():
                    who = every[inner]
                    here = at[who]
                    goes_left = x[who, feature[here]] <= split[here]
                    at[who] = np.where(goes_left, left[here], right[here])
                    inner = feature[at] >= 0
                total += leaf[at]
            mean = total / _UNITS / len(shared.value)
            return pd.Series(-np.power(2.0, -mean / norm))

        return score(F.struct(*[F.col(f).cast("double").alias(f) for f in names]))

    def score(self) -> Column:
        """Raw score on the scale of the training data: 0 nominal, 1 most isolated."""
        width = self.max_raw - self.min_raw
        width = width if width > 1e-9 else 1.0
        scaled = (F.lit(self.max_raw) - self.raw_score()) / F.lit(width)
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled))

    def calibrate(self, df: DataFrame, percentile: float = config.CALIBRATION_PERCENTILE) -> float:
        """Threshold at a percentile of the scores of nominal rows."""
        scored = df.select(self.score().alias("score"))
        self.threshold = exact_quantiles(scored, "score", {"q": percentile / 100.0}).first()["q"]
        return self.threshold

    def calibrate_to_rate(self, df: DataFrame, false_rate: float = 0.02) -> float:
        """Threshold that flags a given share of nominal rows."""
        return self.calibrate(df, (1.0 - false_rate) * 100.0)

    def settings(self) -> dict[str, float]:
        return {
            "sample": float(self.sample),
            "min_raw_score": self.min_raw,
            "max_raw_score": self.max_raw,
            "calibrated_threshold": self.threshold,
        }

    def save(self, path: str) -> None:
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        spark = self.nodes.sparkSession
        rows = [(k, v) for k, v in self.settings().items()]
        spark.createDataFrame(rows, "name string, value double").coalesce(1).write.mode("overwrite").parquet(
            f"{path}/settings"
        )
        spark.createDataFrame(list(enumerate(self.features)), "position int, feature string").coalesce(1).write.mode(
            "overwrite"
        ).parquet(f"{path}/features")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "IsolationForest":
        s = {r["name"]: r["value"] for r in spark.read.parquet(f"{path}/settings").collect()}
        f = [r["feature"] for r in spark.read.parquet(f"{path}/features").orderBy("position").collect()]
        return cls(
            spark.read.parquet(f"{path}/nodes"), f, int(s["sample"]), s["min_raw_score"], s["max_raw_score"],
            s["calibrated_threshold"],
        )


def fit(
    df: DataFrame,
    features: list[str],
    uid: list[str],
    trees: int = config.N_TREES,
    sample: int = config.IFOREST_SAMPLE,
    seed: int = config.SEED,
) -> IsolationForest:
    """Grow ``trees`` trees, each from ``sample`` rows drawn without replacement from all rows.

    Every draw is the md5 of the seed and the row's own key (``uid``, unique), so the forest depends neither
    on partitioning nor on the engine.  All rows are ranked by it once, and the first trees x sample of them
    are the pool, a bounded number; a tree takes the first of the pool by a hash of its own.  Rows
    that cannot be among the first are left out before ranking: twice the pool is expected to stay.
    """
    n = df.count()
    size = min(sample, n)
    wanted = min(n, trees * size)
    key = F.concat_ws("|", *[F.col(u).cast("string") for u in uid])
    rows = df.select(key.alias("_uid"), *[F.col(f).cast("double").alias(f) for f in features])
    hashed = rows.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col("_uid"))))
    near = hashed.where(_unit(F.col("_h")) < min(1.0, 2.0 * wanted / max(n, 1)))
    pool = settle(near.orderBy("_h", "_uid").limit(wanted).drop("_h"), "pool")
    offered = pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    pick = F.md5(F.concat(F.lit(f"{seed}:"), F.col("tree").cast("string"), F.lit(":"), F.col("_uid")))
    order = Window.partitionBy("tree").orderBy("_pick", "_uid")
    samples = offered.withColumn("_pick", pick).withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= size)
    depth = max(1, math.ceil(math.log2(max(2, size))))
    nodes = settle(
        samples.select("tree", *features).groupBy("tree").applyInPandas(_grow(features, seed, depth), _NODE),
        "iforest",
    )
    forest = IsolationForest(nodes, features, size)
    span = df.select(forest.raw_score().alias("r")).agg(F.min("r").alias("lo"), F.max("r").alias("hi")).first()
    forest.min_raw, forest.max_raw = span["lo"], span["hi"]
    return forest
