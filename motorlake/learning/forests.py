"""Random forests: breakdown risk and service demand with intervals."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from motorlake import config
from motorlake.session import scratch_path


def balanced_weights(df: DataFrame, label: str = "target") -> DataFrame:
    """Weight n / (2 * rows of the class), so both classes count the same."""
    y = F.col(label)
    n = df.agg(F.count("*").alias("x")).scalar()
    ones = df.agg(F.sum(y).alias("x")).scalar()
    return df.withColumn("weight", F.when(y == 1, n / (2.0 * ones)).otherwise(n / (2.0 * (n - ones))))


def fit_failure_risk(df: DataFrame, trees: int = config.N_TREES, seed: int = config.SEED) -> PipelineModel:
    forest = RandomForestClassifier(
        labelCol="target", featuresCol="features", weightCol="weight", numTrees=trees,
        maxDepth=config.FAILURE_DEPTH, seed=seed,
    )
    assembler = VectorAssembler(inputCols=config.FAILURE_FEATURES, outputCol="features")
    fitted = Pipeline(stages=[assembler, forest]).fit(balanced_weights(df))
    # Stored and read again: the fitted classifier carries its training summary, and with it the session, which
    # cannot be sent to tasks once an observation has run in it.
    path = scratch_path(df.sparkSession, "risk-model")
    fitted.write().save(path)
    return PipelineModel.load(path)


def score_failure_risk(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds ``risk_score``, the probability of a breakdown."""
    return (
        model.transform(df)
        .withColumn("risk_score", vector_to_array("probability")[1])
        .drop("features", "rawPrediction", "probability", "prediction")
    )


def fit_demand(df: DataFrame, trees: int = config.N_TREES, seed: int = config.SEED) -> PipelineModel:
    forest = RandomForestRegressor(
        labelCol="service_count", featuresCol="features", numTrees=trees, maxDepth=config.DEMAND_DEPTH,
        seed=seed, leafCol="leaves",
    )
    assembler = VectorAssembler(inputCols=config.DEMAND_FEATURES, outputCol="features")
    return Pipeline(stages=[assembler, forest]).fit(df)


def leaf_table(model: PipelineModel, path: str, spark: SparkSession) -> DataFrame:
    """Leaf predictions of the stored forest: tree, and its values in leaf order."""
    model.stages[-1].write().overwrite().save(path)
    leaves = spark.read.parquet(f"{path}/data").where(F.col("nodeData.leftChild") < 0)
    by_tree = leaves.groupBy(F.col("treeID").alias("tree")).agg(
        F.sort_array(F.collect_list(F.struct("nodeData.id", "nodeData.prediction"))).alias("leaves")
    )
    return by_tree.select("tree", F.col("leaves.prediction").alias("values"))


def _leaf_values(model: PipelineModel, path: str, df: DataFrame) -> Column:
    """All leaf values as one array by tree and leaf: a scalar subquery, so the plan does not grow with the forest.

    At most trees x 2^depth numbers, independent of the data.
    """
    trees = leaf_table(model, path, df.sparkSession)
    return trees.agg(F.sort_array(F.collect_list(F.struct("tree", "values")))["values"].alias("v")).scalar()


def predict_interval(model: PipelineModel, df: DataFrame, path: str) -> DataFrame:
    """Point forecast (mean of the trees) and the 10th to 90th percentile across trees.

    One pass gives the leaf of every tree; each leaf's value comes from the node table.
    """
    leaf_values = _leaf_values(model, path, df)
    scored = model.transform(df).withColumn("_leaf", vector_to_array("leaves"))
    per_tree = F.zip_with(F.col("_leaf"), F.col("_values"), lambda i, values: values[i.cast("int")])
    spread = scored.withColumn("_values", leaf_values).withColumn("_trees", F.array_sort(per_tree))
    n = F.size("_trees")

    def percentile(p: float) -> Column:
        position = (n - 1) * F.lit(p)
        low = F.floor(position).cast("int")
        a, b = F.col("_trees")[low], F.col("_trees")[F.least(low + 1, n - 1)]
        return a + (b - a) * (position - low)

    mean = F.aggregate("_trees", F.lit(0.0), lambda acc, v: acc + v) / n
    floor0 = lambda c: F.greatest(F.lit(0.0), c)
    return spread.withColumns(
        {
            "predicted_volume": floor0(mean),
            "lower_bound_80": floor0(percentile(0.10)),
            "upper_bound_80": floor0(percentile(0.90)),
        }
    ).drop("features", "leaves", "prediction", "_leaf", "_values", "_trees")


def predict_demand(model: PipelineModel, df: DataFrame) -> DataFrame:
    return (
        model.transform(df)
        .withColumn("predicted_volume", F.greatest(F.lit(0.0), "prediction"))
        .drop("features", "leaves", "prediction")
    )
