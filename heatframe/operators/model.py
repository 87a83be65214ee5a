"""Boosted-tree training and scoring with Spark MLlib."""

from __future__ import annotations

import random

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heatframe.functions.scalar import hash_bucket
from heatframe.operators.boosting import fit_cells, search_cells
from heatframe.operators.evaluate import average_precision
from heatframe.operators.ordered import running_totals, with_bins

SEED = 42
# Rows from which a regression is grown from cells. MLlib's passes over fewer take little more than their jobs, and splits that part
# few rows alike, of which its rounding chooses one, are more common there.
LEAST_ROWS = 200_000
SEARCH_ROWS = 1_000_000  # rows of a search that are sent to every task
# Whether the adaptive plan may coalesce the partitions of rows that are kept, as it does with others.
KEPT_PARTITIONS = "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning"


def hash_split(df: DataFrame, key: str, train_pct: int = 80) -> DataFrame:
    """Adds ``is_train`` by a hash of the row key: the same row always lands on the same
    side, whatever the partitioning."""
    return df.withColumn("is_train", hash_bucket(F.col(key)) < train_pct)


def time_split(df: DataFrame, ts: str, test_from: str) -> DataFrame:
    return df.withColumn("is_train", F.col(ts) < F.lit(test_from).cast("timestamp_ntz"))


def assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error")


class RegressionPipeline(Pipeline):
    """Assembler and boosted trees. From ``least_rows`` rows on, the trees are grown from the cells of the rows' bins instead of
    by MLlib's pass over the rows for each level of each tree; the model is the same but for rounding. Fits that
    ``fit_cells`` leaves to MLlib are its own.
    """

    least_rows = LEAST_ROWS

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        assemble, gbt = self.getStages()
        model = fit_cells(dataset, assemble.getInputCols(), gbt.getLabelCol(), gbt, self.least_rows)
        return super()._fit(dataset) if model is None else PipelineModel([assemble, model])


def regression_pipeline(features: list[str], label: str, **params) -> Pipeline:
    """Boosted-tree regression; ``params`` are GBTRegressor parameters."""
    settings = {"maxIter": 100, "stepSize": 0.05, "maxDepth": 4, "minInstancesPerNode": 10, "subsamplingRate": 0.8}
    gbt = GBTRegressor(featuresCol="features", labelCol=label, predictionCol="pred", seed=SEED, **{**settings, **params})
    return RegressionPipeline(stages=[assembler(features), gbt])


def fit_regression(train: DataFrame, features: list[str], label: str, **params) -> PipelineModel:
    """Trains on ``train``. MLlib reads the rows for their number, for the splits and for its own points; they are computed
    once, and kept on disk for the time of the fit, so that memory is left to the points. They keep the partitions that
    MLlib would read without that, as its samples depend on them."""
    conf = train.sparkSession.conf
    before = conf.get(KEPT_PARTITIONS)
    conf.set(KEPT_PARTITIONS, "true")
    try:
        rows = train.select(*features, label).persist(StorageLevel.DISK_ONLY)
    finally:
        conf.set(KEPT_PARTITIONS, before)
    try:
        return regression_pipeline(features, label, **params).fit(rows)
    finally:
        rows.unpersist()


# Search ranges of the regression (low, high).
SEARCH = {
    "maxIter": (300, 1500),
    "stepSize": (0.01, 0.15),
    "maxDepth": (2, 6),
    "minInstancesPerNode": (5, 30),
    "subsamplingRate": (0.6, 1.0),
}


def sampled_grid(gbt: GBTRegressor, trials: int, ranges: dict[str, tuple] = SEARCH, seed: int = SEED) -> list[dict]:
    """``trials`` random parameter sets; the step size is drawn on a log scale."""
    rng = random.Random(seed)

    def draw(name: str, low, high):
        if name == "stepSize":
            return low * (high / low) ** rng.random()
        return rng.randint(low, high) if isinstance(low, int) else rng.uniform(low, high)

    return [{gbt.getParam(n): draw(n, *r) for n, r in ranges.items()} for _ in range(trials)]


def tune_regression(
    df: DataFrame, features: list[str], label: str, trials: int = 100, folds: int = 5, parallelism: int = 4,
    ranges: dict[str, tuple] = SEARCH,
) -> tuple[PipelineModel, DataFrame]:
    """(best model, (trial, mae, parameters) table) by cross-validated mean absolute error.

    The rows are computed once and kept on disk for the time of the search: all folds are drawn from the same ones. Up to
    ``SEARCH_ROWS`` rows are sent to tasks that make whole fits; of more, ``parallelism`` fits run side by side, each over the cluster.
    """
    pipeline = regression_pipeline(features, label)
    assemble, gbt = pipeline.getStages()
    grid = sampled_grid(gbt, trials, ranges)
    kept = df.select(*features, label).persist(StorageLevel.DISK_ONLY)
    try:
        found = search_cells(kept, features, label, [gbt.copy(params) for params in grid], folds, SEARCH_ROWS)
        if found:
            errors, model = found
            best = PipelineModel([assemble, model])
        else:
            search = CrossValidator(
                estimator=pipeline, estimatorParamMaps=grid, numFolds=folds, parallelism=parallelism, seed=SEED,
                evaluator=RegressionEvaluator(labelCol=label, predictionCol="pred", metricName="mae"),
            ).fit(kept)
            errors, best = search.avgMetrics, search.bestModel
    finally:
        kept.unpersist()
    rows = [
        (n, float(mae), {p.name: float(v) for p, v in params.items()})
        for n, (mae, params) in enumerate(zip(errors, grid))
    ]
    table = df.sparkSession.createDataFrame(rows, "trial int, mae double, parameters map<string, double>")
    return best, table


def with_class_weight(train: DataFrame, label: str) -> DataFrame:
    """Adds ``weight``: negatives per positive on positive rows, 1 elsewhere."""
    balance = train.agg(F.sum(1 - F.col(label)).alias("neg"), F.sum(label).alias("pos")).first()
    ratio = balance["neg"] / balance["pos"] if balance["pos"] else 1.0
    return train.withColumn("weight", F.when(F.col(label) == 1, F.lit(float(ratio))).otherwise(F.lit(1.0)))


def classification_pipeline(features: list[str], label: str, **params) -> Pipeline:
    """Weighted boosted trees; early stopping on the rows marked ``is_validation``."""
    settings = {
        "maxIter": 500, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8",
        "minInstancesPerNode": 1, "validationTol": 0.001,
    }
    gbt = GBTClassifier(
        featuresCol="features", labelCol=label, weightCol="weight", validationIndicatorCol="is_validation",
        predictionCol="mllib_pred", seed=SEED, **{**settings, **params},
    )
    return Pipeline(stages=[assembler(features), gbt])


def fit_classifier(train: DataFrame, features: list[str], label: str, key: str, **params) -> PipelineModel:
    """Trains on ``train``; a tenth of it, chosen by key hash, only stops the boosting
    (the test rows are never used for that). The rows are kept for the time of the fit,
    which reads them once for the weight and again for every tree."""
    held_out = hash_bucket(F.col(key)) < 10
    rows = train.select(*features, F.col(label).cast("double").alias(label), held_out.alias("is_validation")).persist()
    try:
        return classification_pipeline(features, label, **params).fit(with_class_weight(rows, label))
    finally:
        rows.unpersist()


def score(model: PipelineModel, df: DataFrame, cut: float = 0.5) -> DataFrame:
    """Adds ``prob`` and ``pred``; the rows keep truth and features, so nothing is joined."""
    scored = model.transform(df).withColumn("prob", vector_to_array("probability")[1])
    helper = ["features", "rawPrediction", "probability", "mllib_pred"]
    return scored.withColumn("pred", (F.col("prob") >= cut).cast("int")).drop(*helper)


def feature_importance(spark: SparkSession, model: PipelineModel, features: list[str]) -> DataFrame:
    """(feature, importance), largest first."""
    weights = model.stages[-1].featureImportances.toArray()
    rows = sorted(((f, float(w)) for f, w in zip(features, weights)), key=lambda x: (-x[1], x[0]))
    return spark.createDataFrame(rows, "feature string, importance double")


def shuffled_columns(df: DataFrame, columns: list[str], key: Column, seed: int = SEED) -> DataFrame:
    """Adds ``_shuffled_{c}``: the columns of another row, the next one in the order of a
    hash of ``key``; the last row takes the first one's. Rows are numbered by bin totals,
    so the donors depend on the keys alone and no task holds them all."""
    hashed = df.withColumns({"_hash": F.xxhash64(key, F.lit(seed)), "_key": key, "_one": F.lit(1).cast("long")})
    placed = running_totals(with_bins(hashed, "_hash"), [], ["_hash", "_key"], ["_one"])
    own = placed.withColumn("_place", F.col("_one_before"))
    donors = placed.select(
        F.pmod(F.col("_one_before") - 1, F.col("_one_total")).alias("_place"), F.struct(*columns).alias("_donor")
    )
    return own.join(donors, "_place").select(
        *df.columns, *[F.col(f"_donor.{c}").alias(f"_shuffled_{c}") for c in columns]
    )


def permutation_importance(model: PipelineModel, df: DataFrame, features: list[str], label: str, key: Column) -> DataFrame:
    """(feature, importance): loss of average precision when a feature is shuffled.

    One shuffle serves all features; the rescored copies go through one aggregate.
    """
    wide = shuffled_columns(df, features, key)
    variants = F.array(F.lit("_none"), *[F.lit(f) for f in features])
    copies = wide.withColumn("feature", F.explode(variants)).select(
        label, "feature",
        *[F.when(F.col("feature") == f, F.col(f"_shuffled_{f}")).otherwise(F.col(f)).alias(f) for f in features],
    )
    scored = score(model, copies).select("feature", label, F.round("prob", 9).alias("prob"))
    precision = average_precision(scored, ["feature"], label, "prob")
    # one row per feature from here on
    base = F.max(F.when(F.col("feature") == "_none", F.col("average_precision"))).over(Window.partitionBy())
    loss = precision.select("feature", (base - F.col("average_precision")).alias("importance"))
    return loss.where(F.col("feature") != "_none")


def save_model(model: PipelineModel, features: list[str], path: str) -> None:
    """Model and feature list, side by side in the shared folder."""
    model.write().save(f"{path}/model")
    rows = list(enumerate(features))
    SparkSession.active().createDataFrame(rows, "position int, feature string").coalesce(1).write.parquet(f"{path}/features")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, list[str]]:
    rows = spark.read.parquet(f"{path}/features").orderBy("position").collect()
    return PipelineModel.load(f"{path}/model"), [r["feature"] for r in rows]
