"""Regressions grown from cells against MLlib's own fits."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from heatframe.operators import boosting as X
from heatframe.operators import model as M

FEATURES = ["a", "b", "c"]


def rows_of(spark, n, parts=3, seed=0):
    """Rows with a few levels, zeros, negative numbers and a continuous feature; kept, as a fit reads them in their order."""
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"a": rng.integers(0, 50, n).astype(float), "b": rng.normal(size=n), "c": np.round(rng.random(n), 1)})
    pdf["y"] = 20.0 + pdf["a"] * np.sin(3 * pdf["b"]) + 5 * pdf["c"] + rng.normal(size=n)
    return spark.createDataFrame(pdf).repartition(parts).cache()


def described(model):
    """(lines without the predicted numbers, those numbers)"""
    lines = model.stages[-1].toDebugString.split("\n")[1:]
    numbers = [float(x) for line in lines for x in re.findall(r"Predict: (.*)", line)]
    return [re.sub(r"Predict: .*", "Predict", line) for line in lines], numbers


def both(rows, monkeypatch, **params):
    """The model of MLlib and that of the cells, which must not leave the fit to MLlib."""
    pipe = M.regression_pipeline(FEATURES, "y", **params)
    plain = Pipeline(stages=pipe.getStages()).fit(rows)
    pipe.least_rows = 0
    with monkeypatch.context() as m:
        m.setattr(M.Pipeline, "_fit", lambda *_: pytest.fail("left to MLlib"))
        return plain, pipe.fit(rows)


# 3,000 rows are read whole for the thresholds, of 12,000 and 40,000 a sample is taken in two ways
@pytest.mark.parametrize("n,params", [
    (3000, {"maxDepth": 3, "subsamplingRate": 1.0}), (12_000, {"maxDepth": 5, "stepSize": 0.3}),
    (40_000, {"maxDepth": 4, "minInstancesPerNode": 300, "maxBins": 20}),
])
def test_cells_give_the_model_of_mllib(spark, monkeypatch, n, params):
    rows = rows_of(spark, n)
    plain, cells = both(rows, monkeypatch, maxIter=6, **params)
    (lines, numbers), (own, given) = described(plain), described(cells)
    assert own == lines and np.allclose(given, numbers, rtol=0, atol=1e-8)
    assert np.allclose(cells.stages[-1].featureImportances.toArray(), plain.stages[-1].featureImportances.toArray(), atol=1e-9)
    assert cells.stages[-1].treeWeights == plain.stages[-1].treeWeights
    gap = plain.transform(rows).select(F.col("pred").alias("p"), "features").join(
        cells.transform(rows).select("pred", "features"), "features").agg(F.max(F.abs(F.col("p") - F.col("pred")))).first()[0]
    assert gap < 1e-8


def test_blocks_and_dealt_cells_give_the_same_model(spark, monkeypatch):
    rows, fits = rows_of(spark, 12_000), []
    monkeypatch.setattr(M.RegressionPipeline, "least_rows", 0)
    for block, chunk in ((X.BLOCK, X.CHUNK_ROWS), (1, 3)):
        monkeypatch.setattr(X, "BLOCK", block)
        monkeypatch.setattr(X, "CHUNK_ROWS", chunk)
        fits.append(described(M.fit_regression(rows, FEATURES, "y", maxIter=10)))
    (lines, numbers), (again, others) = fits
    assert lines == again and np.allclose(numbers, others, rtol=0, atol=1e-8)


def test_jobs_of_a_fit_do_not_grow_with_its_trees(spark, monkeypatch):
    monkeypatch.setattr(M.RegressionPipeline, "least_rows", 0)
    rows, jobs = rows_of(spark, 5000), []
    for trees in (2, 20):
        spark.sparkContext.setJobGroup(f"fit-{trees}", "")
        assert M.fit_regression(rows, FEATURES, "y", maxIter=trees, maxDepth=3).stages[-1].getNumTrees == trees
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fit-{trees}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= jobs[0] + 2 and jobs[0] < 30


def test_fits_that_cells_cannot_do_are_left_to_mllib(spark, monkeypatch):
    rows = rows_of(spark, 3000)

    def fit(df, **params):
        gbt = M.regression_pipeline(FEATURES, "y", **{"maxIter": 2, **params}).getStages()[-1]
        return X.fit_cells(df, FEATURES, "y", gbt, 0)

    assert fit(rows) is not None
    assert X.fit_cells(rows, FEATURES, "y", M.regression_pipeline(FEATURES, "y").getStages()[-1], 3001) is None
    assert fit(rows, lossType="absolute") is None and fit(rows, minInfoGain=0.1) is None and fit(rows, weightCol="c") is None
    for bad in (None, float("nan"), float("inf")):
        assert fit(rows.withColumn("b", F.when(F.col("a") == 7, F.lit(bad)).otherwise(F.col("b")))) is None
    assert fit(rows.limit(0)) is None
    monkeypatch.setattr(X, "MOST_CELLS", 10)
    assert fit(rows) is None


def test_streams_go_on_where_they_ended():
    for sizes in ((1, 63, 64, 65, 1000), (640, 0, 7), (128, 128)):
        whole = X.Streams([7, -3]).draw(sum(sizes))
        parts = X.Streams([7, -3])
        got = np.concatenate([parts.draw(n) for n in sizes], axis=1)
        assert (got == whole).all() and ((whole < X.limit_of(0.7)) == X.Streams([7, -3]).draw(sum(sizes), X.limit_of(0.7))).all()
    drawn = X.doubles(7)
    assert [next(drawn) for _ in range(200)] == (X.Streams([7]).draw(200)[0] * 2.0**-53).tolist()


def test_constant_labels_and_features(spark, monkeypatch):
    rows = rows_of(spark, 3000).select("a", F.lit(1.0).alias("b"), F.lit(0.0).alias("c"), F.lit(5.0).alias("y")).cache()
    plain, cells = both(rows, monkeypatch, maxIter=3)
    assert described(cells) == described(plain) == ([*described(plain)[0]], [5.0, 0.0, 0.0])


SHORT = {"maxIter": (3, 6), "stepSize": (0.1, 0.5), "maxDepth": (2, 4), "minInstancesPerNode": (5, 30), "subsamplingRate": (0.6, 1.0)}


def test_search_from_cells_is_that_of_the_cross_validator(spark, monkeypatch):
    rows, args = rows_of(spark, 12_000), (FEATURES, "y", 6, 2, 2, SHORT)
    monkeypatch.setattr(M, "SEARCH_ROWS", 11_999)
    plain, table = M.tune_regression(rows, *args)
    monkeypatch.setattr(M, "SEARCH_ROWS", 12_000)
    monkeypatch.setattr(M, "CrossValidator", lambda **_: pytest.fail("left to MLlib"))
    best, own = M.tune_regression(rows, *args)
    (lines, numbers), (again, given) = described(plain), described(best)
    assert lines == again and np.allclose(numbers, given, rtol=0, atol=1e-8)
    for a, b in zip(table.orderBy("trial").collect(), own.orderBy("trial").collect(), strict=True):
        assert a["parameters"] == b["parameters"] and abs(a["mae"] - b["mae"]) < 1e-8
    assert best.stages[-1].getMaxIter() == plain.stages[-1].getMaxIter() == best.stages[-1].getNumTrees


def test_search_of_many_trees_ends(spark):
    """300 trees in each of 40 fits; a pass over the rows for each level of each tree would take hours."""
    rows, long = rows_of(spark, 1500), {**SHORT, "maxIter": (300, 300)}
    best, table = M.tune_regression(rows, FEATURES, "y", trials=8, folds=5, ranges=long)
    assert table.count() == 8 and best.stages[-1].getNumTrees == 300
