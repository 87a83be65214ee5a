"""Model helpers on a planted signal, and the feature matrix' guarantees."""

import datetime as dt
import inspect

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from heatframe.operators import evaluate as V
from heatframe.operators import model as M
from heatframe.operators.series import Series
from heatframe.plans.feature_matrix import Recipe, engineer_features, feature_matrix


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"id": range(2000), "a": rng.random(2000), "b": rng.random(2000)})
    pdf["y"] = ((pdf["a"] + 0.1 * rng.normal(size=2000)) > 0.6).astype(int)
    return M.hash_split(spark.createDataFrame(pdf), "id").cache()


@pytest.fixture(scope="module")
def model(planted):
    return M.fit_classifier(planted.where("is_train"), ["a", "b"], "y", "id", maxIter=5, maxDepth=3)


def test_split_is_repeatable(planted):
    share = planted.agg(F.avg(F.col("is_train").cast("int"))).first()[0]
    again = M.hash_split(planted.drop("is_train").repartition(7), "id")
    assert 0.75 < share < 0.85 and again.exceptAll(planted.select(again.columns)).count() == 0


def test_model_beats_a_constant(planted, model):
    scored = M.score(model, planted.where("NOT is_train")).withColumn("k", F.lit("all"))
    assert V.roc_auc(scored, ["k"], "y", "prob").first()["roc_auc"] > 0.9


def test_importances_find_the_signal(spark, planted, model):
    ranked = [r["feature"] for r in M.feature_importance(spark, model, ["a", "b"]).collect()]
    assert ranked[0] == "a"
    loss = {r["feature"]: r["importance"] for r in M.permutation_importance(model, planted, ["a", "b"], "y", F.col("id")).collect()}
    assert loss["a"] > 0.1 > abs(loss["b"])


def counted(spark, df):
    """df, and how many of its rows were computed so far."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(count, df.schema), seen


def test_regression_computes_its_rows_once(spark, planted):
    rows, seen = counted(spark, planted.withColumn("t", F.col("a") * 2).drop("is_train"))
    fitted = M.fit_regression(rows, ["a", "b"], "t", maxIter=2, maxDepth=2)
    assert seen.value == 2000 and fitted.transform(planted).where("abs(pred - 2 * a) < 0.5").count() > 1500
    rows, seen = counted(spark, rows)
    best, table = M.tune_regression(
        rows, ["a", "b"], "t", trials=2, folds=2,
        ranges={"maxIter": (1, 2), "stepSize": (0.1, 0.15), "maxDepth": (1, 2), "minInstancesPerNode": (5, 9), "subsamplingRate": (0.6, 1.0)})
    assert seen.value == 2000 and table.count() == 2 and len(best.stages) == 2


def test_kept_rows_give_the_model_of_rows_that_are_not(spark, planted):
    rows = planted.withColumn("t", F.col("a") * 2).repartition(4, "id").where("is_train").select("a", "b", "t")
    plain = M.regression_pipeline(["a", "b"], "t", maxIter=3, maxDepth=2).fit(rows)
    kept = M.fit_regression(rows, ["a", "b"], "t", maxIter=3, maxDepth=2)
    assert plain.stages[-1].toDebugString.split("\n")[1:] == kept.stages[-1].toDebugString.split("\n")[1:]


def test_search_query_runs_its_whole_job(spark, monkeypatch):
    seen = {}

    def search(df, features, label, **params):
        given = inspect.signature(tune).bind(df, features, label, **params)
        given.apply_defaults()
        seen.update(given.arguments)
        return None, df.sparkSession.createDataFrame([(0, 1.0, {"maxIter": 300.0})], "trial int, mae double, parameters map<string, double>")

    tune = M.tune_regression
    monkeypatch.setattr(M, "tune_regression", search)
    assert entry.queries()["tune_regression"](spark, "/root/testdata/sf0.001").count() == 1
    assert (seen["trials"], seen["folds"], seen["ranges"]) == (100, 5, M.SEARCH)
    assert M.SEARCH == {
        "maxIter": (300, 1500), "stepSize": (0.01, 0.15), "maxDepth": (2, 6), "minInstancesPerNode": (5, 30), "subsamplingRate": (0.6, 1.0)}


def test_shuffle_keeps_every_value(planted):
    got = M.shuffled_columns(planted, ["a", "b"], F.col("id")).toPandas()
    assert sorted(got["a"]) == sorted(got["_shuffled_a"]) and (got["a"] != got["_shuffled_a"]).mean() > 0.99


def test_saved_model_scores_alike(spark, planted, model, tmp_path):
    M.save_model(model, ["a", "b"], str(tmp_path / "m"))
    loaded, names = M.load_model(spark, str(tmp_path / "m"))
    one = M.score(model, planted).select("id", "prob")
    assert names == ["a", "b"] and one.exceptAll(M.score(loaded, planted).select("id", "prob")).count() == 0


SERIES = Series(("city",), "ts", "hour", dense=True)
RECIPE = Recipe(
    zscores=("temperature_2m",), periods={"_hour": F.hour}, reference=("2021-06-01", "2021-06-20"), soil="soil", pct=0.5,
    window=24, horizon=24, months=(6,), train_before="2021-06-21",
)


def weather(spark, bump=0.0):
    rng = np.random.default_rng(2)
    start = dt.datetime(2021, 6, 1)
    rows = []
    for city in ("lyon", "paris"):
        day_heat = np.repeat(rng.normal(20, 8, 30), 24)
        for n in range(720):
            t = float(day_heat[n] + rng.random() + (bump if n >= 600 else 0.0))
            rows.append((city, start + dt.timedelta(hours=n), t, 280.0 + t, 250.0, 1000.0 + n % 9, 50.0, t - 20, 0.2))
    names = "temperature_2m double, t_850hPa double, t_500hPa double, pressure_msl double, relative_humidity_2m double, v_850hPa double, soil double"
    return spark.createDataFrame(rows, f"city string, ts timestamp_ntz, {names}")


def test_scores_use_reference_rows_only(spark):
    early = F.col("ts") < F.lit("2021-06-25").cast("timestamp_ntz")
    plain = engineer_features(weather(spark), SERIES, RECIPE).where(early).select("city", "ts", F.round("temperature_2m_zscore", 9).alias("z"))
    bumped = engineer_features(weather(spark, 30.0), SERIES, RECIPE).where(early).select("city", "ts", F.round("temperature_2m_zscore", 9).alias("z"))
    assert plain.where("z IS NOT NULL").count() == plain.count() > 0 and plain.exceptAll(bumped).count() == 0


def test_matrix_is_complete_and_split_by_time(spark):
    m = feature_matrix(weather(spark), SERIES, RECIPE, ["lyon", "paris"])
    got = m.toPandas()
    # 72 rows of lag at the start and the last row, which has no label
    assert len(got) == 2 * (720 - 72 - 1) and not got.isna().any().any()
    assert got["y"].sum() > 0 and (got["y"] == 0).any()
    assert ((got["ts"] < "2021-06-21") == got["is_train"]).all() and (got["city_lyon"] + got["city_paris"] == 1).all()
