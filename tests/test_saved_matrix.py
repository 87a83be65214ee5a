"""The saved feature matrix: same rows after loading, statistics that later rows do not change."""

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F
from test_models import RECIPE, SERIES, weather

from heatframe.operators import model as M
from heatframe.plans.feature_matrix import Recipe, feature_matrix
from heatframe.plans.saved_matrix import FeatureMatrix, FeatureMatrixModel, recipe_from_dict, recipe_to_dict

CITIES = ["lyon", "paris"]


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("matrix") / "m")
    model = Pipeline(stages=[FeatureMatrix(SERIES, RECIPE, CITIES)]).fit(weather(spark))
    model.write().save(path)
    return model, path


def same(a, b):
    return a.columns == b.columns and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_loaded_matrix_is_the_same_row_by_row(spark, saved):
    model, path = saved
    direct = feature_matrix(weather(spark), SERIES, RECIPE, CITIES)
    assert same(model.transform(weather(spark)), direct)
    loaded = PipelineModel.load(path)
    assert loaded.stages[0].uid == model.stages[0].uid and loaded.stages[0].columns == direct.columns
    assert same(loaded.transform(weather(spark)), direct)


def test_statistics_do_not_follow_the_test_rows(spark, saved):
    model, path = saved
    stage = PipelineModel.load(path).stages[0]
    changed = weather(spark, 30.0)  # from the 26th on, after the reference span
    refit = FeatureMatrix(SERIES, RECIPE, CITIES).fit(changed)
    assert same(stage.normal, refit.normal) and same(stage.limits, refit.limits)
    # a matrix that learned anew from the test rows alone would have other scores
    rows = changed.where(F.col("ts") >= F.lit("2021-06-18").cast("timestamp_ntz"))
    z = stage.transform(rows).agg(F.avg("temperature_2m_zscore")).first()[0]
    assert z > 1.5 and stage.transform(rows).where("is_train").count() < stage.transform(rows).count()


def test_later_rows_without_a_column_get_zeros(spark, saved):
    stage = saved[0].stages[0]
    got = stage.transform(weather(spark).drop("v_850hPa"))
    assert got.columns == stage.columns and got.where("v850_smooth_6h <> 0 OR lag_v850_72h <> 0").count() == 0


def test_matrix_and_model_in_one_pipeline(spark, saved, tmp_path):
    matrix = saved[0].stages[0]
    rows = matrix.transform(weather(spark)).withColumn("id", F.concat_ws("_", "city", F.col("ts").cast("string")))
    names = ["temperature_2m_zscore", "hour_sin", "city_lyon"]
    fitted = M.fit_classifier(rows.where("is_train"), names, "y", "id", maxIter=3, maxDepth=2)
    PipelineModel([matrix, fitted]).write().save(str(tmp_path / "p"))
    loaded = PipelineModel.load(str(tmp_path / "p"))
    a = M.score(PipelineModel([matrix, fitted]), weather(spark)).select("city", "ts", "prob")
    assert same(a, M.score(loaded, weather(spark)).select("city", "ts", "prob")) and a.count() > 0


def test_a_save_that_broke_off_cannot_be_loaded(spark, saved, tmp_path):
    stage = saved[0].stages[0]
    stage.normal.write.parquet(str(tmp_path / "half" / "normal"))
    with pytest.raises(Exception):
        FeatureMatrixModel.load(str(tmp_path / "half"))
    with pytest.raises(Exception):
        stage.write().save(str(tmp_path / "half"))
    stage.write().overwrite().save(str(tmp_path / "half"))
    assert same(FeatureMatrixModel.load(str(tmp_path / "half")).normal, stage.normal)


def test_recipes_survive_and_unnamed_periods_are_refused():
    assert recipe_from_dict(recipe_to_dict(RECIPE)).periods.keys() == RECIPE.periods.keys()
    back = recipe_from_dict(recipe_to_dict(Recipe()))
    assert recipe_to_dict(back) == recipe_to_dict(Recipe()) and back.months == (5, 6, 7, 8, 9)
    with pytest.raises(ValueError):
        recipe_to_dict(Recipe(periods={"_week": F.weekofyear}))
