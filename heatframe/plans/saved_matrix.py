"""The feature matrix as an MLlib stage: fitted once, saved with its statistics, loaded to rebuild the same rows.

The fitted stage holds what must not be learned again: the climatology and the event thresholds of the reference span,
the recipe and the columns that it gave. It is saved as metadata and two Parquet tables, and goes into an MLlib
``Pipeline`` beside the library's models.
"""

from __future__ import annotations

from dataclasses import asdict, replace

from pyspark.ml import Estimator, Model
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatframe.functions.features import align_columns
from heatframe.operators.series import Series
from heatframe.plans.feature_matrix import Recipe, feature_matrix, fit_climatology, fit_limits

# periods that a saved recipe may name
PERIODS = {"_doy": lambda ts: F.dayofyear(ts), "_hour": lambda ts: F.hour(ts), "_month": lambda ts: F.month(ts)}


def recipe_to_dict(recipe: Recipe) -> dict:
    unknown = set(recipe.periods) - set(PERIODS)
    if unknown:
        raise ValueError(f"periods without a name to save them by: {sorted(unknown)}")
    return {**asdict(replace(recipe, periods={})), "periods": list(recipe.periods)}


def recipe_from_dict(saved: dict) -> Recipe:
    spans = {k: tuple(v) if isinstance(v, list) else v for k, v in saved.items() if k != "periods"}
    return Recipe(**spans, periods={name: PERIODS[name] for name in saved["periods"]})


class FeatureMatrix(Estimator):
    """Fits the statistics of the reference span of a series; see ``Recipe``."""

    def __init__(self, series: Series, recipe: Recipe, entities: list[str]):
        super().__init__()
        recipe_to_dict(recipe)
        self.series, self.recipe, self.entities = series, recipe, list(entities)

    def _fit(self, dataset: DataFrame) -> FeatureMatrixModel:
        normal = fit_climatology(dataset, self.series, self.recipe)
        limits = fit_limits(dataset, self.series, self.recipe)
        columns = feature_matrix(dataset, self.series, self.recipe, self.entities, normal, limits).columns
        return FeatureMatrixModel(self.series, self.recipe, self.entities, normal, limits, columns)


class FeatureMatrixModel(Model, MLWritable, MLReadable):
    """Rows to matrix rows by fitted statistics. ``columns`` are those of the fit, in its order; a predictor that new
    rows lack is 0.0, as the matrix is aligned to what a model was trained on."""

    def __init__(self, series: Series, recipe: Recipe, entities: list[str], normal: DataFrame, limits: DataFrame, columns: list[str]):
        super().__init__()
        self.series, self.recipe, self.entities = series, recipe, entities
        self.normal, self.limits, self.columns = normal, limits, columns

    def _transform(self, dataset: DataFrame) -> DataFrame:
        found = feature_matrix(dataset, self.series, self.recipe, self.entities, self.normal, self.limits)
        return align_columns(found, self.columns)

    def write(self) -> MLWriter:
        return FeatureMatrixWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return FeatureMatrixReader()


class FeatureMatrixWriter(MLWriter):
    def __init__(self, model: FeatureMatrixModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m = self.model
        extra = {"series": asdict(m.series), "recipe": recipe_to_dict(m.recipe), "entities": m.entities, "columns": m.columns}
        mode = "overwrite" if self.shouldOverwrite else "errorifexists"
        m.normal.write.mode(mode).parquet(f"{path}/normal")
        m.limits.write.mode(mode).parquet(f"{path}/limits")
        # last, so that a broken save has no metadata and cannot be loaded
        DefaultParamsWriter.saveMetadata(m, path, SparkSession.active(), extraMetadata=extra)


class FeatureMatrixReader(MLReader):
    def load(self, path: str) -> FeatureMatrixModel:
        spark = SparkSession.active()
        saved = DefaultParamsReader.loadMetadata(path, spark)
        series = Series(**{**saved["series"], "keys": tuple(saved["series"]["keys"])})
        model = FeatureMatrixModel(series, recipe_from_dict(saved["recipe"]), saved["entities"],
                                   spark.read.parquet(f"{path}/normal"), spark.read.parquet(f"{path}/limits"), saved["columns"])
        model._resetUid(saved["uid"])
        return model
