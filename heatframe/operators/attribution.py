"""Contributions of features to single predictions of a boosted-tree model, path-dependent and exact.

Every leaf is a game of its own: a row reaches it if it meets the conditions of all features on the way; a feature that
is not known lets through the share of the training weight that took the way (the leaf's cover). A feature's contribution is
its Shapley value, summed over all leaves. What a leaf gives depends only on which of its few features a row meets, so
those values are tabled once per model, and a row looks them up. The model's table is as long as its leaves.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

MOST_TABLED = 10  # features of a leaf; beyond it a batch's own patterns are computed
BATCH_ROWS = 4096


@dataclass(frozen=True)
class LeafPath:
    """A leaf: its weighted value, its features with the interval (low, high] each must lie in, and each one's share of the cover."""

    tree: int
    leaf: int
    value: float
    cover: float
    features: tuple[int, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    share: tuple[float, ...]


def leaf_paths(model: PipelineModel, folder: str) -> list[LeafPath]:
    """The leaves of a fitted boosted-tree model (the pipeline's last stage), read from the node table that it saves in ``folder``.

    A node's cover is its training weight. Splits on categories are refused: the library's pipelines have none.
    """
    ensemble = model.stages[-1]
    ensemble.write().save(folder)
    split = F.col("nodeData.split")
    nodes = SparkSession.active().read.parquet(f"{folder}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", F.element_at("nodeData.impurityStats", 1).alias("cover"),
        "nodeData.leftChild", "nodeData.rightChild", split["featureIndex"].alias("feature"),
        F.get(split["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"), split["numCategories"].alias("categories"))
    trees: dict[int, dict[int, tuple]] = {}
    for r in nodes.collect():  # the model's own nodes
        trees.setdefault(r.treeID, {})[r.id] = r
    weights = list(ensemble.treeWeights)
    out: list[LeafPath] = []
    for tree in sorted(trees):
        known = trees[tree]
        todo = [(0, {})]
        while todo:
            at, way = todo.pop()
            node = known[at]
            if node.leftChild < 0:
                names = tuple(sorted(way))
                low, high, share = zip(*[way[f] for f in names]) if names else ((), (), ())
                out.append(LeafPath(tree, at, weights[tree] * node.prediction, node.cover / known[0].cover, names, low, high, share))
                continue
            if node.categories >= 0:
                raise ValueError("splits on categories have no intervals")
            for child, left in ((node.leftChild, True), (node.rightChild, False)):
                low, high, share = way.get(node.feature, (-np.inf, np.inf, 1.0))
                part = share * known[child].cover / node.cover
                new = (low, min(high, node.threshold), part) if left else (max(low, node.threshold), high, part)
                todo.append((child, {**way, node.feature: new}))
    return out


def base_value(paths: list[LeafPath]) -> float:
    """The margin expected of a row of which nothing is known."""
    return sum(p.value * p.cover for p in paths)


def shapley(met: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Shapley values of a leaf of value 1: rows of ``met`` (which features a row meets) by features.

    Features are taken together one by one as polynomials in the number of known ones; each feature's own factor is left
    out in turn.
    """
    n, m = met.shape
    weight = np.array([factorial(k) * factorial(m - k - 1) / factorial(m) for k in range(m)])
    out = np.zeros((n, m))
    for i in range(m):
        sums = np.zeros((n, m))
        sums[:, 0] = 1
        for j in range(m):
            if j != i:
                grown = sums * share[j]
                grown[:, 1:] += sums[:, :-1] * met[:, j:j + 1]
                sums = grown
        out[:, i] = (met[:, i] - share[i]) * (sums @ weight)
    return out


def _patterns(codes: np.ndarray, m: int) -> np.ndarray:
    return (codes[:, None] >> np.arange(m) & 1).astype("f8")


class Contributions:
    """The tables of a model's leaves, and the contributions of rows of features."""

    def __init__(self, paths: list[LeafPath], n_features: int):
        self.n = n_features
        self.leaves = [(np.array(p.features), np.array(p.low), np.array(p.high), np.array(p.share), p.value) for p in paths if p.features]
        self.tables = [shapley(_patterns(np.arange(1 << len(f)), len(f)), share) * value if len(f) <= MOST_TABLED else None
                       for f, _, _, share, value in self.leaves]

    def of(self, x: np.ndarray) -> np.ndarray:
        """Contributions (rows by features) to the margin of the rows of x."""
        out = np.zeros((len(x), self.n))
        for (features, low, high, share, value), table in zip(self.leaves, self.tables):
            own = x[:, features]
            codes = ((own > low) & (own <= high)) @ (1 << np.arange(len(features)))
            if table is None:
                kinds, codes = np.unique(codes, return_inverse=True)
                table = shapley(_patterns(kinds, len(features)), share) * value
            out[:, features] += table[codes]
        return out


def with_contributions(df: DataFrame, paths: list[LeafPath], features: list[str], name: str = "contributions") -> DataFrame:
    """df with an array of each feature's contribution to the row's margin, in the order of ``features``.

    They add up to the margin less ``base_value``. Rows with a missing feature, which the model cannot score, get NULL.
    """
    names = df.columns
    own = [names.index(f) for f in features]

    def add(incoming: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Contributions(paths, len(features))
        for b in incoming:
            for at in range(0, b.num_rows, BATCH_ROWS):
                part = b.slice(at, BATCH_ROWS)
                x = np.column_stack([part.column(k).cast(pa.float64()).to_numpy(zero_copy_only=False) for k in own])
                known = ~np.isnan(x).any(axis=1)
                found = np.zeros(x.shape)
                found[known] = tables.of(x[known])
                offsets = pa.array(np.where(np.append(known, True), np.arange(0, x.size + 1, x.shape[1]), 0), pa.int32(),
                                   mask=~np.append(known, True))
                yield pa.record_batch([*part.columns, pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))], [*names, name])

    return df.mapInArrow(add, StructType([*df.schema.fields, StructField(name, ArrayType(DoubleType()))]))


def contribution_rows(df: DataFrame, paths: list[LeafPath], ids: list[str], features: list[str]) -> DataFrame:
    """Long (ids, feature, value, score) form of the contributions; the input of the attribution tables."""
    wide = with_contributions(df.select(*ids, *features), paths, features, "_scores").where("_scores IS NOT NULL")
    parts = F.arrays_zip(F.array(*[F.lit(f) for f in features]).alias("feature"),
                         F.array(*[F.col(f).cast("double") for f in features]).alias("value"), F.col("_scores").alias("score"))
    return wide.select(*ids, F.explode(parts).alias("_part")).select(
        *ids, F.col("_part.feature").alias("feature"), F.col("_part.value").alias("value"), F.col("_part.score").alias("score"))
