"""Contributions of features to tree predictions against sums over all subsets."""

from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from heatframe.operators import attribution as A
from heatframe.operators import evaluate as V
from heatframe.operators import model as M

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame(rng.random((600, 4)), columns=NAMES)
    pdf["id"] = range(600)
    pdf["y"] = ((pdf.a + pdf.b * (pdf.c > 0.5) + 0.2 * rng.normal(size=600)) > 0.8).astype(int)
    pdf["n"] = 3 * pdf.a - 2 * pdf.d + rng.normal(size=600) * 0.1
    return spark.createDataFrame(pdf).repartition(3).cache()


@pytest.fixture(scope="module", params=["classifier", "regression", "stumps"])
def fitted(request, rows, tmp_path_factory):
    if request.param == "classifier":
        model = M.fit_classifier(rows, NAMES, "y", "id", maxIter=6, maxDepth=4)
    else:
        depth = {"regression": 5, "stumps": 1}[request.param]
        model = M.regression_pipeline(NAMES, "n", maxIter=5, maxDepth=depth).fit(rows)
    return model, A.leaf_paths(model, f"file://{tmp_path_factory.mktemp('trees')}/t")


def expected(paths, x, known):
    """The margin where only the features in known are."""
    total = 0.0
    for p in paths:
        part = p.value
        for f, low, high, share in zip(p.features, p.low, p.high, p.share):
            part *= (low < x[f] <= high) if f in known else share
        total += part
    return total


def plain(paths, x):
    n, out = len(x), []
    for i in range(n):
        rest = [j for j in range(n) if j != i]
        out.append(sum(
            factorial(k) * factorial(n - k - 1) / factorial(n) * (expected(paths, x, {*s, i}) - expected(paths, x, set(s)))
            for k in range(n) for s in combinations(rest, k)))
    return out


def test_contributions_equal_sums_over_subsets(fitted, rows):
    _, paths = fitted
    got = A.with_contributions(rows.limit(25), paths, NAMES).collect()
    for r in got:
        x = [r[c] for c in NAMES]
        assert np.allclose(r.contributions, plain(paths, x), atol=1e-9)


def test_contributions_add_up_to_the_margin(fitted, rows):
    model, paths = fitted
    scored = model.transform(rows).select(*NAMES, "rawPrediction" if "mllib_pred" in model.transform(rows).columns else "pred")
    for r in A.with_contributions(scored.drop("rawPrediction"), paths, NAMES).join(scored, NAMES).collect():
        margin = r.pred if "pred" in r else r.rawPrediction[1]
        assert abs(sum(r.contributions) + A.base_value(paths) - margin) < 1e-6
    assert abs(sum(p.cover for p in paths) - len({p.tree for p in paths})) < 1e-9


def test_many_features_on_a_way():
    rng = np.random.default_rng(1)
    share = rng.random(12)
    path = A.LeafPath(0, 1, 2.0, float(share.prod()), tuple(range(12)), (0.3,) * 12, (np.inf,) * 12, tuple(share))
    x = rng.random((40, 12))
    got = A.Contributions([path], 12).of(x)
    met = (x > 0.3).astype(float)
    assert np.allclose(got, 2 * A.shapley(met, share)) and np.allclose(got.sum(axis=1), 2 * (met.prod(axis=1) - share.prod()))


def test_long_rows_feed_the_tables(spark, fitted, rows):
    _, paths = fitted
    missing = spark.createDataFrame([(9999, None, 1.0, 1.0, 1.0)], "id long, a double, b double, c double, d double")
    tall = A.contribution_rows(rows.select("id", *NAMES).union(missing), paths, ["id"], NAMES).cache()
    assert tall.columns == ["id", "feature", "value", "score"] and tall.count() == 2400
    assert tall.where("id = 9999").count() == 0
    table = {r.feature: r for r in V.attribution_table(tall, 4).collect()}
    assert table["a"].rank == 1 and table["a"].importance == pytest.approx(
        tall.where("feature = 'a'").agg(F.avg(F.abs("score"))).first()[0])
    assert A.contribution_rows(rows.limit(0), paths, ["id"], NAMES).count() == 0


def test_a_model_without_splits(spark, tmp_path):
    rows = spark.createDataFrame([(float(k), 2.0) for k in range(30)], "a double, n double")
    model = M.regression_pipeline(["a"], "n", maxIter=2).fit(rows)
    paths = A.leaf_paths(model, f"file://{tmp_path}/t")
    assert A.with_contributions(rows, paths, ["a"]).first().contributions == [0.0]
    assert A.base_value(paths) == pytest.approx(2.0)
