"""Ensembles: better than one shallow tree on planted data, both for classes and for numbers; boosting against its weights by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import models as M


@pytest.fixture(scope="module")
def three(spark):
    rng = np.random.default_rng(31)
    x = rng.normal(size=(700, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] > 0.3).astype(int) + (x[:, 0] * x[:, 0] + x[:, 2] > 1.5).astype(int)
    return spark.createDataFrame([(i, float(abs(a)), float(abs(b) + (b > 0)), float(c + 5), float(k)) for i, ((a, b, c), k) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, c double, y double").persist()


def accuracy(df):
    return df.agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0]


@pytest.mark.parametrize("name, options", [("adaboost", {"rounds": 8}), ("bagging_classes", {}), ("voting_classes", {}), ("stacking_classes", {"key": ["id"]})])
def test_classes(three, name, options):
    got = M.fit(name, three, ["a", "b", "c"], "y", **options)(three)
    base = three.groupBy("y").count().agg(F.max("count")).first()[0] / 700
    assert got.count() == 700 and accuracy(got) > base + 0.05 and {r[0] for r in got.select("prediction").distinct().collect()} <= {0.0, 1.0, 2.0}
    if name in ("bagging_classes", "voting_classes"):
        assert got.where(F.abs(F.aggregate("probability", F.lit(0.0), lambda s, v: s + v) - 1) > 1e-9).count() == 0


def test_numbers(spark):
    rng = np.random.default_rng(32)
    x = rng.uniform(-2, 2, size=(600, 2))
    y = np.sin(2 * x[:, 0]) + 0.5 * x[:, 1] ** 2
    df = spark.createDataFrame([(i, float(a), float(b), float(v)) for i, ((a, b), v) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, y double")
    rmse = lambda m: m(df).agg(F.sqrt(F.avg((F.col("prediction") - F.col("y")) ** 2))).first()[0]
    one = rmse(M.fit("decision_tree_regression", df, ["a", "b"], "y", maxDepth=3))
    assert rmse(M.fit("adaboost_regression", df, ["a", "b"], "y", rounds=12)) < one
    assert rmse(M.fit("stacking", df, ["a", "b"], "y", key=["id"])) < float(np.std(y))


def test_weighted_median_of_boosted_trees(spark):
    df = spark.createDataFrame([(float(i), float(i % 7)) for i in range(80)], "a double, y double")
    got = M.fit("adaboost_regression", df, ["a"], "y", rounds=3, depth=1)(df).select("a", "prediction").collect()
    assert len(got) == 80 and all(0 <= r["prediction"] <= 6 for r in got)
    same = spark.createDataFrame([(float(i), 2.5) for i in range(20)], "a double, y double")
    assert {r["prediction"] for r in M.fit("adaboost_regression", same, ["a"], "y")(same).collect()} == {2.5}


def test_adaboost_walks_a_tree_once_a_row(spark):
    """a class of a tree was worked out once for each class it could vote for, with vectors of votes and shares beside it."""
    df = spark.createDataFrame([(float(i % 7), float(i % 5), int(i % 7 > 3 and i % 5 > 1)) for i in range(200)], "a double, b double, y int")
    got = M.fit("adaboost", df, ["a", "b"], "y", rounds=3)(df)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan
    assert got.where("prediction <> y").count() == 0
    assert set(got.columns) == {*df.columns, "prediction"}


@pytest.mark.parametrize("name", ["gbt", "linear_svc"])
def test_one_against_the_rest_keeps_no_maps(three, name):
    """OneVsRest grew a map from class to margin, row by row and model by model."""
    from pyspark.ml import classification as C

    got = M.fit(name, three, ["a", "b", "c"], "y", maxIter=3)(three)
    x = M.vectors(M.grouped(three, ["a", "b", "c"], "y"), ["a", "b", "c"])
    est = (C.GBTClassifier(seed=1, maxIter=3) if name == "gbt" else C.LinearSVC(maxIter=3)).setWeightCol(M.TIMES)
    plain = C.OneVsRest(classifier=est).setWeightCol(M.TIMES).setLabelCol("y").setFeaturesCol("features").fit(x).transform(M.vectors(three, ["a", "b", "c"]))
    assert {r.id: r.prediction for r in got.collect()} == {r.id: r.prediction for r in plain.collect()}
    assert "mbc$acc" not in got._jdf.queryExecution().analyzed().toString() and set(got.columns) == {*three.columns, "prediction"}
