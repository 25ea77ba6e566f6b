"""Fits on different rows with their numbers against fits on all rows."""

import pytest
from pyspark.sql import functions as F

from tesserae.operators import models as M


@pytest.fixture(scope="module")
def rows(spark):
    x = spark.range(4000).select((F.col("id") % 6).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"), F.col("id").alias("key"))
    y = F.col("a") * F.col("b") + F.pmod(F.xxhash64("key"), F.lit(100)) / 20
    return x.withColumn("y", y).withColumn("c", (F.col("y") > 6).cast("int")).cache()


def read(monkeypatch, rows, name, target, **options):
    """Rows that a fit assembles vectors of, and its predictions in order of the key."""
    sizes, own = [], M.vectors
    monkeypatch.setattr(M, "vectors", lambda df, features: sizes.append(df.count()) or own(df, features))
    m = M.fit(name, rows, ["a", "b"], target, **options)
    monkeypatch.setattr(M, "vectors", own)
    return max(sizes), [r[0] for r in m(rows).orderBy("key").select("prediction").collect()]


@pytest.mark.parametrize("name, target, off", [("gbt_regression", "y", {"maxIter": 3, "subsamplingRate": 1.0}), ("decision_tree_regression", "y", {"minInstancesPerNode": 1}), ("gbt", "c", {"maxIter": 3, "subsamplingRate": 1.0}), ("decision_tree", "c", {"minInstancesPerNode": 1})])
def test_trees_are_the_same_on_grouped_rows(monkeypatch, rows, name, target, off):
    on = {k: v for k, v in off.items() if k == "maxIter"}
    few, mine = read(monkeypatch, rows, name, target, **on)
    many, plain = read(monkeypatch, rows, name, target, **off)
    assert few <= 60 and many == 4000 and mine == pytest.approx(plain, abs=1e-9)


def test_other_fits_read_grouped_rows(monkeypatch, rows):
    assert read(monkeypatch, rows, "gmm", None, k=2)[0] == 30
    few, got = read(monkeypatch, rows, "adaboost", "c", rounds=2)
    assert few <= 60 and len(got) == 4000
    assert read(monkeypatch, rows, "logistic", "c")[0] <= 60


def test_forest_tasks_are_bounded(monkeypatch, rows):
    monkeypatch.setattr(M, "TASK_ROWS", 100)
    assert M.dealt(rows).rdd.getNumPartitions() == 40
