"""Planted truth, missing values, empty tables and kernels."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tesserae.operators import describe, evaluate, hypothesis, kernels, models, preprocess, profile, series
from tesserae.sources import readers


def test_ranks_equal_pandas_at_any_partitioning(spark):
    x = np.random.default_rng(1).integers(0, 50, 500).astype(float)
    want = pd.Series(x).rank().groupby(x).first()
    for parts in (1, 4, 16):
        got = kernels.global_ranks(spark.createDataFrame([(v,) for v in x.tolist()], "v double").repartition(parts), "v").toPandas().set_index("v")["rank"].sort_index()
        assert np.allclose(got.to_numpy(), want.sort_index().to_numpy())


def test_gram_equals_numpy(spark):
    x = np.random.default_rng(2).normal(size=(200, 3))
    n, mean, s = kernels.gram(spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double"), ["a", "b", "c"])
    c = x - x.mean(axis=0)
    assert n == 200 and np.allclose(mean, x.mean(axis=0)) and np.allclose(s, c.T @ c)


def test_nan_and_null_are_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    r = describe.describe_numeric(df, ["x"]).first()
    assert (r["n"], r["missing"], r["mean"]) == (2, 2, 2.0)


def test_empty_table(spark):
    df = spark.createDataFrame([], "x double, g string")
    assert describe.describe_categorical(df, ["g"]).count() == 0
    assert describe.describe_numeric(df, ["x"]).count() == 0


def test_collinear_columns_have_high_vif(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=300)
    rows = [(float(x), float(2 * x + e), float(c)) for x, e, c in zip(a, rng.normal(0, 0.1, 300), rng.normal(size=300))]
    v = {r["variable"]: r["vif"] for r in describe.vif(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"]).collect()}
    assert v["a"] > 10 and v["c"] < 5


def test_break_is_found(spark):
    rng = np.random.default_rng(4)
    rows = [("s", i, float((100 if i < 80 else 160) + rng.normal(0, 10))) for i in range(160)]
    r = series.structural_break(spark.createDataFrame(rows, "key string, t int, y double")).first()
    assert 70 <= r["position"] <= 90 and r["flagged"]


def test_group_difference_is_significant(spark):
    rng = np.random.default_rng(5)
    rows = [(g, float(rng.normal(m, 10))) for g, m in (("a", 10), ("b", 16), ("c", 22)) for _ in range(60)]
    r = hypothesis.anova(spark.createDataFrame(rows, "g string, v double"), "g", "v").first()
    assert r["p"] < 0.01 and r["effect"] > 0.14


def test_impute_by_group_and_unseen_group(spark):
    train = spark.createDataFrame([("A", 10.0), ("A", 12.0), ("A", None), ("B", 100.0), ("B", 104.0), ("B", None)], "region string, spend double")
    f = preprocess.fit("impute_by_group", train, ["spend"], group="region", how="mean")
    new = spark.createDataFrame([("A", None), ("B", None), ("C", None)], "region string, spend double")
    got = {r["region"]: r["spend"] for r in preprocess.transform(new, f).collect()}
    assert got == {"A": 11.0, "B": 102.0, "C": 56.5}


def test_latent_classes_are_recovered(spark):
    rng = np.random.default_rng(6)
    rate = np.array([[0.9, 0.85, 0.1, 0.15, 0.5], [0.1, 0.2, 0.9, 0.8, 0.5]])
    z = rng.integers(0, 2, 800)
    x = (rng.random((800, 5)) < rate[z]).astype(int)
    _, got = models.latent_class(spark.createDataFrame([tuple(map(int, r)) for r in x], "a int, b int, c int, d int, e int"), list("abcde"))
    assert min(np.abs(got - rate).max(), np.abs(got[::-1] - rate).max()) < 0.12


def test_conformal_refuses_few_rows(spark):
    df = spark.createDataFrame([(1.0, 1.0)] * 4, "actual double, predicted double")
    with pytest.raises(ValueError, match="few"):
        evaluate.conformal_interval(df, "actual", "predicted")


def test_types(spark):
    rows = [(i, ["low", "medium", "high"][i % 3], i % 2, float(i) / 7, "R1,200.50") for i in range(200)]
    t = {r["column"]: r["semantic_type"] for r in profile.infer_semantic_types(spark.createDataFrame(rows, "user_id long, tier string, is_active int, revenue double, same string")).collect()}
    assert t == {"user_id": "identifier", "tier": "categorical_ordinal", "is_active": "binary", "revenue": "numeric_continuous", "same": "constant"}


def test_sql_guard():
    assert readers.check_select("select ';' from t;") == "select ';' from t"
    for bad in ("drop table t", "select 1; delete from t"):
        with pytest.raises(ValueError):
            readers.check_select(bad)
    assert "secret" not in readers.redact("jdbc:postgresql://me:secret@host/db?password=secret")


def test_names_are_normalised(spark):
    df = spark.createDataFrame([(1, 2, 3)], [" a ", " ", "a"])
    assert readers.normalise_columns(df).columns == ["a", "column_2", "a_2"]


def test_text_becomes_numbers(spark):
    from tesserae.functions.scalar import numeric_text

    df = spark.createDataFrame([("R1,200.50",), ("12 %",), ("x",)], "s string")
    assert [r[0] for r in df.select(numeric_text(F.col("s"))).collect()] == [1200.5, 12.0, None]


def test_representative_rows_rank_few_rows(spark):
    """The nearest rows are those of a full sort, ties by the key, and only rows within the bound are sorted."""
    from tesserae.operators import clusters

    rows = [("ab"[i % 2], i, float((i * 7919) % 1009)) for i in range(20_000)]
    t = spark.createDataFrame(rows, "c string, id long, x double")
    got = sorted((r["cluster"], r["rank"], r["id"]) for r in clusters.representative_rows(t, "c", ["x"], ["id"]).collect())
    want = []
    for c in "ab":
        own = [(i, x) for k, i, x in rows if k == c]
        m = sum(x for _, x in own) / len(own)
        want += [(c, n, i) for n, (_, i) in enumerate(sorted((round((x - m) ** 2, 6), i) for i, x in own)[:3], 1)]
    assert got == want
    near = clusters._within_bound(t.selectExpr("c as cluster", "id", "x as distance"), ["id"], 3)
    assert 6 <= near.count() < 100
