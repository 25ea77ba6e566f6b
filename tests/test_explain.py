"""Explanations of models with a planted truth, missing values and empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import explain, models


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(5)
    a, b, c = rng.normal(size=(3, 300))
    y = 5 * a + 1 * b + rng.normal(0, 0.1, 300)
    rows = [(i, *map(float, r)) for i, r in enumerate(zip(a, b, c, y, strict=True))]
    return spark.createDataFrame([*rows, (300, None, 1.0, 1.0, 1.0)], "id long, a double, b double, c double, y double").cache()


def test_permutation_finds_the_planted_driver(planted):
    m = models.fit("gram_ridge", planted, ["a", "b", "c"], "y")
    got = {r["variable"]: r["increase"] for r in explain.permutation_importance(planted, m, ["a", "b", "c"], "y", ["id"], rows_a_bucket=50).collect()}
    assert got["a"] > got["b"] > 10 * abs(got["c"])


def test_dependence_of_a_line_and_a_curve(planted):
    m = models.fit("gram_ridge", planted, ["a", "b"], "y")
    got = explain.partial_dependence(planted, m, ["a", "b"], "a", 10).collect()
    assert len(got) == 10 and {r["trend"] for r in got} == {"rising in a line"}
    step = (got[-1]["mean"] - got[0]["mean"]) / (got[-1]["value"] - got[0]["value"])
    assert abs(step - 5) < 0.1
    curve = lambda x: x.withColumn("prediction", F.col("a") ** 2)
    assert "curve" in explain.partial_dependence(planted, curve, ["a", "b"], "a").first()["trend"]


def test_dependence_of_an_empty_table(planted):
    m = models.fit("gram_ridge", planted, ["a", "b"], "y")
    assert explain.partial_dependence(planted.limit(0), m, ["a", "b"], "a").count() == 0
    assert explain.explain_rows(planted, m, ["a", "b"], ["id"], planted.limit(0)).count() == 0


def test_attribution_equals_brute_force(planted):
    m = models.fit("gram_ridge", planted, ["a", "b"], "y")
    got = {(r["id"], r["variable"]): r["effect"] for r in explain.explain_rows(planted, m, ["a", "b"], ["id"], planted, most=15).collect()}
    rows = m(planted.dropna()).orderBy("id").toPandas()
    assert len(got) == 600  # the row with a gap is left out
    slope = np.linalg.lstsq(np.c_[rows[["a", "b"]], np.ones(300)], rows["prediction"], rcond=None)[0]
    for j, c in enumerate(("a", "b")):
        want = slope[j] * (rows[c] - rows[c][:15].mean())
        assert np.allclose([got[i, c] for i in rows["id"]], want)


def test_learning_curve_plateaus_and_tuning_ranks(planted):
    x = planted.dropna()
    got = explain.learning_curve(x, "gram_ridge", ["a", "b"], "y", ["id"]).collect()
    assert [r["n"] for r in got] == sorted(r["n"] for r in got) and got[0]["verdict"] == "plateaued" and got[-1]["test_r2"] > 0.99
    best = explain.tune(x, "gram_ridge", ["a", "b"], "y", ["id"], {"alpha": [1e4, 0.0]}).where("rank = 1").first()
    assert best["options"] == "alpha=0.0"


def test_random_search_repeats_its_draws(planted, monkeypatch):
    space = {"alpha": (1e-3, 1e6, "log")}
    first = explain.drawn(space, 6, 1)
    assert first == explain.drawn(space, 6, 1) != explain.drawn(space, 6, 2) and all(1e-3 <= o["alpha"] <= 1e6 for o in first)
    assert len(explain.drawn({"a": [1, 2], "b": [3]}, 10)) == 2
    got = explain.tune(planted.dropna(), "gram_ridge", ["a", "b"], "y", ["id"], space, draws=6, seed=1).collect()
    assert [r["rank"] for r in got] == [1, 2, 3, 4, 5, 6] and got[0]["options"] == f"alpha={min(o['alpha'] for o in first):.6g}"
    assert [r["rmse"] for r in got] == sorted(r["rmse"] for r in got)


def test_roles_within_a_tolerance(spark):
    from tesserae.operators import evaluate

    rows = [("s", "best", 0.90, 0.1, 0.9), ("s", "plain", 0.87, 0.9, 0.5), ("s", "plainest", 0.80, 1.0, 0.1), ("s", "b", 0.2, 0.2, 0.0)]
    ranked = spark.createDataFrame(rows, "segment string, model string, performance double, interpretability double, composite double")
    roles = {r["role"]: r["model"] for r in evaluate.tournament_roles(ranked, baseline="b").collect()}
    assert roles == {"recommended": "best", "highest": "best", "simplest": "plain", "baseline": "b"}


def test_sensitivity_keeps_the_planted_driver(planted):
    got = explain.sensitivity_run(planted, ["a", "b", "c"], "y", ["id"]).collect()
    assert got[0]["driver"] == "a" and got[0]["verdict"] == "stable"


def test_sweep_finds_three_groups(spark):
    rng = np.random.default_rng(6)
    x = [tuple(map(float, rng.normal(m, 0.3, 2))) for m in (0, 10, 25) for _ in range(60)]
    got = explain.cluster_count_sweep(spark.createDataFrame(x, "a double, b double"), ["a", "b"], range(2, 6)).collect()
    assert [r["k"] for r in got if r["recommended"]] == [3]
    assert max(r["silhouette"] for r in got) > 0.4


def test_rows_with_the_same_features_are_explained_once(spark):
    """every row got its own copies, a model's prediction for each."""
    df = spark.createDataFrame([(i, float(i % 2), float(i // 2 % 2)) for i in range(400)], "id long, a double, b double")
    seen = []

    def model(x):
        seen.append(x.count())
        return x.withColumn("prediction", 2 * F.col("a") + F.col("b"))

    got = explain.explain_rows(df, model, ["a", "b"], ["id"], df, most=10)
    assert seen == [4 * 21]
    assert got.count() == 800 and got.columns == ["id", "variable", "effect", "rank"]
    for r in got.collect():
        a, b = float(r.id % 2), float(r.id // 2 % 2)
        assert abs(r.effect - (2 * (a - 0.5) if r.variable == "a" else b - 0.4)) < 1e-12
