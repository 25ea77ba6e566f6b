"""The battery of tests against each test on its own, and its verdicts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import hypothesis as H


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(12)
    rows = []
    for i in range(900):
        two, five = "ab"[i % 2], f"l{i % 5}"
        gap = None if i % 4 == 0 else "xyz"[i % 3]
        v = None if i % 31 == 0 else round(float(rng.normal(0.8 * (five == "l1"), 3.0 if two == "a" else 1.0)), 1)
        rows.append((two, "pq"[i % 7 == 0], five, gap, f"id{i}", "one", v))
    return spark.createDataFrame(rows, "two string, even string, five string, gap string, id string, one string, v double")


def test_each_category_as_its_own_tests(table):
    cats = ["two", "even", "five", "gap", "id", "one"]
    got = {r.variable: r for r in H.battery(table, "v", cats).collect()}
    assert set(got) == {"two", "even", "five", "gap"}
    for c, r in got.items():
        if r.levels == 2:
            first, second = H.t_test(table, c, "v").first(), H.mann_whitney(table, c, "v").first()
        else:
            first, second = H.anova(table, c, "v").first(), H.kruskal_wallis(table, c, "v").first()
        assert (r.test, r.n) == (first.test, first.n) and r.cross_test == second.test
        for mine, other in ((r.statistic, first.statistic), (r.p, first.p), (r.effect, first.effect), (r.df, first.df), (r.cross_statistic, second.statistic), (r.cross_p, second.p)):
            assert abs(mine - other) < 1e-9 * max(1, abs(other))
    holm = {r["name"]: r.holm for r in H.multiple_comparison(table.sparkSession.createDataFrame([(c, r.p) for c, r in got.items()], "name string, p double")).collect()}
    for c, r in got.items():
        assert abs(r.holm - holm[c]) < 1e-12 and r.significant == (r.holm < 0.05) and r.agrees == ((r.p < 0.05) == (r.cross_p < 0.05))
        assert r.confidence == ("high" if r.significant and r.agrees else "moderate" if r.agrees else "low")
    assert got["two"].test == "welch" and got["five"].significant


def test_known_p_values(spark):
    """t = 2.0 with 8 degrees of freedom, by the closed form of the t distribution for an even number of them."""
    a, b = [1.0, 2.0, 3.0, 4.0, 5.0], [3.0, 4.0, 5.0, 6.0, 7.0]
    t = spark.createDataFrame([("a", v) for v in a] + [("b", v) for v in b], "g string, v double")
    r = H.battery(t, "v", ["g"]).first()
    s = 2 / np.sqrt(8 + 4)  # t / sqrt(df + t^2)
    want = 1 - s * (1 + 1 / 2 * (1 - s**2) + 3 / 8 * (1 - s**2) ** 2 + 5 / 16 * (1 - s**2) ** 3)
    assert abs(r.statistic + 2.0) < 1e-12 and r.df == 8 and abs(r.p - want) < 1e-10


def test_nothing_to_compare(spark):
    t = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "g string, v double")
    assert H.battery(t, "v", ["g"]).count() == 0 and H.battery(t.limit(0), "v", ["g"]).count() == 0
    assert H.battery(t.withColumn("h", F.lit(None).cast("string")), "v", ["h"]).columns[-1] == "confidence"
