"""Kendall's tau-b and its p-value against all pairs."""

import math

import numpy as np
import pytest

from tesserae.operators import hypothesis


def plain(a, b):
    n = len(a)
    s = sum(int((np.sign(a[i + 1 :] - a[i]) * np.sign(b[i + 1 :] - b[i])).sum()) for i in range(n))
    t, u = (np.unique(v, return_counts=True)[1].astype(float) for v in (a, b))
    pairs = n * (n - 1)
    tau = 2 * s / math.sqrt((pairs - (t * (t - 1)).sum()) * (pairs - (u * (u - 1)).sum()))
    var = (pairs * (2 * n + 5) - (t * (t - 1) * (2 * t + 5)).sum() - (u * (u - 1) * (2 * u + 5)).sum()) / 18
    var += (t * (t - 1)).sum() * (u * (u - 1)).sum() / (2 * pairs) + (t * (t - 1) * (t - 2)).sum() * (u * (u - 1) * (u - 2)).sum() / (9 * pairs * (n - 2))
    return tau, math.erfc(abs(s) / math.sqrt(2 * var))


@pytest.mark.parametrize("digit", [3, 10])
def test_kendall_is_exact(spark, monkeypatch, digit):
    monkeypatch.setattr(hypothesis, "DIGIT", digit)
    rng = np.random.default_rng(10)
    a = np.round(rng.normal(size=3000), 3 if digit == 3 else 12)
    b = np.where(rng.random(3000) < 0.3, 0.0, 0.1 * a + rng.normal(size=3000))  # a common value as well
    x = spark.createDataFrame([*zip(a.tolist(), b.tolist(), strict=True)], "a double, b double")
    got = hypothesis.correlation_test(x, "a", "b", "kendall").first()
    tau, p = plain(a, b)
    assert abs(got["statistic"] - tau) < 1e-12 and abs(got["p"] - p) < 1e-9 and got["n"] == 3000


def test_many_ties_few_rows_and_constants(spark):
    a, b = np.array([1, 1, 1, 2, 2, 3, 3, 3, 3, 4.0] * 3), np.array([1, 2, 1, 2, 2, 3, 1, 3, 2, 3.0] * 3)
    got = hypothesis.correlation_test(spark.createDataFrame([*zip(a.tolist(), b.tolist(), strict=True)], "a double, b double"), "a", "b", "kendall").first()
    tau, p = plain(a, b)
    assert abs(got["statistic"] - tau) < 1e-12 and abs(got["p"] - p) < 1e-9
    flat = hypothesis.correlation_test(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double"), "a", "b", "kendall").first()
    assert flat["statistic"] is None and flat["p"] is None and flat["n"] == 2


def test_groups_are_counted_apart():
    rng = np.random.default_rng(3)
    group, a, b, n = np.repeat(np.arange(7), 30), rng.integers(0, 9, 210), rng.integers(0, 9, 210), rng.integers(1, 5, 210)
    want = sum(hypothesis.concordance(a[group == g], b[group == g], n[group == g]) for g in range(7))
    assert hypothesis.concordance_within(group, a, b, n) == want
