"""The quantile transform to a normal distribution against a plain version."""

from statistics import NormalDist

import numpy as np
from pyspark.sql import functions as F

from tesserae.functions.scalar import with_normal_quantile
from tesserae.operators import preprocess


def plain(x, n=1000):
    known, steps = np.sort(x[~np.isnan(x)]), min(n, len(x)) - 1
    refs = np.arange(steps + 1) / steps
    at = [divmod(i * (len(known) - 1), steps) for i in range(steps + 1)]
    q = np.array([known[k] + (known[min(k + 1, len(known) - 1)] - known[k]) * r / steps for k, r in at])
    p = 0.5 * (np.interp(x, q, refs) - np.interp(-x, -q[::-1], -refs[::-1]))
    p[x <= q[0]], p[x >= q[-1]] = 0, 1
    return np.array([np.nan if np.isnan(v) else NormalDist().inv_cdf(min(max(v, 1e-7), 1 - 1e-7)) for v in p])


def check(spark, x, **options):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, x double")
    got = preprocess.fit_transform("quantile_normal", df, ["x"], **options).select("i", "x").orderBy("i").collect()
    got = np.array([np.nan if r.x is None else r.x for r in got])
    far = np.flatnonzero(~np.isclose(got, plain(x, **options), rtol=1e-9, atol=1e-9, equal_nan=True))
    assert not len(far), (len(far), x[far][:5], got[far][:5], plain(x, **options)[far][:5])
    return df


def test_a_thousand_quantiles(spark):
    """200 quantiles stood for the method's 1000, tied ones were counted once, and shares lay on lines between normal values."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.lognormal(size=5000), np.full(900, 0.75), np.round(rng.normal(size=600), 1), [np.nan] * 20])
    df = check(spark, rng.permutation(x))
    assert len(preprocess.fit("quantile_normal", df, ["x"])["learned"]["x"]) == 1000
    check(spark, x, n=30)


def test_few_rows_and_few_values(spark):
    check(spark, np.array([3.0, 1.0, 2.0, 2.0, 2.0, 7.0]))
    check(spark, np.array([0.0, 1.0] * 30 + [2.0]))
    df = spark.createDataFrame([(5.0,), (5.0,), (None,)], "x double")
    assert [r.x for r in preprocess.fit_transform("quantile_normal", df, ["x"]).collect()] == [0.0, 0.0, None]
    nothing = spark.createDataFrame([(None,), (None,)], "x double")
    assert [r.x for r in preprocess.fit_transform("quantile_normal", nothing, ["x"]).collect()] == [None, None]


def test_new_values_beyond_the_fitted_ones(spark):
    df = spark.createDataFrame([(float(i),) for i in range(100)], "x double")
    fitted = preprocess.fit("quantile_normal", df, ["x"])
    got = [r.x for r in preprocess.transform(spark.createDataFrame([(-50.0,), (49.5,), (900.0,)], "x double"), fitted).collect()]
    assert np.allclose(got, [NormalDist().inv_cdf(1e-7), 0.0, -NormalDist().inv_cdf(1e-7)], atol=1e-12)


def test_normal_quantiles(spark):
    shares = [1e-11, 1e-7, 1e-4, 0.01, 0.0749, 0.075, 0.0751, 0.3, 0.5, 0.7, 0.925, 0.99, 1 - 1e-7]
    got = with_normal_quantile(spark.createDataFrame([(p,) for p in [*shares, None]], "p double"), F.col("p"), "z").collect()
    assert [r.z for r in got if r.p is None] == [None]
    assert all(abs(r.z - NormalDist().inv_cdf(r.p)) < 1e-9 for r in got if r.p is not None)
