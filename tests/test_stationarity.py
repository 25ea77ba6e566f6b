"""Stationarity tests against plain least squares, known p-values, and series that are read in pieces."""

import math

import numpy as np
import pytest

from tesserae.operators import series as S


def plain_adf(y):
    n = len(y)
    most = min(n // 2 - 2, math.ceil(12 * (n / 100) ** 0.25))
    d = np.diff(y)

    def fit(lags, start):
        rows = range(start, len(d))
        x = np.array([[y[i], *[d[i - k] for k in range(1, lags + 1)], 1.0] for i in rows])
        t = d[start:]
        beta = np.linalg.lstsq(x, t, rcond=None)[0]
        rss = float(((t - x @ beta) ** 2).sum())
        return rss, len(t), beta[0] / math.sqrt(rss / (len(t) - x.shape[1]) * np.linalg.inv(x.T @ x)[0, 0])

    aic = []
    for lags in range(most + 1):
        rss, m, _ = fit(lags, most)
        aic.append(m * math.log(rss / m) + 2 * (lags + 2))
    lags = int(np.argmin(aic))
    return fit(lags, lags)[2], lags


def plain_kpss(y):
    n, e = len(y), y - y.mean()
    s0, s1 = e @ e / n, 0.0
    for i in range(1, int(n ** (2 / 9)) + 1):
        v = e[i:] @ e[: n - i] / (n / 2)
        s0, s1 = s0 + v, s1 + i * v
    lags = min(n - 1, int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)))
    var = (e @ e + 2 * sum((1 - k / (lags + 1)) * (e[k:] @ e[: n - k]) for k in range(1, lags + 1))) / n
    return (np.cumsum(e) ** 2).sum() / n**2 / var, lags


def processes():
    rng = np.random.default_rng(21)
    out = {"noise": rng.normal(size=400), "walk": np.cumsum(rng.normal(size=500)), "short": rng.normal(size=30), "ninety": np.cumsum(rng.normal(size=90))}
    for name, phi in (("ar1", [0.6]), ("ar3", [0.5, -0.6, 0.5])):
        y = np.zeros(600)
        for t in range(3, 600):
            y[t] = sum(p * y[t - 1 - k] for k, p in enumerate(phi)) + rng.normal()
        out[name] = 1e3 + y
    return out


def test_statistics_against_least_squares(spark):
    own = processes()
    rows = [(k, i, float(v)) for k, y in own.items() for i, v in enumerate(y)] + [("flat", i, 2.0) for i in range(40)] + [("tiny", i, float(i)) for i in range(5)] + [("noise", 10**6, None)]
    got = {r.key: r for r in S.series_stationarity(spark.createDataFrame(rows, "key string, t long, y double")).collect()}
    assert set(got) == {*own, "flat", "tiny"}
    for k, y in own.items():
        adf, lags = plain_adf(y)
        kpss, wide = plain_kpss(y)
        r = got[k]
        assert (r.adf_lags, r.kpss_lags, r.n) == (lags, wide, len(y))
        assert abs(r.adf - adf) < 1e-6 * abs(adf) and abs(r.kpss - kpss) < 1e-9 * kpss
    assert len({r.adf_lags for r in got.values() if r.adf_lags is not None}) > 1  # the lag is each key's own
    assert got["noise"].verdict == "stationary" and got["walk"].verdict == "non-stationary" and got["ar1"].verdict == "stationary"
    assert got["flat"].adf is None and got["flat"].kpss is None and got["tiny"].adf_p is None and got["tiny"].verdict == "non-stationary"


@pytest.mark.parametrize("size", [1, 3, 17, 1000])
def test_pieces_give_the_same(size):
    y = processes()["ar3"]
    e = y - y.mean()
    whole, parts = S.Stationarity(len(e), None), S.Stationarity(len(e), None)
    whole.add(e)
    for a in range(0, len(e), size):
        parts.add(e[a : a + size])
    assert np.allclose(whole.adf(), parts.adf(), rtol=1e-9) and np.allclose(whole.kpss(), parts.kpss(), rtol=1e-9)


def test_p_at_published_critical_values():
    for statistic, p in ((-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.10)):  # MacKinnon, constant, large samples
        assert abs(S.adf_p(statistic) - p) < 0.002
    assert abs(S.adf_p(-1.61 + 1e-9) - S.adf_p(-1.61 - 1e-9)) < 2e-3 and S.adf_p(3.0) == 1.0 and S.adf_p(-20.0) == 0.0
    assert [round(S.kpss_p(v), 6) for v in (0.1, 0.347, 0.405, 0.463, 0.574, 0.739, 2.0)] == [0.1, 0.1, 0.075, 0.05, 0.025, 0.01, 0.01]


def test_analysis_carries_it(spark):
    from pyspark.sql import functions as F

    own = processes()
    rows = [(k, i + (9 if k == "short" and i > 20 else 0), float(v) + (8 if k == "noise" and i > 200 else 0)) for k, y in own.items() for i, v in enumerate(y)] + [("few", i, float(i % 3)) for i in range(12)]
    t = spark.createDataFrame(rows, "key string, i int, y double").select("key", F.date_add(F.lit("2020-01-01").cast("date"), F.col("i")).alias("t"), "y")
    got = {r.key: r for r in S.analyse_series(t, 7).collect()}
    assert got["ar1"].stationarity == "stationary" and 1 in got["ar1"].significant_lags and got["ar1"].issues == []
    assert "break" in got["noise"].issues and "missing periods" in got["short"].issues and got["few"].issues == ["too short"]
