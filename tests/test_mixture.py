"""Gaussian mixtures against plain EM, and what is planted."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array

from tesserae.operators import models as M
from tesserae.plans import registry


def logs(z, weights, means, covariances):
    """Logarithm of weight and density by row and component."""
    out = []
    for w, m, c in zip(weights, means, covariances, strict=True):
        d = z - m
        out.append(np.log(w) - 0.5 * (len(m) * np.log(2 * np.pi) + np.linalg.slogdet(c)[1] + np.einsum("np,pq,nq->n", d, np.linalg.inv(c), d)))
    return np.stack(out, axis=1)


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(2)
    parts = [rng.multivariate_normal(m, c, n) for m, c, n in (([0, 0], [[1, 0.8], [0.8, 1]], 2400), ([4, 0], [[0.3, 0], [0, 2]], 1200), ([0, 6], [[1, -0.5], [-0.5, 0.6]], 400))]
    x = np.round(np.concatenate(parts), 1) * [1, 1000]  # one column in other units; many rows alike
    return rng.permutation(x)


def test_mixture_is_fitted_to_the_end(spark, planted):
    """MLlib stopped after 100 rounds from a start drawn from different rows, columns in their own units."""
    df = spark.createDataFrame([tuple(map(float, r)) for r in planted] + [(None, 1.0), (float("nan"), 2.0)], "a double, b double")
    m = M.gaussian_mixture(M.complete(df, ["a", "b"]), ["a", "b"], 3)
    z = (planted - m.shift) / m.scale
    log = logs(z, m.weights, m.means, m.covariances)
    like = np.logaddexp.reduce(log, axis=1)
    assert m.log_likelihood == pytest.approx(like.sum() - len(z) * np.log(m.scale).sum(), abs=1)
    share = np.exp(log - like[:, None])  # one more round of plain EM changes next to nothing
    means = share.T @ z / share.sum(axis=0)[:, None]
    assert np.allclose(share.mean(axis=0), m.weights, atol=2e-3) and np.allclose(means, m.means, atol=5e-3)
    assert np.allclose(sorted(m.weights), [0.1, 0.3, 0.6], atol=0.02)
    at = np.argsort(m.weights)
    assert np.allclose((m.means * m.scale + m.shift)[at], [[0, 6000], [4, 0], [0, 0]], atol=120) and np.allclose((m.means * m.scale + m.shift)[at][:, 0], [0, 4, 0], atol=0.15)
    got = M.fit("gmm", df, ["a", "b"], k=3)(df)
    rows = got.select("a", "b", "prediction", vector_to_array("probability").alias("p")).collect()
    assert len(rows) == len(planted) and got.columns == ["a", "b", "probability", "prediction"]
    z = (np.array([(r.a, r.b) for r in rows]) - m.shift) / m.scale
    log = logs(z, m.weights, m.means, m.covariances)
    want = np.exp(log - np.logaddexp.reduce(log, axis=1)[:, None])
    assert np.allclose([r.p for r in rows], want, atol=1e-6) and [r.prediction for r in rows] == want.argmax(axis=1).tolist()


def test_few_different_rows(spark):
    df = spark.createDataFrame([(1.0, 5), (2.0, 5), (1.0, 5)], "a double, b int")
    got = M.fit("gmm", df, ["a", "b"], k=3)(df)
    assert {(r.a, r.prediction) for r in got.collect()} in ({(1.0, 0), (2.0, 1)}, {(1.0, 1), (2.0, 0)})
    with pytest.raises(ValueError, match="complete"):
        M.fit("gmm", df.where("a > 5"), ["a", "b"])


def test_fit_gmm_sums_memberships(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = [(int(q), float(v), "AR"[i % 2]) for i, (q, v) in enumerate(zip(rng.integers(1, 51, 900), rng.integers(0, 11, 900) / 100, strict=True))]
    spark.createDataFrame(rows, "l_quantity int, l_discount double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = registry.queries()["fit_gmm"](spark, str(tmp_path)).collect()
    assert [r.prediction for r in got] == [0, 1, 2] and sum(r.n for r in got) == 900
    assert sum(r.members for r in got) == pytest.approx(900) and any(abs(r.members - r.n) > 0.01 for r in got)
