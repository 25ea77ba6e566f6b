"""The nearest-neighbour join against all distances."""

import numpy as np
import pytest

from tesserae.operators import models as M
from tesserae.operators import neighbours as N
from tesserae.operators import preprocess as P


def brute(q, x, y, k):
    """near of each query: (d2, y), ties to the lesser y."""
    out = []
    for v in q:
        d = np.zeros(len(x))
        for j in range(x.shape[1]):
            d += (v[j] - x[:, j]) ** 2
        few = np.flatnonzero(d <= np.partition(d, min(k, len(d)) - 1)[min(k, len(d)) - 1])
        order = few[np.lexsort((y[few], d[few]))][:k]
        out.append([(float(a), float(b)) for a, b in zip(d[order], y[order], strict=True)])
    return out


def found(spark, q, x, y, k):
    names = [f"c{j}" for j in range(x.shape[1])]
    ref = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], ", ".join(f"{c} double" for c in names) + ", y double")
    ask = spark.createDataFrame([tuple(map(float, r)) for r in q], ", ".join(f"{c} double" for c in names))
    return {tuple(r.x): [(e.d2, e.y) for e in r.near] for r in N.nearest(ask, ref, names, "y", k).collect()}


@pytest.mark.parametrize("kind", ["grid", "clusters", "alike"])
def test_against_all_distances(spark, monkeypatch, kind):
    monkeypatch.setattr(N, "CELL", 300)
    monkeypatch.setattr(N, "BLOCK", 128)
    monkeypatch.setattr(N, "CHUNK", 50)
    rng = np.random.default_rng(7)
    n = 20_000 if kind == "clusters" else 3000
    if kind == "grid":  # many ties, many rows a vector
        x = rng.integers(0, 12, (n, 3)).astype(float)
    elif kind == "clusters":
        x = rng.normal(size=(30, 4))[rng.integers(0, 30, n)] * 20 + rng.normal(size=(n, 4))
    else:  # a third of all rows in one place
        x = rng.normal(size=(n, 2))
        x[: n // 3] = [0.5, 0.5]
    y = np.round(rng.normal(size=n), 2)
    q = np.concatenate((x[rng.choice(n, 400)], rng.normal(size=(50, x.shape[1])) * 50))
    got = found(spark, q, x, y, 5)
    want = brute(q, x, y, 5)
    recall = np.mean([len({e for e in got[tuple(v)]} & set(w)) / len(set(w)) for v, w in zip(q.tolist(), want, strict=True)])
    print(kind, "recall", recall)
    assert all(got[tuple(v)] == w for v, w in zip(q.tolist(), want, strict=True)) and recall == 1.0


def test_only_some_cells_are_visited():
    rng = np.random.default_rng(1)
    pivots = rng.normal(size=(20, 2)) * 100
    x = pivots[rng.integers(0, 20, 2000)] + rng.normal(size=(2000, 2))
    d = np.sqrt(N.squared(x, pivots))
    home = d.argmin(axis=1)
    own = [np.sort(d[home == i, i]) for i in range(20)]
    cells = N.Pivots(pivots, [o[:3].tolist() for o in own], [float(o[-1]) if len(o) else -1.0 for o in own])
    q, _ = cells.reached(d, cells.bound(d, 3))
    assert len(q) < 2000  # of 38,000 pairs
    all_d = np.sqrt(N.squared(x, x))
    assert (np.sort(all_d, axis=1)[:, 2] <= cells.bound(d, 3)).all()


def test_few_rows_missing_values_and_no_rows(spark):
    t = spark.createDataFrame([(1.0, 2.0, 10.0), (1.0, 2.0, 30.0), (2.0, 2.0, 20.0), (None, 1.0, 5.0), (float("nan"), 1.0, 5.0), (4.0, 4.0, None)], "a double, b double, y double")
    got = {(r.a, r.b): r.prediction for r in M.fit("knn", t, ["a", "b"], "y", k=5)(t).collect() if r.a is not None and r.a == r.a}
    assert got == {(1.0, 2.0): 20.0, (2.0, 2.0): 20.0, (4.0, 4.0): 20.0}
    assert [r.prediction for r in M.fit("knn", t, ["a", "b"], "y")(t.where("a is null")).collect()] == [None]
    assert [r.prediction for r in M.fit("knn", t.limit(0), ["a"], "y")(t.where("a = 2")).collect()] == [None]
    assert [r.prediction for r in M.fit("knn", t, ["a"], "y", k=2, classes=True)(t.where("a = 1").limit(1)).collect()] == [10.0]


def test_imputation_of_several_columns(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(a), float(b), None if i % 5 == 0 else float(3 * a), None if i % 7 == 0 else int(10 * b)) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))]
    t = spark.createDataFrame(rows, "id long, a double, b double, u double, v int")
    got = {r.id: r for r in P.fit_transform("impute_knn", t, ["u", "v"], observed=["a", "b"], k=4).collect()}
    assert len(got) == 400 and not any(r.u is None or r.v is None for r in got.values())
    x = np.array([(a, b) for _, a, b, _, _ in rows])
    for c, at, cast in (("u", 3, float), ("v", 4, int)):
        have = np.array([r[at] is not None for r in rows])
        y = np.array([r[at] for r in rows if r[at] is not None], dtype=float)
        for i in np.flatnonzero(~have):
            want = np.mean([v for _, v in brute(x[i : i + 1], x[have], y, 4)[0]])
            assert abs(got[int(i)][c] - cast(want)) < 1e-9
