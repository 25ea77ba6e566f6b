"""Fits of all folds at once against one fit a fold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import preprocess as P
from tesserae.operators import rows as R


def loop(df, steps):
    parts = []
    for f in sorted(r[0] for r in df.select("fold").distinct().collect() if r[0] is not None):
        train, held = df.where(F.col("fold") != f), df.where(F.col("fold") == f)
        for name, cols, *options in steps:
            fitted = P.fit(name, train, cols, **(options[0] if options else {}))
            train, held = P.transform(train, fitted), P.transform(held, fitted)
        parts.append(held)
    return R.union_tables(*parts)


STEPS = [
    [("standard_scale", ["a", "b"])],
    [("impute_mean", ["a"]), ("standard_scale", ["a", "b"]), ("minmax_scale", ["b"], {"low": -1.0}), ("maxabs_scale", ["a"])],
    [("log_transform", ["b"]), ("target_encode", ["c"], {"target": "y"})],
    [("impute_mean", ["a"]), ("robust_scale", ["b"]), ("target_encode", ["c"], {"target": "y", "smoothing": 3.0})],
]


@pytest.mark.parametrize("steps", STEPS)
def test_equal_to_one_fit_a_fold(spark, steps):
    rng = np.random.default_rng(4)
    rows = [(i, i % 4 if i % 50 else None, None if i % 11 == 0 else float(rng.normal()), float(rng.exponential()), f"c{int(rng.integers(0, 9))}" if i != 7 else "only", None if i % 13 == 0 else float(rng.normal())) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, fold int, a double, b double, c string, y double")
    want = {r.id: r.asDict() for r in loop(df, steps).collect()}
    got = P.pipeline_fold_fit(df, steps)
    assert set(got.columns) == set(next(iter(want.values())))
    got = {r.id: r.asDict() for r in got.collect()}
    assert set(got) == set(want)
    for i, row in want.items():
        for c, v in row.items():
            assert got[i][c] == v or isinstance(v, float) and abs(got[i][c] - v) < 1e-9, (i, c)


def test_one_pass_for_all_folds(spark, monkeypatch):
    df = spark.range(100).select((F.col("id") % 5).alias("fold"), F.col("id").cast("double").alias("a"))
    seen = []
    monkeypatch.setattr(P, "fit", lambda *a, **k: seen.append(a))
    P.pipeline_fold_fit(df, [("standard_scale", ["a"])]).collect()
    assert not seen
