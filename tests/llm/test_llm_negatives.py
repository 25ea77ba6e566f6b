"""Hard negatives against all products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import negatives as N


def plain(rows, every=10, positives=5, negatives=3):
    """rows: vec_id, label, vector; one row a vec_id."""
    v = {i: np.array([int(np.clip(np.floor(256 * float(c)), -N.BOUND, N.BOUND)) for c in x], dtype=object) for i, _, x in rows}
    label = {i: y for i, y, _ in rows}
    out = set()
    for a in [i for i in v if i % every == 0]:
        scores = {b: int((v[a] * v[b]).sum()) for b in v if b != a and len(v[b]) == len(v[a])}
        first = sorted(scores, key=lambda b: (-scores[b], b))
        for p in [b for b in first if label[b] == label[a]][:positives]:
            fits = [b for b in first if label[b] != label[a] and 50 * scores[p] <= 100 * scores[b] <= 95 * scores[p]]
            out |= {(a, p, k + 1, b, scores[p], scores[b]) for k, b in enumerate(fits[:negatives])}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, y, x, "e", 1) for i, y, x in rows], "vec_id long, label int, embedding array<double>, v string, d int")


def mined(spark, rows, every=10):
    return {tuple(r) for r in N.mine(frame(spark, rows), F.col("vec_id") % every == 0).collect()}


def clustered(rng, n, d=12, groups=6):
    centres = rng.normal(size=(groups, d))
    return [(i, int(rng.integers(0, 4)), (centres[i % groups] + 0.4 * rng.normal(size=d)).tolist()) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_products(spark, seed, monkeypatch):
    monkeypatch.setattr(N, "STEP", 16)
    rng = np.random.default_rng(seed)
    rows = clustered(rng, 400)
    rows += [(1000 + i, i % 3, rows[7][2]) for i in range(200)]  # a third alike: ties by vec_id
    rows += [(2000 + i, i % 2, rng.normal(size=5).tolist()) for i in range(30)]  # of another length
    rows += [(3000, 1, [0.0] * 12), (3001, 1, [1e-9] * 12), (3010, 2, [-0.0] * 12), (3020, 1, [3e5, -1e300] + [0.5] * 10), (3021, 2, [3e5, -2e300] + [0.1] * 10), (3022, 1, [1e5, -1e5] + [0.1] * 10)]
    bad = [(4000, None, [1.0] * 12), (4001, 1, None), (4002, 1, [None] * 12), (4010, 1, [float("nan")] * 12), (4020, 1, [float("inf")] * 12), (None, 1, [1.0] * 12), (4030, 1, [])]
    want = plain(rows)
    assert mined(spark, rows + bad) == want and len(want) > 100
    # rows with one vec_id: the greatest label and vector; repeated rows count once
    assert mined(spark, rows + [(i, y - 9, x) for i, y, x in rows[:50]] + rows[:70]) == want


def test_blocks_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(N, "CHUNK", 7)
    monkeypatch.setattr(N, "STEP", 8)
    rows = clustered(np.random.default_rng(3), 500)
    made = N.usable(frame(spark, rows))
    centres = N.centres_of(made.where("vec_id % 10 = 0"))
    members, spread = N.dealt(made.where("vec_id % 10 = 0"), centres, 7)
    spread = spread.collect()
    blocks = N.lists(made, centres, spread, 12 * 32)
    got = blocks.select("d", "cluster", "n", "top").collect()
    assert {(r.d, r.cluster) for r in got} == {(r.d, r.cluster) for r in spread} and max(r.n for r in got) <= 32
    assert sum(r.n for r in got) == 500 * len(spread)
    # the first block of a list holds its greatest bounds, and every product is within its bound
    vectors = {r.vec_id: np.array(r.v) for r in made.collect()}
    own = {}
    for m in members.collect():
        own.setdefault(m.cluster, []).append(m)
    for b in blocks.collect():
        ids, bounds = np.frombuffer(b.ids, dtype=np.int64), np.frombuffer(b.bounds)
        assert (np.diff(bounds) <= 0).all() and bounds[0] == b.top
        for m in own[b.cluster]:
            assert all((np.array(m.v) @ vectors[i]) <= m.norm * x + 1 for i, x in zip(ids.tolist(), bounds, strict=True))


def test_a_walk_stops_where_it_is_certified(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(N, "STEP", 10)
    seen = []
    real = N.products
    monkeypatch.setattr(N, "products", lambda a, b: seen.append(len(b)) or real(a, b))
    v = np.stack([np.arange(100, 0, -1), np.zeros(100, dtype=int)], axis=1).astype(np.int32)
    members = pa.array([{"vec_id": -1, "label": 1, "v": [10, 0], "norm": 10.0, "bands": [{"band": 0, "low": -(2**62), "high": 2**62}]}])
    got = N.walk(members, True, 3, np.arange(100), np.ones(100, dtype=np.int64), v[:, 0].astype(float), v)
    assert got[3].tolist() == [1000, 990, 980] and sum(seen) == 10


def test_products_are_exact():
    a = np.full((1, 8), N.BOUND, dtype=np.int64)
    b = a - np.arange(8)
    assert N.products(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(a[0], b[0], strict=True))]]


def test_empty_and_lonely(spark):
    assert mined(spark, [(10, 1, [1.0, 2.0])]) == set()
    assert N.mine(frame(spark, [(10, 1, [1.0])]).limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert N.mine(frame(spark, [(11, 1, [1.0]), (12, 2, [1.0])]), F.col("vec_id") % 10 == 0).count() == 0
