"""Itemsets against all subsets of all baskets; ranks and quantiles of groups that several ranges hold."""

from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from tesserae.operators import baskets as B
from tesserae.operators import kernels


@pytest.mark.parametrize("most, least", [(1, 0.05), (3, 0.04), (4, 0.02)])
def test_itemsets_against_all_subsets(spark, monkeypatch, most, least):
    monkeypatch.setattr(B, "CANDIDATES", 50)
    monkeypatch.setattr(B, "STEP", 7)
    rng = np.random.default_rng(2)
    rows = [sorted({f"i{int(v)}" for v in rng.geometric(0.18, rng.integers(0, 9))}) for _ in range(900)] + [["i1", "i2", "i3", "i4", None, "i2"]] * 40 + [[], None]
    t = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "txn long, items array<string>").repartition(3)
    got = {(tuple(r.items), r.n) for r in B.association_itemsets(t, least, most).collect()}
    count = Counter(c for r in rows for k in range(1, most + 1) for c in combinations(sorted({x for x in r or [] if x}), k))
    want = {(c, n) for c, n in count.items() if n >= least * len(rows)}
    assert got == want and max(len(c) for c, _ in want) == most


def test_no_baskets(spark):
    t = spark.createDataFrame([(1, ["a"])], "txn long, items array<string>")
    assert B.association_itemsets(t.limit(0)).count() == 0 and [tuple(r) for r in B.association_itemsets(t).collect()] == [(["a"], 1, 1.0)]


def test_groups_over_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(kernels, "RANGE_VALUES", 100)
    rng = np.random.default_rng(4)
    rows = [("hot", float(v)) for v in rng.normal(size=1500).round(3)] + [(f"g{i % 20}", float(i % 7)) for i in range(200)] + [(None, float(v)) for v in rng.normal(size=400)] + [("one", 3.0), ("none", None)]
    t = spark.createDataFrame(rows, "g string, v double")
    own = {}
    for g, v in rows:
        if v is not None:
            own.setdefault(g, []).append(v)
    got = {r.g: r.q for r in kernels.group_quantiles(t, ["g"], "v", [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    assert set(got) == set(own)
    for g, v in own.items():
        assert np.allclose(got[g], np.quantile(v, [0.0, 0.25, 0.5, 0.9, 1.0]), atol=1e-12)
    ranks = {(r.g, r.v): (r.n, r.before, r.rank) for r in kernels.global_ranks(t, "v", by=["g"]).collect()}
    assert len(ranks) == sum(len(set(v)) for v in own.values())
    for g, v in own.items():
        x = np.array(v)
        for u in set(v):
            n, before = int((x == u).sum()), int((x < u).sum())
            assert ranks[g, u] == (n, before, before + (n + 1) / 2)
    # no window over a whole group of values: the only one by group alone runs over totals
    dealt = kernels.running_counts(t.groupBy("g", "v").count().withColumnRenamed("count", "n").dropna(), ["g"], "v")
    windows = [x for x in dealt._jdf.queryExecution().analyzed().toString().splitlines() if "Window" in x]
    assert windows and all("_b" in x or "_t" in x for x in windows)
