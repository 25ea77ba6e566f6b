"""Exact quantiles and ranks, folds, rates and profile rules against NumPy and pandas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import evaluate, kernels, models, preprocess, profile

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(rng.normal()), float(rng.integers(0, 4)), None if i % 3 else float(i), "a" if i % 5 else "b", None) for i in range(5000)]
    return spark.createDataFrame(rows, "id long, x double, few double, gaps double, g string, none double").repartition(5)


@pytest.mark.parametrize("between", [1_000_000, 3])
def test_quantiles_are_exact(table, monkeypatch, between):
    monkeypatch.setattr(kernels, "BETWEEN", between)  # 3: every bracket is sketched again
    pdf = table.toPandas()
    got = kernels.quantiles(table, ["x", "few", "gaps", "none"], PROBS)
    assert got["none"] is None
    for c in ("x", "few", "gaps"):
        assert np.allclose(got[c], np.quantile(pdf[c].dropna(), PROBS), rtol=1e-12)
    assert kernels.quantiles(table.limit(0), ["x"], PROBS) == {"x": None}



def test_group_quantiles_are_exact(table):
    pdf = table.toPandas()
    for r in kernels.group_quantiles(table, ["g"], "x", PROBS).collect():
        assert np.allclose(r["q"], np.quantile(pdf["x"][pdf["g"] == r["g"]], PROBS), rtol=1e-12)


@pytest.mark.parametrize("values", [200_000, 37])
def test_ranks_over_any_number_of_ranges(table, monkeypatch, values):
    monkeypatch.setattr(kernels, "RANGE_VALUES", values)
    pdf = table.toPandas()
    for c in ("x", "few"):
        got = {r[c]: r["rank"] for r in kernels.global_ranks(table, c).collect()}
        want = dict(zip(pdf[c], pdf[c].rank(), strict=True))
        assert got == want


def test_folds_share_every_level_to_a_row(table):
    got = models.stratified_folds(table, ["id"], "g", 4)
    assert got.count() == 5000 and got.select("id").distinct().count() == 5000
    sizes = {(r["g"], r["fold"]): r["count"] for r in got.groupBy("g", "fold").count().collect()}
    assert {v for (g, _), v in sizes.items() if g == "a"} == {1000} and {v for (g, _), v in sizes.items() if g == "b"} == {250}
    a, b = models.stratified_holdout(table, ["id"], "g", 0.2)
    assert b.where("g = 'b'").count() == 200 and a.count() + b.count() == 5000


def test_time_folds_follow_each_other(spark):
    t = spark.range(600).select("id", (F.lit("2024-01-01").cast("timestamp") + F.make_interval(hours=F.col("id").cast("int"))).alias("t"))
    edges = models.time_folds(t, "t", 5).groupBy("fold").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count(F.lit(1)).alias("n")).orderBy("fold").collect()
    assert [r["n"] for r in edges] == [100] * 6 and all(x["b"] < y["a"] for x, y in zip(edges, edges[1:]))


def test_rates_of_several_classes(spark):
    rows = [("a", "a")] * 5 + [("a", "b")] * 2 + [("b", "b")] * 4 + [("c", "a")] * 3 + [(None, "a")]
    got = {r["class"]: r for r in evaluate.confusion_rates(spark.createDataFrame(rows, "y string, p string"), "y", "p").collect()}
    assert (got["a"]["tp"], got["a"]["fp"], got["a"]["fn"], got["a"]["tn"]) == (5, 3, 2, 4)
    assert got["c"]["sensitivity"] == 0.0 and got["c"]["specificity"] == 1.0


def test_robust_errors_against_the_sandwich(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 2))
    y = 1 + x @ [2.0, -1.0] + rng.normal(size=400) * (1 + np.abs(x[:, 0]))
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")
    z = np.column_stack((np.ones(400), x))
    inv = np.linalg.inv(z.T @ z)
    beta = inv @ z.T @ y
    e, h = y - z @ beta, np.einsum("ij,jk,ik->i", z, inv, z)
    cov = inv @ (z * ((e / (1 - h)) ** 2)[:, None]).T @ z @ inv
    got = models.ols_robust_errors(df, ["a", "b"], "y").collect()
    assert np.allclose([r["coefficient"] for r in got], beta) and np.allclose([r["se_hc3"] for r in got], np.sqrt(np.diag(cov)))


def test_levels_have_a_bound(spark, monkeypatch):
    monkeypatch.setattr(preprocess, "MOST_LEVELS", 5)
    df = spark.range(40).select(F.col("id").cast("string").alias("c"), F.lit("x").alias("one"))
    with pytest.raises(ValueError):
        preprocess.fit("ordinal_encode", df, ["c"])
    assert preprocess.fit("one_hot_encode", df, ["one"])["learned"] == {"one": ["x"]}


def test_types_of_texts(spark):
    rows = [(i, f"2024-01-{1 + i % 28:02d}", f"R{i},{i % 7}00.5", ["low", "High", "medium"][i % 3], f"grade {i % 3}", f"u{i}", "some words that go on and on for long " * 2 + str(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "n long, day string, paid string, level string, mark string, code string, note string")
    got = {r["column"]: r["semantic_type"] for r in profile.infer_semantic_types(df).collect()}
    assert got == {"n": "identifier", "day": "datetime", "paid": "numeric_continuous", "level": "categorical_ordinal", "mark": "categorical_ordinal", "code": "identifier", "note": "text"}
    types = dict(profile.typed(df, profile.infer_semantic_types(df)).dtypes)
    assert types["day"] == "timestamp" and types["paid"] == "double"


def test_latent_classes_and_fuzzy_members(spark):
    rng = np.random.default_rng(6)
    z = rng.random(3000) < 0.4
    rate = np.array([[0.9, 0.8, 0.9, 0.1], [0.1, 0.2, 0.2, 0.8]])
    x = (rng.random((3000, 4)) < rate[z.astype(int)]).astype(int)
    df = spark.createDataFrame([(i, bool(b), *map(int, r)) for i, (b, r) in enumerate(zip(z, x, strict=True))], "id long, z boolean, a int, b int, c int, d int")
    items = ["a", "b", "c", "d"]
    sweep = {r["k"]: r for r in models.latent_class_sweep(df, items, 3).collect()}
    assert sweep[2]["chosen"] and sweep[2]["bic"] < min(sweep[1]["bic"], sweep[3]["bic"])
    prior, rates = models.latent_class(df, items)
    assert np.abs(prior - [0.6, 0.4]).max() < 0.05 and np.abs(rates - rate).max() < 0.1
    got = models.latent_class_members(df, items, prior, rates).toPandas()
    assert np.allclose([sum(m) for m in got["membership"]], 1) and ((got["class"] == 1) == got["z"]).mean() > 0.85
    pts = spark.createDataFrame([(float(v), float(v * 2)) for v in np.concatenate((rng.normal(0, 0.2, 200), rng.normal(9, 0.2, 200)))], "p double, q double")
    members = models.fuzzy_members(pts, ["p", "q"], models.fuzzy_cmeans(pts, ["p", "q"], 2))
    assert models.partition_coefficient(members).first()[0] > 0.98 and {r["count"] for r in members.groupBy("cluster").count().collect()} == {200}


def test_latent_classes_of_many_items(spark):
    """24 items: nearly every row is a pattern of its own. Adjusted Rand index of the planted classes, and the mixture's likelihood by hand."""
    rng = np.random.default_rng(16)
    z = rng.choice(3, 2500, p=[0.5, 0.3, 0.2])
    rate = np.where(rng.random((3, 24)) < 0.5, 0.8, 0.2)
    x = (rng.random((2500, 24)) < rate[z]).astype(int)
    items = [f"q{i}" for i in range(24)]
    df = spark.createDataFrame([(int(c), *map(int, r)) for c, r in zip(z, x, strict=True)] + [(9, *[None] * 24)], "z int, " + ", ".join(f"{i} int" for i in items))
    assert models.answer_patterns(df, items).count() > 2000
    prior, got = models.latent_class(df, items, 3)
    assert np.abs(prior - [0.5, 0.3, 0.2]).max() < 0.05
    members = models.latent_class_members(df, items, prior, got).where("z < 9").toPandas()
    table = members.groupby(["z", "class"]).size().unstack(fill_value=0).to_numpy()
    pairs = lambda v: (v * (v - 1) / 2).sum()
    a, b, both, every = pairs(table.sum(axis=1)), pairs(table.sum(axis=0)), pairs(table), pairs(np.array([2500]))
    assert (both - a * b / every) / ((a + b) / 2 - a * b / every) > 0.7
    like = np.log((prior * np.prod(np.where(x[:, None, :] == 1, got, 1 - got), axis=2)).sum(axis=1))
    assert np.allclose(models.responsibilities(x.astype(float), prior, got)[0], like)


def test_three_classes_one_against_the_rest(spark):
    rng = np.random.default_rng(7)
    y = rng.integers(0, 3, 300)
    df = spark.createDataFrame([(float(a + 6 * (k == 1)), float(b + 6 * (k == 2)), float(k)) for k, a, b in zip(y, rng.normal(size=300), rng.normal(size=300), strict=True)], "a double, b double, y double")
    for name in ("gbt", "linear_svc"):
        got = models.fit(name, df, ["a", "b"], "y", maxIter=5)(df)
        assert got.agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0] > 0.9


@pytest.mark.parametrize("outright", [0, 10**9])
def test_column_counts_against_counters(spark, monkeypatch, outright):
    from collections import Counter

    monkeypatch.setattr(kernels, "OUTRIGHT", outright)
    monkeypatch.setattr(kernels, "COUNTED", 50)
    rng = np.random.default_rng(8)
    n = 4000
    cols = {
        "key": np.arange(n) + 10**9,  # bitmaps, all different
        "gaps": rng.permutation(n) * 10**12,  # all different, too sparse for bitmaps
        "skewed": np.where(rng.random(n) < 0.4, 7, rng.integers(0, 3000, n)),  # one frequent item
        "flat": rng.integers(0, 900, n),
        "few": rng.integers(0, 5, n),
        "real": np.where(rng.random(n) < 0.2, 0.5, rng.normal(size=n)),
    }
    rows = [tuple(None if k % 9 == 0 and name in ("flat", "real", "word") else v for name, v in zip([*cols, "word", "tied", "none"], (*[c[k].item() for c in cols.values()], f"w{k % 1500}", ["b", "a"][k % 2], None), strict=True)) for k in range(n)]
    df = spark.createDataFrame(rows, "key long, gaps long, skewed long, flat int, few int, real double, word string, tied string, none string")
    got = {r.variable: tuple(r)[1:] for r in kernels.column_counts(df, df.columns).collect()}
    for i, c in enumerate(df.columns):
        count = Counter(str(r[i]) for r in rows if r[i] is not None)
        most = max(count.values(), default=None)
        dominant = min((v for v, k in count.items() if k == most), default=None)
        assert got[c] == (n, n - sum(count.values()), len(count), most, dominant), c
    assert {r.variable: r.distinct for r in kernels.column_counts(df, df.columns, mode=False).collect()} == {c: v[2] for c, v in got.items()}
    assert [tuple(r) for r in kernels.column_counts(df.limit(0), ["key"]).collect()] == [("key", 0, 0, 0, None, None)]


def test_very_many_quantiles_are_exact(spark, monkeypatch):
    """each order statistic was bracketed and sketched by itself, and a row compared with all edges one by one."""
    monkeypatch.setattr(kernels, "GRID", 64)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=4000), np.full(1500, 0.25), np.round(rng.normal(size=1500), 1)])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double")
    probs = [i / 200 for i in range(201)]
    assert np.allclose(kernels.quantiles(df, ["x"], probs)["x"], np.quantile(x, probs), rtol=1e-12, atol=1e-12)
    assert kernels.quantiles(df.where("x is null"), ["x"], probs)["x"] is None
    got = preprocess.fit_transform("quantile_normal", df.withColumnRenamed("x", "y").withColumn("x", F.col("y")), ["x"])
    assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = [(r.y, r.x) for r in got.collect()]
    assert [z for y, z in rows if y is None or np.isnan(y)] == [None, None]
    rows = sorted(p for p in rows if p[1] is not None)
    assert len(rows) == 7000 and all(a[1] <= b[1] for a, b in zip(rows, rows[1:], strict=False)) and rows[0][1] < -5 and rows[-1][1] > 5


def test_iterative_filling_reads_the_table_twice(spark, monkeypatch):
    """every round of a fit read all rows again."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 3))
    x[:, 2] += x[:, 0] - 2 * x[:, 1]
    gone = rng.random((400, 3)) < 0.2
    gone[:, 1] = False
    rows = [tuple(None if g else float(v) for v, g in zip(r, m, strict=True)) for r, m in zip(x, gone, strict=True)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    monkeypatch.setattr(preprocess, "MOST_GAPS", -1)
    plain = preprocess.fit("impute_iterative", df, ["a", "b", "c"], rounds=4)["learned"]["rounds"]
    monkeypatch.undo()
    monkeypatch.setattr(preprocess, "gram", None)  # a pass a round
    got = preprocess.fit("impute_iterative", df, ["a", "b", "c"], rounds=4)["learned"]["rounds"]
    for one, two in zip(got, plain, strict=True):
        for c in ("a", "c"):
            assert np.isclose(one[c][0], two[c][0], atol=1e-10) and all(np.isclose(one[c][1][k], two[c][1][k], atol=1e-10) for k in two[c][1])
    assert set(got[0]) == {"a", "c"}


def test_memberships_are_worked_out_once(spark):
    """the likelihood of each class was written out again wherever a share used it."""
    df = spark.createDataFrame([(i % 2, i // 2 % 2, i // 4 % 2 if i < 16 else None) for i in range(20)], "a int, b int, c int")
    prior, rate = np.array([0.6, 0.4]), np.array([[0.9, 0.2, 0.7], [0.3, 0.8, 0.1]])
    got = models.latent_class_members(df, ["a", "b", "c"], prior, rate)
    assert got.columns == ["a", "b", "c", "membership", "class"]
    assert got._jdf.queryExecution().optimizedPlan().toString().lower().count("exp(") <= 4  # one a class, and its name
    for r in got.collect():
        if r.c is None:
            assert r.membership is None and r["class"] is None
        else:
            x = np.array([r.a, r.b, r.c])
            like = prior * np.prod(np.where(x == 1, rate, 1 - rate), axis=1)
            assert np.allclose(r.membership, like / like.sum(), rtol=1e-12) and r["class"] == int(np.argmax(like))


@pytest.mark.parametrize("how", ["median", "mean"])
def test_fillings_of_few_groups_are_broadcast(spark, how):
    """all rows went to the task of their group and were sorted there."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    try:
        df = spark.range(200_000).select((F.col("id") % 3).cast("string").alias("g"), F.when(F.col("id") % 10 > 0, (F.col("id") % 50).cast("double")).alias("x"))
        got = preprocess.fit_transform("impute_by_group", df, ["x"], group="g", how=how)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert got.where("x is null").count() == 0 and got.count() == 200_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_means_of_few_groups_are_broadcast(spark):
    """all rows went to the task of their group, as the size of the groups' means was not known."""
    from tesserae.operators import rows

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    try:
        df = spark.range(200_000).select((F.col("id") % 3).cast("string").alias("g"), F.when(F.col("id") % 10 > 0, F.col("id").cast("double")).alias("x"))
        got = rows.join_group_statistic(df, "g", "x")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert got.where("x is null").count() == 0 and got.count() == 200_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_few_texts_are_judged_once(spark, monkeypatch):
    """every text of a column was parsed as a number and by each date format, whether seen before or not."""
    asked = []
    monkeypatch.setattr(profile, "_text_measures", lambda f=profile._text_measures: (asked.append(1), f())[1])
    df = spark.createDataFrame([(["low", "high", None, "medium"][i % 4], ["2024-01-0%d" % (i % 3 + 1), "2024-02-01"][i % 2], str(i * 1.5), i, float(i % 3)) for i in range(400)], "a string, b string, c string, d long, e double")
    want = {"a": "categorical_ordinal", "b": "datetime", "c": "numeric_continuous", "d": "identifier", "e": "numeric_discrete"}
    assert {r["column"]: r.semantic_type for r in profile.infer_semantic_types(df).collect()} == want
    monkeypatch.setattr(profile, "COUNTED", 0)  # no column has few texts: each row is judged
    assert {r["column"]: r.semantic_type for r in profile.infer_semantic_types(df).collect()} == want
    assert len(asked) == 6
