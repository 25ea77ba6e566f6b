"""Queries of section 2.10: models on lineitem and embeddings. SQL checks the closed forms."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tesserae.operators import models as M
from tesserae.plans.describing import rounded
from tesserae.plans.registry import query
from tesserae.plans.tables import KEY
from tesserae.session import table

X = ["l_quantity", "l_discount", "l_tax"]
Y = "l_extendedprice"
K = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def items(spark, d):
    return table(spark, d, "lineitem").withColumn("label", (F.col("l_returnflag") == "R").cast("int"))


def summary(df, actual=Y):
    """What a fit is worth, over all rows: error, and the mean prediction."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg("prediction").alias("mean_prediction"), F.sqrt(F.avg((F.col("prediction") - F.col(actual)) ** 2)).alias("rmse"))


def regression(name, model, cols=X, **options):
    query(name)(lambda spark, d: summary(M.fit(model, items(spark, d), cols, Y, **options)(items(spark, d))))


def classifier(name, model, cols=X, label="label", **options):
    def run(spark, d):
        x = items(spark, d)
        got = M.fit(model, x, cols, label, **options)(x)
        return got.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("accuracy"))

    query(name)(run)


@query("fit_linear_regression", f"select {K}, {{{{a + b * l_quantity}}}} as prediction from lineitem, (select regr_slope({Y}, l_quantity) as b, regr_intercept({Y}, l_quantity) as a from lineitem)")
def _(spark, d):
    x = items(spark, d)
    return rounded(M.fit("gram_ridge", x, ["l_quantity"], Y)(x).select(*KEY, "prediction"))


X2 = ["l_quantity", "l_discount"]


def two(u: str, v: str, y: str, alpha: float, value: str, source: str = "lineitem") -> str:
    """SQL of a ridge on two columns by its normal equations; value: what to return, of b1, b2, b0, u and v."""
    sums = f"select regr_sxx({y}, {u}) + {alpha} as s11, regr_sxx({y}, {v}) + {alpha} as s22, covar_pop({u}, {v}) * count(*) as s12, covar_pop({u}, {y}) * count(*) as s1, covar_pop({v}, {y}) * count(*) as s2, avg({u}) as m1, avg({v}) as m2, avg({y}) as my from {source}"
    solved = "select *, (s1 * s22 - s2 * s12) / (s11 * s22 - s12 * s12) as b1, (s2 * s11 - s1 * s12) / (s11 * s22 - s12 * s12) as b2 from s"
    return f"with s as ({sums}), w as ({solved}), b as (select *, my - b1 * m1 - b2 * m2 as b0 from w) select {K}, {value} as prediction from {source}, b"


FITTED = "{{b0 + b1 * l_quantity + b2 * l_discount}}"


@query("fit_ridge", two("l_quantity", "l_discount", Y, 1.0, FITTED))
def _(spark, d):
    return rounded(M.fit("ridge", items(spark, d), X2, Y, alpha=1.0)(items(spark, d)).select(*KEY, "prediction"))


@query("fit_pls", two("l_quantity", "l_discount", Y, 0.0, FITTED))
def _(spark, d):
    """As many components as columns: least squares."""
    return rounded(M.fit("pls", items(spark, d), X2, Y, components=2)(items(spark, d)).select(*KEY, "prediction"))


@query("fit_polynomial", two("l_quantity", "l_quantity * l_quantity", Y, 1e-6, "{{b0 + b1 * l_quantity + b2 * l_quantity * l_quantity}}"))
def _(spark, d):
    return rounded(M.fit("polynomial", items(spark, d), ["l_quantity"], Y)(items(spark, d)).select(*KEY, "prediction"))


@query("fit_ridge_classifier", two("l_quantity", "l_discount", "y", 1.0, "case when b0 + b1 * l_quantity + b2 * l_discount > 0 then 1 else 0 end", "(select *, case when l_returnflag = 'R' then 1.0::double else -1.0 end as y from lineitem)"))
def _(spark, d):
    x = items(spark, d)
    return M.fit("ridge_classifier", x, X2, "label")(x).select(*KEY, "prediction")


@query("fit_discriminant", f"with x as (select *, (l_returnflag = 'R')::int as c from lineitem), g as (select c, count(*)::double as n, avg(l_quantity) as m1, avg(l_discount) as m2, var_samp(l_quantity) + 1e-9 as a, var_samp(l_discount) + 1e-9 as b, covar_samp(l_quantity, l_discount) as k from x group by 1) select {K}, arg_max(c, score) as prediction from (select {K}, g.c, x.i, ln(n / (select count(*) from x)) - 0.5 * ln(a * b - k * k) - 0.5 * (b * (l_quantity - m1) ** 2 - 2 * k * (l_quantity - m1) * (l_discount - m2) + a * (l_discount - m2) ** 2) / (a * b - k * k) as score from (select *, row_number() over () as i from lineitem) x, g) group by {K}, i")
def _(spark, d):
    x = items(spark, d)
    return M.fit("discriminant", x, X2, "label", quadratic=True)(x).select(*KEY, "prediction")


@query("ols_summary", f"with s as (select regr_slope({Y}, l_quantity) as b, regr_intercept({Y}, l_quantity) as a, regr_syy({Y}, l_quantity) as tss, regr_r2({Y}, l_quantity) as r2, count(*) as n from lineitem), e as (select {Y} - a - b * l_quantity as e from lineitem, s), m as (select avg(e) as me, var_pop(e) as v from e), j as (select avg((e - me) ** 3) / any_value(v) ** 1.5 as g1, avg((e - me) ** 4) / any_value(v) ** 2 - 3 as g2 from e, m), l as (select *, tss * (1 - r2) as rss, -n / 2 * (ln(2 * pi()) + ln(tss * (1 - r2) / n) + 1) as ll from s) select n, {{{{r2}}}} as r2, {{{{1 - (1 - r2) * (n - 1) / (n - 2)}}}} as adjusted_r2, {{{{r2 / ((1 - r2) / (n - 2))}}}} as f, {{{{ll}}}} as log_likelihood, {{{{4 - 2 * ll}}}} as aic, {{{{ln(n) * 2 - 2 * ll}}}} as bic, {{{{n / 6 * (g1 ** 2 + g2 ** 2 / 4)}}}} as jarque_bera, {{{{exp(-n / 12 * (g1 ** 2 + g2 ** 2 / 4))}}}} as jarque_bera_p from l, j")
def _(spark, d):
    return rounded(M.ols_summary(items(spark, d), ["l_quantity"], Y).drop("f_p"))


@query("ols_durbin_watson", f"with s as (select regr_slope({Y}, l_quantity) as b, regr_intercept({Y}, l_quantity) as a from lineitem), e as (select {K}, {Y} - a - b * l_quantity as e from lineitem, s), d as (select e, e - lag(e) over (order by {K}, e) as d from e) select count(*) as n, {{{{sum(d * d) / sum(e * e)}}}} as durbin_watson from d")
def _(spark, d):
    return rounded(M.durbin_watson(items(spark, d), ["l_quantity"], Y, KEY))


@query("ols_robust_errors", f"with s as (select regr_slope({Y}, l_quantity) as b, regr_intercept({Y}, l_quantity) as a, regr_sxx({Y}, l_quantity) as sxx, avg(l_quantity) as m, count(*) as n from lineitem), x as (select l_quantity - m as z, (({Y} - a - b * l_quantity) / (1 - 1 / n - (l_quantity - m) ** 2 / sxx)) ** 2 as w from lineitem, s), t as (select sum(w) as t0, sum(w * z) as t1, sum(w * z * z) as t2 from x) select 'l_quantity' as term, {{{{b}}}} as coefficient, {{{{sqrt(t2) / sxx}}}} as se_hc3 from s, t union all select 'intercept', {{{{a}}}}, {{{{sqrt(t0 / (n * n) - 2 * m * t1 / (n * sxx) + m * m * t2 / (sxx * sxx))}}}} from s, t")
def _(spark, d):
    return rounded(M.ols_robust_errors(items(spark, d), ["l_quantity"], Y))


for _n, _m, _o in (("fit_lasso", "lasso", {}), ("fit_elastic_net", "elastic_net", {}), ("fit_bayesian_ridge", "bayesian_ridge", {}), ("fit_huber", "huber", {}), ("fit_quantile_regression", "quantile_regression", {}), ("fit_poisson", "poisson", {}), ("fit_gamma", "gamma", {}), ("fit_tweedie", "tweedie", {}), ("fit_random_forest", "random_forest_regression", {}), ("fit_gbt", "gbt_regression", {}), ("fit_bagging", "bagging", {}), ("fit_stacking", "stacking", {"key": KEY})):
    regression(_n, _m, **_o)
for _n, _m, _o in (("fit_decision_tree", "decision_tree", {}), ("fit_adaboost", "adaboost", {}), ("fit_logistic", "logistic", {}), ("fit_naive_bayes", "naive_bayes", {}), ("fit_linear_svc", "linear_svc", {}), ("fit_mlp_classifier", "mlp_classifier", {"layers": [3, 4, 2], "maxIter": 20})):
    classifier(_n, _m, **_o)


for _n, _m, _o in (("fit_voting_classes", "voting_classes", {}), ("fit_bagging_classes", "bagging_classes", {}), ("fit_stacking_classes", "stacking_classes", {"key": KEY})):
    classifier(_n, _m, **_o)
regression("fit_adaboost_regression", "adaboost_regression")


@query("fit_voting")
def _(spark, d):
    x = items(spark, d)
    return summary(M.fit_average(["ridge", "random_forest_regression", "gbt_regression"])(x, X, Y)(x))


def knn_sql(target, answer, name="prediction", reference="true", asked="true"):
    """The k = 5 nearest in quantity and discount: different vectors against the five least values of each, ties to the lesser."""
    return f"""with r as (select l_quantity as q, l_discount as s, {target} as y from lineitem where {reference} qualify row_number() over (partition by l_quantity, l_discount order by {target}) <= 5),
c as (select distinct l_quantity as q, l_discount as s from lineitem where {asked}),
n as (select c.q, c.s, r.y, (c.q - r.q) * (c.q - r.q) + (c.s - r.s) * (c.s - r.s) as d from c cross join r qualify row_number() over (partition by c.q, c.s order by d, r.y) <= 5),
m as (select q, s, {answer} as answer from n group by 1, 2)
select {K}, answer as {name} from lineitem join m on q = l_quantity and s = l_discount where {asked}"""


@query("fit_knn", knn_sql(Y, "{{avg(y)}}"))
def _(spark, d):
    x = items(spark, d)
    return rounded(M.fit("knn", x, X2, Y)(x).select(*KEY, "prediction"))


@query("fit_knn_classes", f"with a as ({knn_sql('l_linenumber', 'list(y)')}) select {K}, (select v from (select v, count(*) as m from (select unnest(prediction) as v) group by 1) order by m desc, v limit 1)::double as prediction from a")
def _(spark, d):
    x = items(spark, d)
    return M.fit("knn", x, X2, "l_linenumber", classes=True)(x).select(*KEY, "prediction")


@query("baseline_dummy", f"select {K}, {{{{(select avg({Y}) from lineitem)}}}} as prediction from lineitem")
def _(spark, d):
    x = items(spark, d)
    return rounded(M.fit("baseline_dummy", x, X, Y)(x).select(*KEY, "prediction"))


@query("fit_ols_inference", f"with s as (select regr_slope({Y}, l_quantity) as b, regr_intercept({Y}, l_quantity) as a, regr_sxx({Y}, l_quantity) as sxx, regr_syy({Y}, l_quantity) as syy, regr_r2({Y}, l_quantity) as r2, avg(l_quantity) as mx, count(*) as n from lineitem), e as (select *, syy * (1 - r2) / (n - 2) as s2 from s) select 'l_quantity' as term, {{{{b}}}} as coefficient, {{{{sqrt(s2 / sxx)}}}} as se, {{{{b / sqrt(s2 / sxx)}}}} as t, {{{{r2}}}} as r2, n from e union all select 'intercept', {{{{a}}}}, {{{{sqrt(s2 * (1 / n + mx * mx / sxx))}}}}, {{{{a / sqrt(s2 * (1 / n + mx * mx / sxx))}}}}, {{{{r2}}}}, n from e")
def _(spark, d):
    return rounded(M.ols_inference(items(spark, d), ["l_quantity"], Y).drop("p", "low", "high"))


def clusters(name, model):
    def run(spark, d):
        x = items(spark, d)
        return M.fit(model, x, ["l_quantity", "l_discount"], k=3)(x).groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))

    query(name)(run)


for _n, _m in (("fit_kmeans", "kmeans"), ("fit_bisecting", "bisecting")):
    clusters(_n, _m)


@query("fit_gmm")
def _(spark, d):
    """Rows that each component is the likeliest for, and the sum of all rows' memberships in it."""
    x, k = items(spark, d), 3
    got = M.fit("gmm", x, X2, k=k)(x).select("prediction", vector_to_array("probability").alias("share"))
    each = [F.struct(F.lit(j).alias("prediction"), F.count_if(F.col("prediction") == j).alias("n"), F.sum(F.get("share", F.lit(j))).alias("members")) for j in range(k)]
    return got.agg(F.array(*each).alias("each")).select(F.inline("each")).where("members is not null")


def frame(spark, array, names):
    return spark.createDataFrame([tuple([i, *map(float, r)]) for i, r in enumerate(np.atleast_2d(array))], "component int, " + ", ".join(f"{c} double" for c in names))


@query("fit_latent_class")
def _(spark, d):
    x = items(spark, d).select((F.col("l_quantity") > 25).cast("int").alias("a"), (F.col("l_extendedprice") > 50000).cast("int").alias("b"), "label")
    return frame(spark, M.latent_class(x, ["a", "b", "label"])[1], ["a", "b", "label"])


@query("fit_fuzzy_cmeans")
def _(spark, d):
    return frame(spark, M.fuzzy_cmeans(items(spark, d), ["l_quantity", "l_discount"]), ["l_quantity", "l_discount"])


@query("fit_power_iteration")
def _(spark, d):
    s = table(spark, d, "lineitem").select("l_suppkey", "l_linenumber").groupBy("l_suppkey", "l_linenumber").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    e = s.select(F.col("l_suppkey").alias("src"), (F.col("l_linenumber") + 1_000_000_000).cast("long").alias("dst"), "weight")
    return M.power_iteration(e, 2).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query("fit_pca", f"with c as (select var_pop(l_quantity) as a, var_pop({Y}) as b, covar_pop(l_quantity, {Y}) as k from lineitem), e as (select ((a + b) + sqrt((a - b) ** 2 + 4 * k * k)) / 2 / (a + b) as s from c) select 0 as component, {{{{s}}}} as share from e union all select 1, {{{{1 - s}}}} from e")
def _(spark, d):
    share, _ = M.principal_components(items(spark, d), ["l_quantity", Y])
    return rounded(frame(spark, share[:, None], ["share"]))


@query("fit_svd")
def _(spark, d):
    share, load = M.principal_components(items(spark, d), X, centred=False)
    return rounded(frame(spark, load, X))


@query("fit_factor_analysis")
def _(spark, d):
    return rounded(frame(spark, M.factor_analysis(items(spark, d), [*X, Y])[0].T, [*X, Y]))


@query("project_lda")
def _(spark, d):
    return rounded(frame(spark, M.lda_projection(items(spark, d), X, "l_returnflag"), X))


@query("fit_nmf")
def _(spark, d):
    e = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").cast("int").alias("row"), F.col("l_linenumber").cast("int").alias("column")).agg(F.sum("l_quantity").alias("value"))
    return M.nmf(e).select("id", F.size("features").alias("rank"))


@query("anomaly_zscore", f"with s as (select avg({Y}) as m, stddev_pop({Y}) as s, avg(l_quantity) as m2, stddev_pop(l_quantity) as s2 from lineitem) select {K}, {{{{greatest(abs(({Y} - m) / s), abs((l_quantity - m2) / s2))}}}} as score, greatest(abs(({Y} - m) / s), abs((l_quantity - m2) / s2)) > 1.7 as anomaly from lineitem, s")
def _(spark, d):
    return rounded(M.anomaly_zscore(items(spark, d), [Y, "l_quantity"], 1.7).select(*KEY, "score", "anomaly"))


@query("anomaly_iqr", f"with q as (select quantile_cont({Y}, 0.25) as a, quantile_cont({Y}, 0.75) as b from lineitem), z as (select {K}, greatest((a - {Y}) / (b - a), ({Y} - b) / (b - a), 0) as s from lineitem, q) select {K}, {{{{s}}}} as score, s > 0.4 as anomaly from z")
def _(spark, d):
    return rounded(M.anomaly_iqr(items(spark, d), [Y], 0.4).select(*KEY, "score", "anomaly"))


@query("anomaly_mahalanobis")
def _(spark, d):
    return rounded(M.anomaly_mahalanobis(items(spark, d), X).select(*KEY, "score", "anomaly"))


@query("anomaly_isolation_forest")
def _(spark, d):
    return rounded(M.isolation_forest(items(spark, d), X, key=KEY).select(*KEY, "score"))


@query("anomaly_reasons")
def _(spark, d):
    x = items(spark, d)
    return M.anomaly_reasons(x, M.anomaly_zscore(x, [Y, "l_quantity"], 1.7), KEY, [Y, "l_quantity"])


@query("cross_validate")
def _(spark, d):
    got = M.cross_validate(items(spark, d), "ridge", X, Y, KEY, 3)
    return got.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg((F.col("actual") - F.col("prediction")) ** 2)).alias("rmse"))


@query("train_holdout")
def _(spark, d):
    a, b = M.train_holdout(table(spark, d, "orders"), ["o_orderkey"])
    return a.withColumn("part", F.lit("train")).unionAll(b.withColumn("part", F.lit("held out"))).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("stratified_folds", f"with x as (select l_returnflag, count(*) as n, unnest(range(0, 5)) as fold from lineitem group by 1) select l_returnflag, fold::int as fold, n // 5 + (fold < n % 5)::int as n from x")
def _(spark, d):
    return M.stratified_folds(table(spark, d, "lineitem"), KEY, "l_returnflag").groupBy("l_returnflag", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("time_folds", "with q as (select " + ", ".join(f"quantile_cont(epoch(o_orderdate)::double, {i} / 6) as q{i}" for i in range(1, 6)) + " from orders) select (" + " + ".join(f"(epoch(o_orderdate) > q{i})::int" for i in range(1, 6)) + ") as fold, count(*) as n from orders, q group by 1")
def _(spark, d):
    return M.time_folds(table(spark, d, "orders"), "o_orderdate").groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@query("time_holdout", "with q as (select quantile_cont(epoch(o_orderdate)::double, 0.8) as c from orders) select case when epoch(o_orderdate) <= c then 'train' else 'held out' end as part, count(*) as n from orders, q group by 1")
def _(spark, d):
    a, b = M.time_holdout(table(spark, d, "orders"), "o_orderdate")
    return a.withColumn("part", F.lit("train")).unionAll(b.withColumn("part", F.lit("held out"))).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("cross_validate_by_time")
def _(spark, d):
    got = M.cross_validate(items(spark, d), "ridge", X, Y, KEY, 3, time="l_shipdate")
    return got.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg((F.col("actual") - F.col("prediction")) ** 2)).alias("rmse"))


def answers(spark, d):
    return M.median_items(items(spark, d), ["l_quantity", "l_extendedprice"])


ITEMS = ["l_quantity", "l_extendedprice", "label"]


@query("latent_class_sweep")
def _(spark, d):
    return M.latent_class_sweep(answers(spark, d), ITEMS)


@query("latent_class_members")
def _(spark, d):
    x = answers(spark, d)
    got = M.latent_class_members(x, ITEMS, *M.latent_class(x, ITEMS))
    return got.select(*KEY, "class", F.array_max("membership").alias("share"))


@query("fuzzy_members")
def _(spark, d):
    x = items(spark, d)
    got = M.fuzzy_members(x, X2, M.fuzzy_cmeans(x, X2))
    return got.select(*KEY, "cluster", F.array_max("membership").alias("share"))


@query("gmm_sweep")
def _(spark, d):
    return M.gmm_sweep(items(spark, d), X2)


@query("fit_gbt_classes")
def _(spark, d):
    x = items(spark, d).withColumn("flag", (F.ascii("l_returnflag") % 3).cast("double"))
    return M.fit("gbt", x, X, "flag", maxIter=5)(x).groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))
