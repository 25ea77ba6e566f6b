"""Queries of section 2.11 on models: importance, dependence, attribution, curves, tuning. SQL checks what a linear model makes exact."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import explain as E
from tesserae.operators import models as M
from tesserae.plans.describing import rounded
from tesserae.plans.modelling import X, Y, items
from tesserae.plans.registry import query
from tesserae.plans.tables import KEY
from tesserae.session import table

AB = ["l_quantity", "l_discount"]
#: Least squares on two columns, from sums of products.
FIT = f"s as (select avg({Y}) as my, avg(l_quantity) as m1, avg(l_discount) as m2, var_pop(l_quantity) as v1, var_pop(l_discount) as v2, covar_pop(l_quantity, l_discount) as v12, covar_pop({Y}, l_quantity) as y1, covar_pop({Y}, l_discount) as y2 from lineitem), f as (select *, (y1 * v2 - y2 * v12) / (v1 * v2 - v12 * v12) as b1, (y2 * v1 - y1 * v12) / (v1 * v2 - v12 * v12) as b2 from s)"


@query("permutation_importance")
def _(spark, d):
    x = items(spark, d)
    return rounded(E.permutation_importance(x, M.fit("gram_ridge", x, X, Y), X, Y, KEY))


@query("partial_dependence", f"with {FIT}, u as (select distinct l_quantity as value from lineitem), c as (select count(*) as n from u), q as (select quantile_cont(l_quantity, 0.02) as lo, quantile_cont(l_quantity, 0.98) as hi from lineitem), v as (select value from u, c where n <= 20 union all select lo + (hi - lo) * i / 19 from q, c, range(20) t(i) where n > 20) select 'l_quantity' as variable, {{{{value}}}} as value, {{{{my + b1 * (value - m1)}}}} as mean, {{{{abs(b2) * sqrt(v2)}}}} as sd, case when b1 > 0 then 'rising in a line' else 'falling in a line' end as trend from v, f")
def _(spark, d):
    x = items(spark, d)
    return rounded(E.partial_dependence(x, M.fit("gram_ridge", x, AB, Y), AB, "l_quantity"))


@query("explain_rows", f"with {FIT}, k as (select * from lineitem order by l_orderkey, l_linenumber, l_partkey, l_suppkey limit 20), b as (select avg(l_quantity) as k1, avg(l_discount) as k2 from k), e as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, b1 * (l_quantity - k1) as e1, b2 * (l_discount - k2) as e2 from lineitem, f, b) select l_orderkey, l_linenumber, l_partkey, l_suppkey, 'l_quantity' as variable, case when abs(e1) < 0.005 then 0.0 else round(e1, 2) end as effect from e union all select l_orderkey, l_linenumber, l_partkey, l_suppkey, 'l_discount', case when abs(e2) < 0.005 then 0.0 else round(e2, 2) end from e")
def _(spark, d):
    x = items(spark, d)
    got = E.explain_rows(x, M.fit("gram_ridge", x, AB, Y), AB, KEY, x, most=20)
    return got.select(*KEY, "variable", F.when(F.abs("effect") < 0.005, 0.0).otherwise(F.round("effect", 2)).alias("effect"))


@query("learning_curve")
def _(spark, d):
    return rounded(E.learning_curve(items(spark, d), "gram_ridge", X, Y, KEY))


@query("tune")
def _(spark, d):
    return rounded(E.tune(items(spark, d), "gram_ridge", X, Y, KEY, {"alpha": [0.0, 1.0, 100.0]}))


@query("tune_random")
def _(spark, d):
    return rounded(E.tune(items(spark, d), "gram_ridge", X, Y, KEY, {"alpha": (1e-3, 1e3, "log")}, draws=5, seed=3))


@query("sensitivity_run")
def _(spark, d):
    return rounded(E.sensitivity_run(items(spark, d), X, Y, KEY))


@query("cluster_count_sweep")
def _(spark, d):
    return rounded(E.cluster_count_sweep(table(spark, d, "orders").select((F.col("o_totalprice") / 1000).alias("price"), F.year("o_orderdate").cast("double").alias("year")), ["price", "year"], range(2, 7)))
