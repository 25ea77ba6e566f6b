"""Queries of section 2.9: preprocessing steps on lineitem, orders and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import preprocess as P
from tesserae.plans.describing import rounded
from tesserae.plans.registry import query
from tesserae.plans.tables import GAP, KEY, gappy
from tesserae.session import table

K = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
G = f"(select * exclude (l_quantity), {GAP} as l_quantity from lineitem)"
X = "l_extendedprice"


def one(name, sql, cols, source="gap", extra=(), keep=None, **options):
    """Register fit_transform of a step; the result has the row's key and the named columns."""

    def run(spark, d):
        df = gappy(spark, d) if source == "gap" else table(spark, d, source)
        got = P.fit_transform(name, df, list(cols), **options)
        key = KEY if source in ("gap", "lineitem") else ["o_orderkey"] if source == "orders" else ["doc_id"]
        return rounded(got.select(*key, *(keep or cols), *extra))

    query(name, sql)(run)


for _n, _f in (("impute_mean", "avg(l_quantity)"), ("impute_median", "quantile_cont(l_quantity, 0.5)")):
    one(_n, f"select {K}, {{{{coalesce(l_quantity, (select {_f} from {G}))}}}} as l_quantity from {G}", ["l_quantity"])
one("impute_mode", f"select {K}, {{{{coalesce(l_quantity, (select l_quantity from {G} where l_quantity is not null group by l_quantity order by count(*) desc, l_quantity limit 1))}}}} as l_quantity from {G}", ["l_quantity"])
one("impute_constant", f"select {K}, {{{{coalesce(l_quantity, -1)}}}} as l_quantity from {G}", ["l_quantity"], value=-1.0)
one("impute_by_group", f"with g as (select l_returnflag, quantile_cont(l_quantity, 0.5) as m from {G} group by 1) select {K}, {{{{coalesce(l_quantity, m)}}}} as l_quantity from {G} join g using (l_returnflag)", ["l_quantity"], group="l_returnflag")
one("impute_iterative", None, ["l_quantity", "l_extendedprice", "l_discount"], rounds=3)
one("winsorize", f"select {K}, {{{{least(greatest({X}, lo), hi)}}}} as {X} from lineitem, (select quantile_cont({X}, 0.01) as lo, quantile_cont({X}, 0.99) as hi from lineitem)", [X])
one("clip_iqr", f"select {K}, {{{{least(greatest({X}, a - 0.3 * (b - a)), b + 0.3 * (b - a))}}}} as {X} from lineitem, (select quantile_cont({X}, 0.25) as a, quantile_cont({X}, 0.75) as b from lineitem)", [X], k=0.3)
one("standard_scale", f"select {K}, {{{{({X} - m) / s}}}} as {X} from lineitem, (select avg({X}) as m, stddev_pop({X}) as s from lineitem)", [X])
one("minmax_scale", f"select {K}, {{{{({X} - a) / (b - a) * 2 - 1}}}} as {X} from lineitem, (select min({X}) as a, max({X}) as b from lineitem)", [X], low=-1.0, high=1.0)
one("robust_scale", f"select {K}, {{{{({X} - m) / (b - a)}}}} as {X} from lineitem, (select quantile_cont({X}, 0.25) as a, quantile_cont({X}, 0.5) as m, quantile_cont({X}, 0.75) as b from lineitem)", [X])
one("maxabs_scale", f"select {K}, {{{{{X} / (select max(abs({X})) from lineitem)}}}} as {X} from lineitem", [X])
one("normalize_rows", f"select {K}, {{{{l_quantity / n}}}} as l_quantity, {{{{{X} / n}}}} as {X} from (select *, sqrt(l_quantity ** 2 + {X} ** 2) as n from lineitem)", ["l_quantity", X], source="lineitem")
one("log_transform", f"select {K}, {{{{ln(1 + {X} + greatest(0, 1e-6 - (select min({X}) from lineitem)))}}}} as {X} from lineitem", [X])
one("yeo_johnson", None, [X])
one("box_cox", None, [X])
one("quantile_normal", None, [X])
one("binning", f"with q as (select quantile_cont({X}, [0.2, 0.4, 0.6, 0.8]) as q from lineitem) select {K}, (({X} >= q[1])::int + ({X} >= q[2])::int + ({X} >= q[3])::int + ({X} >= q[4])::int) as {X} from lineitem, q", [X])
one("binarize", f"select {K}, ({X} > 50000)::int as {X} from lineitem", [X], threshold=50000.0)
one("one_hot_encode", f"select {K}, (l_returnflag = 'A')::int as \"l_returnflag_A\", (l_returnflag = 'N')::int as \"l_returnflag_N\", (l_returnflag = 'R')::int as \"l_returnflag_R\" from lineitem", ["l_returnflag"], keep=["l_returnflag_A", "l_returnflag_N", "l_returnflag_R"])
one("ordinal_encode", f"select {K}, case l_returnflag when 'A' then 0 when 'N' then 1 when 'R' then 2 else -1 end as l_returnflag from lineitem", ["l_returnflag"])
one("frequency_encode", "select o_orderkey, {{n / t}} as o_orderpriority_freq from orders join (select o_orderpriority, count(*) as n, (select count(*) from orders) as t from orders group by 1) using (o_orderpriority)", ["o_orderpriority"], source="orders", keep=["o_orderpriority_freq"])
one("target_encode", "select o_orderkey, {{g * (1 - w) + m * w}} as o_custkey_target from orders join (select o_custkey, avg(o_totalprice) as m, 1 / (1 + exp(-(count(*) - 1) / 10)) as w, (select avg(o_totalprice) from orders) as g from orders group by 1) using (o_custkey)", ["o_custkey"], source="orders", keep=["o_custkey_target"], target="o_totalprice")
one("group_rare_categories", "select o_orderkey, case when n >= 0.2 * t then o_orderpriority else '__other__' end as o_orderpriority from orders join (select o_orderpriority, count(*) as n, (select count(*) from orders) as t from orders group by 1) using (o_orderpriority)", ["o_orderpriority"], source="orders", least=0.2)
one("polynomial_features", f"select {K}, {{{{l_discount * l_discount}}}} as \"l_discount*l_discount\", {{{{l_discount * l_tax}}}} as \"l_discount*l_tax\", {{{{l_tax * l_tax}}}} as \"l_tax*l_tax\" from lineitem", ["l_discount", "l_tax"], keep=["`l_discount*l_discount`", "`l_discount*l_tax`", "`l_tax*l_tax`"])
one("interaction_features", f"select {K}, {{{{l_discount * l_tax}}}} as l_discount_x_l_tax, {{{{case when l_tax = 0 then 0 else l_discount / l_tax end}}}} as l_discount_per_l_tax from lineitem", ["l_discount", "l_tax"], keep=["l_discount_x_l_tax", "l_discount_per_l_tax"], ratios=True)
one("aggregation_features", f"select {K}, {{{{l_discount + l_tax}}}} as row_sum, {{{{(l_discount + l_tax) / 2}}}} as row_mean, {{{{abs(l_discount - l_tax) / sqrt(2)}}}} as row_std, {{{{least(l_discount, l_tax)}}}} as row_min, {{{{greatest(l_discount, l_tax)}}}} as row_max, {{{{abs(l_discount - l_tax)}}}} as row_range from lineitem", ["l_discount", "l_tax"], source="lineitem", keep=["row_sum", "row_mean", "row_std", "row_min", "row_max", "row_range"])
one("pca_reduce", None, ["l_quantity", X, "l_discount"], source="lineitem", keep=["component_1"], k=1)
one("coerce_numeric", f"select {K}, {{{{coalesce(l_quantity, (select quantile_cont(l_quantity, 0.5) from {G}))}}}} as l_quantity from {G}", ["l_quantity"])


@query("impute_forward_fill", f"select {K}, last_value(q ignore nulls) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey rows unbounded preceding) as l_quantity from (select * exclude (l_quantity), {GAP} as q from lineitem)")
def _(spark, d):
    df = gappy(spark, d).withColumn("_o", F.struct("l_linenumber", "l_partkey", "l_suppkey"))
    return P.fit_transform("impute_forward_fill", df, ["l_quantity"], key="l_orderkey", t="_o").select(*KEY, "l_quantity")


@query("impute_knn", f"""with g as (select * exclude (l_extendedprice), case when l_suppkey % 7 <> 0 then l_extendedprice end as x from lineitem),
r as (select l_quantity as q, l_discount as s, x as y from g where x is not null qualify row_number() over (partition by l_quantity, l_discount order by x) <= 5),
c as (select distinct l_quantity as q, l_discount as s from g where x is null),
n as (select c.q, c.s, r.y, (c.q - r.q) * (c.q - r.q) + (c.s - r.s) * (c.s - r.s) as d from c cross join r qualify row_number() over (partition by c.q, c.s order by d, r.y) <= 5),
m as (select q, s, avg(y) as answer from n group by 1, 2)
select {K}, {{{{coalesce(x, answer)}}}} as x from g left join m on q = l_quantity and s = l_discount""")
def _(spark, d):
    g = table(spark, d, "lineitem").withColumn("x", F.when(F.col("l_suppkey") % 7 != 0, F.col("l_extendedprice")))
    return rounded(P.fit_transform("impute_knn", g, ["x"], observed=["l_quantity", "l_discount"], k=5).select(*KEY, "x"))


FR = "select '{0}' as variable, {{{{corr({0}, l_extendedprice) ** 2 / (1 - corr({0}, l_extendedprice) ** 2) * (count(*) - 2)}}}} as score from lineitem"
NUMS = ("l_quantity", "l_discount", "l_tax")


def scores(spark, got):
    return rounded(spark.createDataFrame([(k, float(v)) for k, v in got.items()], "variable string, score double"))


@query("select_k_best_regression", " union all ".join(FR.format(c) for c in NUMS))
def _(spark, d):
    return scores(spark, P.fit("select_k_best_regression", table(spark, d, "lineitem"), list(NUMS), target="l_extendedprice", k=2)["learned"]["scores"])


FC = "select '{0}' as variable, {{{{(b / (k - 1)) / (w / (n - k))}}}} as score from (select sum(n * (m - gm) ** 2) as b, sum((n - 1) * v) as w, sum(n) as n, count(*) as k from (select count(*) as n, avg({0}) as m, var_samp({0}) as v from lineitem group by l_returnflag), (select avg({0}) as gm from lineitem))"


@query("select_k_best_classification", " union all ".join(FC.format(c) for c in NUMS))
def _(spark, d):
    return scores(spark, P.fit("select_k_best_classification", table(spark, d, "lineitem"), list(NUMS), target="l_returnflag", k=2)["learned"]["scores"])


MI = "select '{0}' as variable, {{{{sum(n / t * ln(n * t / (a * b)))}}}} as score from (select n, sum(n) over () as t, sum(n) over (partition by x) as a, sum(n) over (partition by y) as b from (select {0} as x, l_returnflag as y, count(*) as n from lineitem group by 1, 2))"


@query("select_mutual_info", " union all ".join(MI.format(c) for c in ("l_linestatus", "l_returnflag")))
def _(spark, d):
    x = table(spark, d, "lineitem").select("l_linestatus", "l_returnflag", F.col("l_returnflag").alias("y"))
    return scores(spark, P.mutual_information(x, ["l_linestatus", "l_returnflag"], "y"))


@query("drop_correlated", "select l_orderkey, l_quantity, l_tax from lineitem")
def _(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_tax", (F.col("l_quantity") * 3 + F.col("l_tax")).alias("copy"))
    return P.fit_transform("drop_correlated", x, ["l_quantity", "l_tax", "copy"])


STEPS = [("impute_median", ["l_quantity"]), ("standard_scale", ["l_quantity"]), ("minmax_scale", ["l_extendedprice"])]


@query("pipeline_apply", f"with f as (select *, coalesce(l_quantity, (select quantile_cont(l_quantity, 0.5) from {G})) as q from {G}) select {K}, {{{{(q - (select avg(q) from f)) / (select stddev_pop(q) from f)}}}} as l_quantity, {{{{({X} - a) / (b - a)}}}} as {X} from f, (select min({X}) as a, max({X}) as b from lineitem)")
def _(spark, d):
    return rounded(P.pipeline_apply(gappy(spark, d), STEPS)[0].select(*KEY, "l_quantity", X))


@query("pipeline_fold_fit", f"with f as (select *, (l_orderkey * 2654435761) % 1000 % 3 as fold from lineitem), s as (select a.fold, avg(b.l_quantity) as m, stddev_pop(b.l_quantity) as s from (select distinct fold from f) a join f b on a.fold <> b.fold group by 1) select {K}, fold, {{{{(l_quantity - m) / s}}}} as l_quantity from f join s using (fold)")
def _(spark, d):
    df = table(spark, d, "lineitem").withColumn("fold", F.expr("(l_orderkey * 2654435761) % 1000 % 3"))
    return rounded(P.pipeline_fold_fit(df, [("standard_scale", ["l_quantity"])]).select(*KEY, "fold", "l_quantity"))


@query("learned_parameters")
def _(spark, d):
    return P.learned_parameters(spark, P.pipeline_apply(gappy(spark, d), STEPS)[1])


@query("target_encode_folds", f"""with f as (select *, (l_orderkey * 2654435761) % 1000 % 3 as fold from lineitem),
w as (select a.fold, avg(b.l_extendedprice) as g from (select distinct fold from f) a join f b on a.fold <> b.fold group by 1),
l as (select a.fold, a.l_suppkey as k, count(b.l_suppkey) as n, avg(b.l_extendedprice) as m from (select distinct fold, l_suppkey from f) a left join f b on a.fold <> b.fold and a.l_suppkey = b.l_suppkey group by 1, 2)
select {K}, {{{{case when n = 0 then g else g * (1 - 1 / (1 + exp(-(n - 1) / 10))) + m / (1 + exp(-(n - 1) / 10)) end}}}} as l_suppkey_target from f join w using (fold) join l on l.fold = f.fold and k = l_suppkey""")
def _(spark, d):
    df = table(spark, d, "lineitem").withColumn("fold", F.expr("(l_orderkey * 2654435761) % 1000 % 3"))
    return rounded(P.pipeline_fold_fit(df, [("target_encode", ["l_suppkey"], {"target": "l_extendedprice"})]).select(*KEY, "l_suppkey_target"))
