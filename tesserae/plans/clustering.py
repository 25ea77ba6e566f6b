"""Queries of section 2.11 on clusters: the return flag stands for a cluster, so that SQL can check."""

from __future__ import annotations

from tesserae.operators import clusters as C
from tesserae.plans.describing import rounded
from tesserae.plans.registry import query
from tesserae.plans.tables import KEY
from tesserae.session import table

COLS = ["l_quantity", "l_discount"]
P = " union all ".join(f"select l_returnflag as cluster, '{c}' as variable, count(*) as n, count(*) / (select count(*) from lineitem) as share, avg({c}) as mean, (avg({c}) - (select avg({c}) from lineitem)) / (select stddev_pop({c}) from lineitem) as deviation from lineitem group by 1" for c in COLS)


@query("cluster_profile", f"select cluster, variable, n, {{{{share}}}} as share, {{{{mean}}}} as mean, {{{{deviation}}}} as deviation from ({P})")
def _(spark, d):
    return rounded(C.cluster_profile(table(spark, d, "lineitem"), "l_returnflag", COLS))


@query("defining_features", f"select cluster, variable, {{{{deviation}}}} as deviation, row_number() over (partition by cluster order by abs(deviation) desc, variable) as rank from ({P}) where abs(deviation) >= 0.0001")
def _(spark, d):
    return rounded(C.defining_features(table(spark, d, "lineitem"), "l_returnflag", COLS, least=0.0001))


@query("representative_rows", "with m as (select l_returnflag as cluster, avg(l_quantity) as a, avg(l_discount) as b from lineitem group by 1), s as (select stddev_pop(l_quantity) as sa, stddev_pop(l_discount) as sb from lineitem), x as (select cluster, l_orderkey, l_linenumber, l_partkey, l_suppkey, ((l_quantity - a) / sa) ** 2 + ((l_discount - b) / sb) ** 2 as dist from lineitem join m on cluster = l_returnflag, s), r as (select *, row_number() over (partition by cluster order by dist, l_orderkey, l_linenumber, l_partkey, l_suppkey) as rank from x) select cluster, l_orderkey, l_linenumber, l_partkey, l_suppkey, {{dist}} as distance, rank from r where rank <= 3")
def _(spark, d):
    return rounded(C.representative_rows(table(spark, d, "lineitem"), "l_returnflag", COLS, KEY))


S = "select '{0}' as variable, {{{{(b / (k - 1)) / (w / (n - k))}}}} as f, {{{{b / (b + w)}}}} as eta_squared from (select sum(n * (m - gm) ** 2) as b, sum(n * v) as w, sum(n) as n, count(*) as k from (select count(*) as n, avg({0}) as m, var_pop({0}) as v from lineitem group by l_returnflag), (select avg({0}) as gm from lineitem))"


@query("separating_features", " union all ".join(S.format(c) for c in COLS))
def _(spark, d):
    return rounded(C.separating_features(table(spark, d, "lineitem"), "l_returnflag", COLS))


@query("clustering_metrics", "with g as (select count(*) as n, avg(l_quantity) as a, avg(l_discount) as b, var_pop(l_quantity) + var_pop(l_discount) as v from lineitem group by l_returnflag), t as (select avg(l_quantity) as ga, avg(l_discount) as gb from lineitem), s as (select count(*) as k, sum(n) as n, sum(n * ((a - ga) ** 2 + (b - gb) ** 2)) as b, sum(n * v) as w, max(n) / min(n) as i from g, t) select k, n::bigint as n, {{(b / (k - 1)) / (w / (n - k))}} as calinski_harabasz, {{i}} as imbalance from s")
def _(spark, d):
    return rounded(C.clustering_metrics(table(spark, d, "lineitem"), "l_returnflag", COLS))


X = "(select l_returnflag as c, v.variable, v.value from lineitem, lateral (select unnest(['l_linestatus', 'l_linenumber']) as variable, unnest([l_linestatus, l_linenumber::varchar]) as value) v)"


@query("separating_categories", f"with x as {X}, k as (select variable, c, value, count(*) as k from x group by all), e as (select *, sum(k) over (partition by variable, c) * sum(k) over (partition by variable, value) / sum(k) over (partition by variable) as e from k), m as (select variable, count(distinct c) as a, count(distinct value) as b, sum(k) as n from k group by 1), f as (select variable, c, value from (select distinct variable, c from k) join (select distinct variable, value from k) using (variable)), g as (select variable, sum((coalesce(k.k, 0) - r.r * l.l / m.n) ** 2 / (r.r * l.l / m.n)) as chi from f left join k using (variable, c, value) join (select variable, c, sum(k) as r from k group by all) r using (variable, c) join (select variable, value, sum(k) as l from k group by all) l using (variable, value) join m using (variable) group by 1) select variable, {{{{chi}}}} as chi_square, (a - 1) * (b - 1) as df, {{{{sqrt(chi / (n * (least(a, b) - 1)))}}}} as cramers_v from g join m using (variable)")
def _(spark, d):
    return rounded(C.separating_categories(table(spark, d, "lineitem"), "l_returnflag", ["l_linestatus", "l_linenumber"]))


@query("cluster_modes", f"with k as (select c, variable, value, count(*) as n from {X} group by all) select c as cluster, variable, arg_min(value, struct_pack(a := -n, b := value)) as mode, {{{{max(n) / sum(n)}}}} as share from k group by 1, 2")
def _(spark, d):
    return rounded(C.cluster_modes(table(spark, d, "lineitem"), "l_returnflag", ["l_linestatus", "l_linenumber"]))


@query("davies_bouldin", "with m as (select l_returnflag as c, avg(l_quantity) as a, avg(l_discount) as b from lineitem group by 1), s as (select c, a, b, avg(sqrt((l_quantity - a) ** 2 + (l_discount - b) ** 2)) as s from lineitem join m on c = l_returnflag group by all), p as (select x.c, max((x.s + y.s) / sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2)) as worst from s x join s y on x.c <> y.c group by 1) select {{avg(worst)}} as davies_bouldin from p")
def _(spark, d):
    return rounded(C.davies_bouldin(table(spark, d, "lineitem"), "l_returnflag", COLS))
