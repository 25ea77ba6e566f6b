"""Queries of section 2.5: hypothesis tests. SQL checks statistics and effects; unit tests check p-values."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import hypothesis as H
from tesserae.plans.describing import rounded
from tesserae.plans.registry import query
from tesserae.session import table


def stat(df):
    return rounded(df.select("statistic", "effect", "n"))


def two(spark, d):
    return table(spark, d, "orders").where("o_orderstatus in ('F', 'O')")


TWO = "(select * from orders where o_orderstatus in ('F', 'O'))"
RANKED = "(select o_orderstatus as g, rank() over (order by o_totalprice) + (count(*) over (partition by o_totalprice) - 1) / 2 as r, o_totalprice as v from {})"


@query("anova", "with g as (select o_orderpriority, count(*) as n, avg(o_totalprice) as m, var_samp(o_totalprice) as v from orders group by 1), t as (select sum(n * m) / sum(n) as gm from g), s as (select sum(n * (m - gm) ** 2) as b, sum((n - 1) * v) as w, sum(n) as n, count(*) as k from g, t) select {{(b / (k - 1)) / (w / (n - k))}} as statistic, {{b / (b + w)}} as effect, n::bigint as n from s")
def _(spark, d):
    return stat(H.anova(table(spark, d, "orders"), "o_orderpriority", "o_totalprice"))


@query("levene_test", "with m as (select o_orderpriority as g, quantile_cont(o_totalprice, 0.5) as mid, var_samp(o_totalprice) as var from orders group by 1), a as (select g, abs(o_totalprice - mid) as v from orders join m on g = o_orderpriority), h as (select g, count(*) as n, avg(v) as m, var_samp(v) as v from a group by 1), t as (select sum(n * m) / sum(n) as gm from h), s as (select sum(n * (m - gm) ** 2) as b, sum((n - 1) * v) as w, sum(n) as n, count(*) as k from h, t) select {{(b / (k - 1)) / (w / (n - k))}} as statistic, {{(select max(var) / min(var) from m)}} as effect, n::bigint as n from s")
def _(spark, d):
    return stat(H.levene_test(table(spark, d, "orders"), "o_orderpriority", "o_totalprice"))


TT = f"with g as (select o_orderstatus, count(*) as n, avg(o_totalprice) as m, var_samp(o_totalprice) as v from {TWO} group by 1), a as (select * from g where o_orderstatus = 'F'), b as (select * from g where o_orderstatus = 'O') "


@query("t_test", TT + "select {{(a.m - b.m) / sqrt(a.v / a.n + b.v / b.n)}} as statistic, {{(a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2))}} as effect, a.n + b.n as n from a, b")
def _(spark, d):
    return stat(H.t_test(two(spark, d), "o_orderstatus", "o_totalprice", welch=True))


@query("cohens_d", TT + "select {{(a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2))}} as effect from a, b")
def _(spark, d):
    return rounded(H.t_test(two(spark, d), "o_orderstatus", "o_totalprice", welch=False).select("effect"))


@query("mean_difference_ci", TT + "select {{a.m - b.m}} as difference, {{(a.v / a.n + b.v / b.n) ** 2 / ((a.v / a.n) ** 2 / (a.n - 1) + (b.v / b.n) ** 2 / (b.n - 1))}} as df from a, b")
def _(spark, d):
    return rounded(H.mean_difference_ci(two(spark, d), "o_orderstatus", "o_totalprice").select("difference", "df"))


@query("confidence_interval", "select count(*) as n, {{avg(o_totalprice)}} as mean from orders")
def _(spark, d):
    return rounded(H.confidence_interval(table(spark, d, "orders"), "o_totalprice").select("n", "mean"))


@query("paired_t_test", "select {{avg(x) / (stddev_samp(x) / sqrt(count(x)))}} as statistic, {{avg(x) / stddev_samp(x)}} as effect, count(x) as n from (select l_discount - l_tax as x from lineitem)")
def _(spark, d):
    return stat(H.paired_t_test(table(spark, d, "lineitem"), "l_discount", "l_tax"))


@query("mann_whitney", "with r as " + RANKED.format(TWO) + ", g as (select count(*) filter (g = 'F') as n1, count(*) filter (g = 'O') as n2, sum(r) filter (g = 'F') as r1 from r) select {{r1 - n1 * (n1 + 1) / 2}} as statistic, {{2 * (r1 - n1 * (n1 + 1) / 2) / (n1 * n2) - 1}} as effect, n1 + n2 as n from g")
def _(spark, d):
    return stat(H.mann_whitney(two(spark, d), "o_orderstatus", "o_totalprice"))


@query("kruskal_wallis", "with r as (select l_returnflag as g, rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2 as r from lineitem), t as (select sum(k::double ** 3 - k) as ties from (select count(*) as k from lineitem group by l_quantity)), g as (select sum(r) as rs, count(*) as n from r group by g), s as (select sum(n)::double as n, count(*) as k, sum(rs ** 2 / n) as q from g), h as (select (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n ** 3 - n)) as h, n, k from s, t) select {{h}} as statistic, {{(h - k + 1) / (n - k)}} as effect, n::bigint as n from h")
def _(spark, d):
    return stat(H.kruskal_wallis(table(spark, d, "lineitem"), "l_returnflag", "l_quantity"))


@query("wilcoxon_signed_rank", "with x as (select l_discount - l_tax as d from lineitem where l_discount - l_tax <> 0), r as (select d, rank() over (order by abs(d)) + (count(*) over (partition by abs(d)) - 1) / 2 as r from x), s as (select sum(r) filter (d > 0) as w, count(*) as n from r) select {{w}} as statistic, {{4 * w / (n * (n + 1)) - 1}} as effect, n from s")
def _(spark, d):
    return stat(H.wilcoxon_signed_rank(table(spark, d, "lineitem"), "l_tax", "l_discount"))


@query("chi_square", "with c as (select l_returnflag as a, l_linestatus as b, count(*) as n from lineitem group by 1, 2), e as (select n, sum(n) over (partition by a) * sum(n) over (partition by b) / sum(n) over () as e from c), s as (select sum(n * n / e) - sum(n) as q, sum(n)::bigint as n from e) select {{q}} as statistic, {{sqrt(q / n)}} as effect, n from s")
def _(spark, d):
    return stat(H.chi_square(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus"))


@query("fisher_exact", "with c as (select count(*) filter (l = 0 and s = 'F') as w, count(*) filter (l = 0 and s = 'O') as x, count(*) filter (l = 1 and s = 'F') as y, count(*) filter (l = 1 and s = 'O') as z from (select (l_quantity > 45)::int as l, l_linestatus as s from lineitem)) select {{w * z / (x * y)}} as statistic, w + x + y + z as n from c")
def _(spark, d):
    x = table(spark, d, "lineitem").select((F.col("l_quantity") > 45).cast("int").alias("l"), "l_linestatus")
    return rounded(H.fisher_exact(x, "l", "l_linestatus").select("statistic", "n"))


@query("normality_test", "select {{sum((x - m) ** 3) / count(*) / (sum((x - m) ** 2) / count(*)) ** 1.5}} as effect, count(*) as n from (select o_totalprice as x from orders), (select avg(o_totalprice) as m from orders)")
def _(spark, d):
    return rounded(H.normality_test(table(spark, d, "orders"), "o_totalprice").select("effect", "n"))


@query("correlation_test", "with r as (select rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2 as a, rank() over (order by l_extendedprice) + (count(*) over (partition by l_extendedprice) - 1) / 2 as b from lineitem) select {{corr(a, b)}} as statistic, {{corr(a, b) ** 2}} as effect, count(*) as n from r")
def _(spark, d):
    return stat(H.correlation_test(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", "spearman"))


@query("correlation_test_kendall", "with c as (select l_discount as a, l_tax as b, count(*)::double as n from lineitem group by 1, 2), s as (select sum(sign(y.b - x.b) * x.n * y.n) as s from c x join c y on x.a < y.a), t as (select sum(n) as n from c), ta as (select sum(n * (n - 1) / 2) as t from (select sum(n) as n from c group by a)), tb as (select sum(n * (n - 1) / 2) as t from (select sum(n) as n from c group by b)) select {{s / sqrt((n * (n - 1) / 2 - ta.t) * (n * (n - 1) / 2 - tb.t))}} as statistic, n::bigint as n from s, t, ta, tb")
def _(spark, d):
    return rounded(H.correlation_test(table(spark, d, "lineitem"), "l_discount", "l_tax", "kendall").select("statistic", "n"))


@query("correlation_test_kendall_continuous", "with c as (select o_totalprice as a, o_custkey as b, count(*)::double as n from orders group by 1, 2), s as (select sum(sign(y.b - x.b) * x.n * y.n) as s from c x join c y on x.a < y.a), t as (select sum(n) as n from c), ta as (select sum(n * (n - 1) / 2) as t from (select sum(n) as n from c group by a)), tb as (select sum(n * (n - 1) / 2) as t from (select sum(n) as n from c group by b)) select {{s / sqrt((n * (n - 1) / 2 - ta.t) * (n * (n - 1) / 2 - tb.t))}} as statistic, n::bigint as n from s, t, ta, tb")
def _(spark, d):
    return rounded(H.correlation_test(table(spark, d, "orders"), "o_totalprice", "o_custkey", "kendall").select("statistic", "n"))


PS = "(select o_orderpriority as name, count(*) filter (o_orderstatus = 'F') / count(*) / 10 as p from orders group by 1)"


@query("multiple_comparison", f"with x as (select name, p, count(*) over () as n, row_number() over (order by p, name) as k from {PS}) select name, {{{{p}}}} as p, {{{{least(p * n, 1)}}}} as bonferroni, {{{{least(max((n - k + 1) * p) over (order by p, name rows unbounded preceding), 1)}}}} as holm, {{{{least(min(n / k * p) over (order by p, name rows between current row and unbounded following), 1)}}}} as benjamini_hochberg from x")
def _(spark, d):
    t = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg((F.count_if(F.col("o_orderstatus") == "F") / F.count(F.lit(1)) / 10).alias("p"))
    return rounded(H.multiple_comparison(t))


def _battery(c: str, k: int) -> str:
    """All statistics of one category: moments, Brown-Forsythe (which t), ranks."""
    g = f"with x as (select {c} as g, l_extendedprice as v, rank() over (order by l_extendedprice) + (count(*) over (partition by l_extendedprice) - 1) / 2 as r from lineitem), g as (select g, count(*)::double as n, avg(v) as m, var_samp(v) as s, sum(r) as r, median(v) as mid from x group by 1), t as (select sum(n) as n, sum(n * m) / sum(n) as gm, sum((n - 1) * s) as w, count(*) as k from g), b as (select sum(g.n * (m - gm) ** 2) as b from g, t), ties as (select sum(k ** 3 - k) as z from (select count(*)::double as k from x group by v))"
    if k == 2:
        levene = "l as (select g, count(*)::double as n, avg(abs(v - mid)) as m, var_samp(abs(v - mid)) as s from x join g using (g) group by 1), lt as (select sum(n * m) / sum(n) as gm, sum((n - 1) * s) as w, sum(n) as n from l), lf as (select sum(l.n * (m - gm) ** 2) / (any_value(w) / (any_value(lt.n) - 2)) > 3.8417 as apart from l, lt)"
        one, two = "(select * from g order by g limit 1) p", "(select * from g order by g desc limit 1) q"
        dof = "case when apart then (p.s / p.n + q.s / q.n) ** 2 / ((p.s / p.n) ** 2 / (p.n - 1) + (q.s / q.n) ** 2 / (q.n - 1)) else p.n + q.n - 2 end"
        se = "case when apart then sqrt(p.s / p.n + q.s / q.n) else sqrt(w / (t.n - 2) * (1 / p.n + 1 / q.n)) end"
        return f"({g}, {levene} select '{c}' as variable, k as levels, t.n::bigint as n, case when apart then 'welch' else 't' end as test, {{{{(p.m - q.m) / {se}}}}} as statistic, {{{{{dof}}}}} as df, 'cohens_d' as effect_name, {{{{(p.m - q.m) / sqrt(w / (t.n - 2))}}}} as effect, 'mann-whitney' as cross_test, {{{{p.r - p.n * (p.n + 1) / 2}}}} as cross_statistic from {one}, {two}, t, lf)"
    return f"({g} select '{c}' as variable, k as levels, t.n::bigint as n, 'anova' as test, {{{{(b / (k - 1)) / (w / (t.n - k))}}}} as statistic, {{{{t.n - k}}}} as df, 'eta_squared' as effect_name, {{{{b / (b + w)}}}} as effect, 'kruskal-wallis' as cross_test, {{{{(12 / (t.n * (t.n + 1)) * (select sum(r * r / n) from g) - 3 * (t.n + 1)) / (1 - z / (t.n ** 3 - t.n))}}}} as cross_statistic from t, b, ties)"


@query("test_battery", " union all ".join(_battery(c, k) for c, k in (("l_returnflag", 3), ("l_linestatus", 2), ("l_linenumber", 7))))
def _(spark, d):
    got = H.battery(table(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag", "l_linestatus", "l_linenumber", "l_partkey"])
    return rounded(got.drop("p", "cross_p", "holm", "significant", "agrees", "confidence"))
