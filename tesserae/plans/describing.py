"""Queries of sections 2.4 and 2.6: statistics, profiles, windows and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions.scalar import sig
from tesserae.operators import describe as D
from tesserae.plans.registry import query
from tesserae.session import table

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def rounded(df, *cols):
    """df with these columns (or all doubles) at eight significant digits."""
    names = cols or [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: sig(c) for c in names})


def each(cols, one):
    return " union all ".join(one.replace("$c", c) for c in cols)


@query("describe_numeric", each(NUM, "select '$c' as variable, count($c) as n, count(*) - count($c) as missing, {{avg($c)}} as mean, {{quantile_cont($c, 0.5)}} as median, {{stddev_samp($c)}} as std, {{var_samp($c)}} as variance, {{stddev_samp($c) / abs(avg($c))}} as cv, {{min($c)}} as min, {{quantile_cont($c, 0.25)}} as q1, {{quantile_cont($c, 0.75)}} as q3, {{max($c)}} as max, {{quantile_cont($c, 0.75) - quantile_cont($c, 0.25)}} as iqr, {{max($c) - min($c)}} as range, {{skewness($c)}} as skewness, {{kurtosis($c)}} as kurtosis, {{stddev_samp($c) / sqrt(count($c))}} as sem from lineitem"))
def _(spark, d):
    return rounded(D.describe_numeric(table(spark, d, "lineitem"), NUM))


P = (1, 5, 10, 25, 50, 75, 90, 95, 99)


@query("percentiles", each(NUM, "select '$c' as variable, " + ", ".join(f"{{{{quantile_cont($c, {p / 100})}}}} as p{p}" for p in P) + " from lineitem"))
def _(spark, d):
    return rounded(D.percentiles(table(spark, d, "lineitem"), NUM))


CAT = ["l_returnflag", "l_linestatus"]


@query("describe_categorical", each(CAT, "select '$c' as variable, count(*) as \"distinct\", arg_max(v, (n, v2)) as mode, {{max(n) / sum(n)}} as mode_share, {{(select sum(-p * ln(p)) from (select n / (sum(n) over ()) as p from (select count(*) as n from lineitem group by $c)))}} as entropy, {{(select sum(-p * ln(p)) / ln(count(*)) from (select n / (sum(n) over ()) as p from (select count(*) as n from lineitem group by $c)))}} as relative_entropy from (select $c as v, count(*) as n, -row_number() over (order by $c) as v2 from lineitem group by $c)"))
def _(spark, d):
    return rounded(D.describe_categorical(table(spark, d, "lineitem"), CAT))


@query("top_values", "select variable, value, n, rank from (select variable, value, n, row_number() over (partition by variable order by n desc, value) as rank from (select 'p_brand' as variable, p_brand as value, count(*) as n from part group by 2 union all select 'p_type', p_type, count(*) from part group by 2)) where rank <= 10")
def _(spark, d):
    return D.top_values(table(spark, d, "part"), ["p_brand", "p_type"])


@query("class_balance", "select o_orderstatus as level, count(*) as n, {{count(*) / sum(count(*)) over ()}} as share, {{min(count(*)) over () / sum(count(*)) over ()}} as minority_share, {{max(count(*)) over () / (min(count(*)) over ())}} as ratio, min(count(*)) over () / sum(count(*)) over () < 0.2 as imbalanced, min(count(*)) over () / sum(count(*)) over () < 0.05 as severe from orders group by 1")
def _(spark, d):
    return rounded(D.class_balance(table(spark, d, "orders"), "o_orderstatus"))


@query("count_duplicates", "select sum(n)::bigint as rows, sum(n - 1)::bigint as duplicates, {{sum(n - 1) / sum(n)}} as share from (select count(*) as n from (select text, lang from documents) group by text, lang)")
def _(spark, d):
    return rounded(D.count_duplicates(table(spark, d, "documents").select("text", "lang")))


@query("group_summary", "select o_orderpriority as level, count(*) as n, {{avg(o_totalprice)}} as mean, {{quantile_cont(o_totalprice, 0.5)}} as median, {{stddev_samp(o_totalprice)}} as std from orders group by 1 order by n desc, level limit 30")
def _(spark, d):
    return rounded(D.group_summary(table(spark, d, "orders"), "o_orderpriority", "o_totalprice"))


@query("outlier_table", each(["l_extendedprice", "l_quantity"], "select '$c' as variable, {{lo}} as lower, {{hi}} as upper, count(*) filter ($c < lo or $c > hi) as outliers, {{count(*) filter ($c < lo or $c > hi) / count(*)}} as share, {{min($c) filter ($c < lo or $c > hi)}} as least, {{max($c) filter ($c < lo or $c > hi)}} as greatest from lineitem, (select q1 - 0.5 * (q3 - q1) as lo, q3 + 0.5 * (q3 - q1) as hi from (select quantile_cont($c, 0.25) as q1, quantile_cont($c, 0.75) as q3 from lineitem)) group by lo, hi"))
def _(spark, d):
    return rounded(D.outlier_table(table(spark, d, "lineitem"), ["l_extendedprice", "l_quantity"], 0.5))


@query("covariance_matrix", " union all ".join(f"select '{a}' as a, '{b}' as b, {{{{covar_samp({a}, {b})}}}} as covariance from lineitem" for a in NUM for b in NUM))
def _(spark, d):
    return rounded(D.covariance_matrix(table(spark, d, "lineitem"), NUM))


@query("correlation_matrix", " union all ".join(f"select '{a}' as a, '{b}' as b, {{{{corr({a}, {b})}}}} as r from (select " + ", ".join(f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2 as {c}" for c in NUM) + " from lineitem)" for a in NUM for b in NUM))
def _(spark, d):
    return rounded(D.correlation_matrix(table(spark, d, "lineitem"), NUM, "spearman"))


@query("correlation_pairs", " union all ".join(f"select '{a}' as a, '{b}' as b, count(*) as n, {{{{corr({a}, {b})}}}} as r, case when abs(corr({a}, {b})) < 0.1 then 'negligible' when abs(corr({a}, {b})) < 0.3 then 'weak' when abs(corr({a}, {b})) < 0.5 then 'moderate' when abs(corr({a}, {b})) < 0.7 then 'strong' else 'very strong' end as strength from lineitem" for i, a in enumerate(NUM) for b in NUM[i + 1 :]))
def _(spark, d):
    return rounded(D.correlation_pairs(table(spark, d, "lineitem"), NUM).drop("p"))


@query("nonlinearity_signal", "with r as (select l_quantity as a, l_extendedprice as b, rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2 as ra, rank() over (order by l_extendedprice) + (count(*) over (partition by l_extendedprice) - 1) / 2 as rb from lineitem) select 'l_extendedprice' as a, 'l_quantity' as b, {{corr(a, b)}} as pearson, {{corr(ra, rb)}} as spearman, abs(corr(ra, rb)) - abs(corr(a, b)) > 0.15 and abs(corr(ra, rb)) > 0.4 as nonlinear from r")
def _(spark, d):
    return rounded(D.nonlinearity_signal(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]))


@query("vif", "with c as (select corr(l_quantity, l_extendedprice) as ab, corr(l_quantity, l_discount) as ac, corr(l_extendedprice, l_discount) as bc from lineitem), k as (select *, 1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc as det from c) select 'l_quantity' as variable, {{(1 - bc * bc) / det}} as vif from k union all select 'l_extendedprice', {{(1 - ac * ac) / det}} from k union all select 'l_discount', {{(1 - ab * ab) / det}} from k")
def _(spark, d):
    return rounded(D.vif(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))


@query("histogram_bins", "with b as (select min(o_totalprice) as lo, (max(o_totalprice) - min(o_totalprice)) / 40 as w from orders) select least(floor((o_totalprice - lo) / w), 39)::int as bin, count(*) as n, {{lo + least(floor((o_totalprice - lo) / w), 39) * w}} as \"left\" from orders, b group by 1, 3")
def _(spark, d):
    return rounded(D.histogram_bins(table(spark, d, "orders"), "o_totalprice"), "left")


@query("box_stats", "with q as (select o_orderpriority as level, count(*) as n, quantile_cont(o_totalprice, 0.25) as q1, quantile_cont(o_totalprice, 0.5) as median, quantile_cont(o_totalprice, 0.75) as q3 from orders group by 1 order by n desc, level limit 10) select level, n, {{q1}} as q1, {{median}} as median, {{q3}} as q3, {{min(o_totalprice) filter (o_totalprice >= q1 - 1.5 * (q3 - q1))}} as low, {{max(o_totalprice) filter (o_totalprice <= q3 + 1.5 * (q3 - q1))}} as high from q join orders on o_orderpriority = level group by all")
def _(spark, d):
    return rounded(D.box_stats(table(spark, d, "orders"), "o_orderpriority", "o_totalprice"))


@query("scatter_sample_trend", "select {{regr_slope(l_extendedprice, l_quantity)}} as slope, {{regr_intercept(l_extendedprice, l_quantity)}} as intercept, {{corr(l_quantity, l_extendedprice)}} as r, count(*) as n from lineitem")
def _(spark, d):
    return rounded(D.trend_line(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice"))
