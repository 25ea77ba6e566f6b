"""Queries of section 2.10's baskets and 2.4's profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import baskets as B
from tesserae.operators import profile as P
from tesserae.plans.describing import rounded
from tesserae.plans.registry import query
from tesserae.plans.tables import GAP, gappy
from tesserae.session import table

BASKET = "(select distinct l_orderkey as txn, p_type as item from lineitem join part on l_partkey = p_partkey)"


def baskets(spark, d):
    x = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return B.basket_build(x, "l_orderkey", "p_type")


@query("basket_build", f"select txn, list_sort(list(item))::varchar as items from {BASKET} group by 1")
def _(spark, d):
    return baskets(spark, d).select("txn", F.concat(F.lit("["), F.array_join("items", ", "), F.lit("]")).alias("items"))


LAYOUT = "select '{0}' as \"column\", case when avg(regexp_matches({0}::varchar, '[,;|]')::int) > 0.5 then 'delimited' when avg(({0}::varchar in ('0', '1', 'true', 'false'))::int) = 1 then 'wide' else 'long' end as layout from (select o_orderkey, o_orderkey % 2 as flag, o_orderstatus || ',' || o_orderpriority as tags from orders)"


@query("basket_layout", " union all ".join(LAYOUT.format(c) for c in ("o_orderkey", "flag", "tags")))
def _(spark, d):
    x = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 2).alias("flag"), F.concat_ws(",", "o_orderstatus", "o_orderpriority").alias("tags"))
    return B.basket_layout(x, x.columns).drop("distinct")


PAIRS = f"with b as {BASKET}, n as (select count(distinct txn) as n from b), s as (select item, count(*) as k from b group by 1), p as (select x.item as a, y.item as c, count(*) as k from b x join b y on x.txn = y.txn and x.item < y.item group by 1, 2) "


TRIPLES = PAIRS + ", t as (select x.item as a, y.item as c, z.item as e, count(*) as k from b x join b y on x.txn = y.txn and x.item < y.item join b z on x.txn = z.txn and y.item < z.item group by 1, 2, 3), f as (select item as items, k from s union all select a || '|' || c, k from p union all select a || '|' || c || '|' || e, k from t) "


@query("association_itemsets", TRIPLES + "select items, k as n, {{k / n.n}} as support from f, n where k >= ceil(0.002 * n.n)")
def _(spark, d):
    got = B.association_itemsets(baskets(spark, d), 0.002, 3)
    return rounded(got.select(F.array_join("items", "|").alias("items"), "n", "support"))


RULE = "select {a} as antecedent, {c} as consequent, {{{{w.k / n.n}}}} as support, {{{{w.k / x.k}}}} as confidence, {{{{(w.k / x.k) / (y.k / n.n)}}}} as lift, {{{{w.k / n.n - x.k / n.n * y.k / n.n}}}} as leverage from {w} w join f x on x.items = {a} join f y on y.items = {c}, n where w.k >= ceil(0.002 * n.n) and w.k / x.k >= 0.05"
SPLITS = [("p", "w.a", "w.c"), ("p", "w.c", "w.a")]
SPLITS += [("t", *pair) for one, two in (("w.a", "w.c || '|' || w.e"), ("w.c", "w.a || '|' || w.e"), ("w.e", "w.a || '|' || w.c")) for pair in ((one, two), (two, one))]


@query("association_rules", TRIPLES + " union all ".join(RULE.format(w=w, a=a, c=c) for w, a, c in SPLITS))
def _(spark, d):
    got = B.association_rules(B.association_itemsets(baskets(spark, d), 0.002, 3), 0.05, 0.0)
    return rounded(got.select(F.array_join("antecedent", "|").alias("antecedent"), F.array_join("consequent", "|").alias("consequent"), "support", "confidence", "lift", "leverage"))


@query("join_rule_support", PAIRS + "select p.a, p.c, p.k as both, x.k as a_n, y.k as c_n from p join s x on x.item = p.a join s y on y.item = p.c")
def _(spark, d):
    i = B.association_itemsets(baskets(spark, d), 0.0001, 2)
    two = i.where(F.size("items") == 2).select(F.col("items")[0].alias("a"), F.col("items")[1].alias("c"), F.col("n").alias("both"))
    one = i.where(F.size("items") == 1).select(F.col("items")[0].alias("i"), "n")
    return two.join(one.toDF("a", "a_n"), "a").join(one.toDF("c", "c_n"), "c")


NUMBER, WORD, DAY = "number", "word", "day"


def type_sql(c: str, kind: str, source: str) -> str:
    """SQL that applies the type rules to one column: column, semantic_type."""
    d, n = f"count(distinct {c})", f"count({c})"
    rules = [(f"{d} <= 1", "constant")]
    if kind == DAY:
        rules += [("true", "datetime")]
    elif kind == NUMBER:
        whole = f"count(*) filter ({c} <> floor({c})) = 0"
        close = f"(select count(*) filter (g <= 2) >= count(*) / 2 from (select v - lag(v) over (order by v) as g from (select {c} as v from {source}) where v is not null))"
        named = f"regexp_matches('{c}', '{P.ID_NAME}')"
        rules += [(f"{d} = 2", "binary"), (f"{whole} and {d} / {n} >= 0.95 and count(*) > 20 and ({named} or {d} = {n} and {close})", "identifier"), (f"{whole} and {d} <= 20", "numeric_discrete"), ("true", "numeric_continuous")]
    else:
        words, number = f"avg(len(string_split_regex(trim({c}), '\\s+')))", f"try_cast(regexp_replace(regexp_replace(trim({c}), '^[R$€£]', ''), '[,\\s%]', '', 'g') as double)"
        ordered = " or ".join(f"avg((lower(trim({c})) in ({', '.join(repr(v) for v in own)}))::int) = 1" for own in P.ORDINAL)
        rules += [(f"(regexp_matches('{c}', '{P.DATE_NAME}') or avg(regexp_matches({c}, '{P.DATE_SHAPE}')::int) > 0.8) and avg((try_cast({c} as timestamp) is not null)::int) >= 0.9", "datetime")]
        rules += [(f"avg(({number} is not null)::int) > 0.95", "numeric_continuous"), (f"{d} = 2", "binary"), (f"{d} / {n} >= 0.95 and count(*) > 20 and {words} < 3", "identifier"), (f"{words} >= 3 and avg(length({c})) >= 25", "text")]
        rules += [(f"{d} <= 15 and ({ordered})", "categorical_ordinal"), (f"{d} > 50 or {d} / {n} > 0.5", "high_cardinality_categorical"), ("true", "categorical_nominal")]
    case = " ".join(f"when {when} then '{then}'" for when, then in rules)
    return f"select '{c}' as \"column\", case {case} end as semantic_type from {source}"


def measures_sql(c: str, kind: str, source: str, name: str = "variable") -> str:
    """SQL of profile_columns for one column."""
    n = f"count({c})"
    own = f"(select min(struct_pack(a := -k, b := v)) from (select {c}::varchar as v, count(*) as k from {source} where {c} is not null group by 1))"
    most = f"(-({own}).a)"
    got = [f"'{c}' as {name}", "count(*) as rows", f"count(*) - {n} as missing", f"{{{{(count(*) - {n}) / count(*)}}}} as missing_share", f"count(distinct {c}) as \"distinct\"", f"{{{{count(distinct {c}) / count(*)}}}} as distinct_share", f"{{{{count(distinct {c}) / {n}}}}} as cardinality"]
    got += [f"({own}).b as dominant", f"{{{{{most} / {n}}}}} as dominant_share", f"count(distinct {c}) <= 1 as constant", f"{most} / {n} >= 0.99 and count(distinct {c}) > 1 as near_constant"]
    if kind == NUMBER:
        q = {p: f"(select quantile_cont({c}, {p}) from {source})" for p in (0.25, 0.75)}
        out = f"count(*) filter ({c} < {q[0.25]} - 1.5 * ({q[0.75]} - {q[0.25]}) or {c} > {q[0.75]} + 1.5 * ({q[0.75]} - {q[0.25]}))"
        what = {"mean": f"avg({c})", "std": f"stddev_samp({c})", "min": f"min({c})", "q1": f"quantile_cont({c}, 0.25)", "median": f"quantile_cont({c}, 0.5)", "q3": f"quantile_cont({c}, 0.75)", "max": f"max({c})", "skewness": f"skewness({c})", "kurtosis": f"kurtosis({c})"}
        got += [f"{{{{{v}}}}} as {k}" for k, v in what.items()] + [f"count(*) filter ({c} = 0) as zeros", f"count(*) filter ({c} < 0) as negatives", f"{out} as outliers", f"{{{{{out} / {n}}}}} as outlier_share"]
    else:
        got += [f"null::double as {k}" for k in ("mean", "std", "min", "q1", "median", "q3", "max", "skewness", "kurtosis")] + [f"null::bigint as {k}" for k in ("zeros", "negatives", "outliers")] + ["null::double as outlier_share"]
    got += [f"{{{{avg(len(string_split_regex(trim({c}), '\\s+')))}}}} as mean_words" if kind == WORD else "null::double as mean_words"]
    got += [f"min({c})::varchar as first, max({c})::varchar as last" if kind == DAY else "null::varchar as first, null::varchar as last"]
    return f"select {', '.join(got)} from {source}"


def union(parts) -> str:
    return " union all ".join(parts)


ORDERS = {"o_orderkey": NUMBER, "o_custkey": NUMBER, "o_orderstatus": WORD, "o_totalprice": NUMBER, "o_orderdate": DAY, "o_orderpriority": WORD}
ITEMS = {"l_orderkey": NUMBER, "l_partkey": NUMBER, "l_suppkey": NUMBER, "l_linenumber": NUMBER, "l_quantity": NUMBER, "l_extendedprice": NUMBER, "l_discount": NUMBER, "l_tax": NUMBER, "l_returnflag": WORD, "l_linestatus": WORD, "l_shipdate": DAY}


@query("infer_semantic_types", union(type_sql(c, k, "orders") for c, k in ORDERS.items()))
def _(spark, d):
    return P.infer_semantic_types(table(spark, d, "orders"))


@query("infer_types_of_texts", union(type_sql(c, k, "documents") for c, k in {"doc_id": NUMBER, "text": WORD, "lang": WORD, "source": WORD, "n_chars": NUMBER}.items()))
def _(spark, d):
    return P.infer_semantic_types(table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars"))


@query("profile_columns", f"with x as (select l_discount, l_tax, {GAP} as l_quantity from lineitem) " + union(measures_sql(c, NUMBER, "x") for c in ("l_quantity", "l_discount", "l_tax")))
def _(spark, d):
    got = P.profile_columns(gappy(spark, d).select("l_quantity", "l_discount", "l_tax"))
    return rounded(got)


@query("profile_dataset", "select * from (" + union(type_sql(c, k, "lineitem") for c, k in ITEMS.items()) + ") join (" + union(measures_sql(c, k, "lineitem", '"column"') for c, k in ITEMS.items()) + ') using ("column")')
def _(spark, d):
    return rounded(P.profile_dataset(table(spark, d, "lineitem").select(*ITEMS)))


@query("date_frequency", "with x as (select t, t - lag(t) over (order by t) as gap from (select distinct l_shipdate::date as t from lineitem)), g as (select quantile_cont(gap, 0.5) as sp, count(*) as n, max(t) - min(t) as span from x) select 'l_shipdate' as variable, sp::double as spacing, case when sp <= 1.5 then 'daily' when sp <= 8 then 'weekly' when sp <= 32 then 'monthly' when sp <= 95 then 'quarterly' else 'yearly' end as frequency, greatest(floor(span / sp) + 1 - n, 0)::bigint as missing_periods from g")
def _(spark, d):
    return P.date_frequency(table(spark, d, "lineitem"), ["l_shipdate"])


@query("leakage_suspects", "select 'copy' as \"column\", 'correlation' as reason, {{corr(o_totalprice * 1.0001, o_totalprice)}} as r from orders union all select 'predicted', 'name', null")
def _(spark, d):
    x = table(spark, d, "orders").select("o_totalprice", "o_custkey", (F.col("o_totalprice") * 1.0001).alias("copy"), (F.col("o_custkey") % 3).alias("predicted"))
    return rounded(P.leakage_suspects(x, "o_totalprice"))


@query(
    "target_candidates",
    "with t as (" + union(type_sql(c, k, "orders") for c, k in ORDERS.items()) + "), m as (" + union(f"select '{c}' as \"column\", count(distinct {c}) as d, 1 - count({c}) / count(*) as gaps, (select max(k) from (select count(*) as k from orders where {c} is not null group by {c})) / count({c}) >= 0.99 and count(distinct {c}) > 1 as near from orders" for c in ORDERS) + "), "
    f"s as (select \"column\", semantic_type, d, (case when regexp_matches(\"column\", '{P.TARGET_NAME}') then 0.35::double else 0 end) + (case when semantic_type = 'binary' then 0.25 when semantic_type = 'numeric_continuous' then 0.2 when semantic_type = 'categorical_nominal' and d <= 10 then 0.15 else 0 end) + (case when gaps = 0 then 0.1 when gaps > 0.3 then -0.2 else 0 end) + (case when \"column\" = '{list(ORDERS)[-1]}' then 0.08 else 0 end) - (case when near then 0.4 else 0 end) as score from t join m using (\"column\") where semantic_type not in ('identifier', 'constant', 'text', 'datetime')) "
    "select \"column\", semantic_type, case when semantic_type = 'binary' then 'binary_classification' when semantic_type in ('categorical_nominal', 'categorical_ordinal') or semantic_type = 'numeric_discrete' and d <= 10 then 'multiclass_classification' else 'regression' end as task, round(least(score, 1), 3)::double as score from s where score > 0 order by score desc, \"column\" limit 10",
)
def _(spark, d):
    o = table(spark, d, "orders").select(*ORDERS)
    return P.target_candidates(o, P.infer_semantic_types(o), P.profile_columns(o))


FLAWED = {"o_orderkey": NUMBER, "o_orderstatus": WORD, "o_totalprice": NUMBER, "twice": NUMBER, "always": WORD, "gone": WORD, "rare": WORD, "note": WORD}
FLAWS = "with x as (select o_orderkey, o_orderstatus, o_totalprice, o_totalprice + (o_custkey % 10) * 1000 as twice, 'x' as always, case when o_orderkey % 2 = 0 then o_orderpriority end as gone, case when o_orderkey <= 3 then 'b' else 'a' end as rare, 'n' || (o_custkey % 97) as note from orders union all select * from (select o_orderkey, o_orderstatus, o_totalprice, o_totalprice + (o_custkey % 10) * 1000 as twice, 'x' as always, case when o_orderkey % 2 = 0 then o_orderpriority end as gone, case when o_orderkey <= 3 then 'b' else 'a' end as rare, 'n' || (o_custkey % 97) as note from orders where o_orderkey = (select min(o_orderkey) from orders))), "


def flawed(spark, d):
    """orders with planted flaws, its first row twice."""
    o = table(spark, d, "orders")
    o = o.unionAll(o.join(F.broadcast(o.agg(F.min("o_orderkey").alias("o_orderkey"))), "o_orderkey").select(*o.columns))  # one row
    return o.selectExpr("o_orderkey", "o_orderstatus", "o_totalprice", "o_totalprice + (o_custkey % 10) * 1000 as twice", "'x' as always", "case when o_orderkey % 2 = 0 then o_orderpriority end as gone", "case when o_orderkey <= 3 then 'b' else 'a' end as rare", "'n' || (o_custkey % 97) as note")


ISSUES = (
    FLAWS
    + "t as (" + union(type_sql(c, k, "x") for c, k in FLAWED.items()) + "), m as (" + union(measures_sql(c, k, "x", '"column"') for c, k in FLAWED.items()) + "), y as (select * from t join m using (\"column\")), c as (select corr(o_totalprice, twice) as r from x), i as ("
    "select 'severe_missingness' as code, \"column\", 'critical' as severity from y where missing_share >= 0.4 union all select 'missing_values', \"column\", 'warning' from y where missing_share >= 0.05 and missing_share < 0.4 union all select 'constant_columns', \"column\", 'info' from y where constant "
    "union all select 'near_constant_columns', \"column\", 'info' from y where near_constant union all select 'outliers', \"column\", 'warning' from y where outlier_share >= 0.05 and semantic_type like 'numeric%' union all select 'skewed_distributions', \"column\", 'info' from y where abs(skewness) > 1 and semantic_type like 'numeric%' "
    "union all select 'high_cardinality', \"column\", 'warning' from y where semantic_type = 'high_cardinality_categorical' union all select 'identifier_columns', \"column\", 'info' from y where semantic_type = 'identifier' "
    "union all select 'duplicate_rows', null, case when count(*) - (select count(*) from (select distinct * from x)) < 0.05 * count(*) then 'warning' else 'critical' end from x having count(*) > (select count(*) from (select distinct * from x)) "
    "union all select 'high_correlation', unnest(['o_totalprice', 'twice']), 'warning' from c where abs(r) >= 0.85 union all select 'possible_leakage', 'twice', 'critical' from c where abs(r) >= 0.98) "
)


@query("quality_issues", ISSUES + "select * from i")
def _(spark, d):
    return P.all_issues(flawed(spark, d), "o_totalprice")


@query("quality_score", ISSUES + "select greatest(0, 100 - sum(case severity when 'critical' then 12 when 'warning' then 5 else 1 end))::bigint as score, count(*) as issues from (select distinct code, severity from i)")
def _(spark, d):
    return P.quality_score(P.all_issues(flawed(spark, d), "o_totalprice"))


@query("dimension_scores", ISSUES + ", n as (" + union(f"select '{dim}' as dimension, '{c}' as code" for dim, own in P.DIMENSIONS.items() for c in own) + ") select dimension, greatest(0, 100 - sum(case severity when 'critical' then 45 when 'warning' then 18 when 'info' then 5 else 0 end))::bigint as score, count(severity) as issues from n left join (select distinct code, severity from i) using (code) group by 1")
def _(spark, d):
    return P.dimension_scores(P.all_issues(flawed(spark, d), "o_totalprice"))


@query("drop_useless_columns", "select o_custkey, o_totalprice from orders")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.lit(1).alias("always"), (F.col("o_totalprice") * 2).alias("copy"))
    return P.drop_useless_columns(o, "o_totalprice")
