"""Queries of section 2.13: schema, drift, versions, contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import scoring as S
from tesserae.plans.describing import rounded
from tesserae.plans.registry import query
from tesserae.session import table

OLD, NEW = "o_orderdate < '1998-01-01'", "o_orderdate >= '1998-01-01'"


def halves(spark, d):
    o = table(spark, d, "orders")
    return o.where(OLD), o.where(NEW)


GAPPY = f"a as (select * from orders where {OLD}), b as (select o_orderkey, case when o_orderkey % 3 <> 0 then o_totalprice end as o_totalprice, case when o_orderkey % 50 = 0 then 'unheard' else o_orderpriority end as o_orderpriority, length(o_orderstatus) as o_orderstatus, o_orderdate from orders where {NEW})"


@query("schema_check", f"with {GAPPY} select 'extra_column' as code, 'added' as \"column\", 'info' as severity, null as detail union all select 'missing_column', 'o_custkey', 'fatal', null union all select 'kind_changed', 'o_orderstatus', 'warning', 'text to numeric' union all select 'more_missing', 'o_totalprice', 'warning', null from b having 1 - count(o_totalprice) / count(*) > greatest(0.05, 2 * (select 1 - count(o_totalprice) / count(*) from a)) union all select 'unseen_category', 'o_orderpriority', 'warning', string_agg(v, ', ' order by v) from (select distinct o_orderpriority as v from b where o_orderpriority not in (select o_orderpriority from a)) having count(*) > 0")
def _(spark, d):
    old, new = halves(spark, d)
    new = new.drop("o_custkey").withColumn("added", F.lit(1)).withColumn("o_orderstatus", F.length("o_orderstatus")).withColumn("o_totalprice", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")))
    new = new.withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 50 == 0, "unheard").otherwise(F.col("o_orderpriority")))
    return S.schema_check(old, new, ["o_orderpriority"])


@query("drift_report", f"with a as (select * from orders where {OLD}), b as (select * from orders where {NEW}), t as (select sum(abs(coalesce(x.s, 0) - coalesce(y.s, 0))) / 2 as d from (select o_orderpriority, count(*) / sum(count(*)) over () as s from a group by 1) x full join (select o_orderpriority, count(*) / sum(count(*)) over () as s from b group by 1) y using (o_orderpriority)), n as (select (select avg(o_totalprice) from b) - avg(o_totalprice) as x, stddev_samp(o_totalprice) as s from a) select 'o_totalprice' as variable, 'numeric' as kind, {{{{x / s}}}} as drift, case when abs(x / s) < 0.1 then 'none' when abs(x / s) < 0.3 then 'slight' when abs(x / s) < 0.8 then 'moderate' else 'large' end as reading from n union all select 'o_orderpriority', 'categorical', {{{{d}}}}, case when d < 0.05 then 'none' when d < 0.15 then 'slight' when d < 0.35 then 'moderate' else 'large' end from t")
def _(spark, d):
    return rounded(S.drift_report(*halves(spark, d), ["o_totalprice"], ["o_orderpriority"]))


V = "select '{0}' as variable, 'text' as kind, count(*) as rows, count(*) - count({0}) as missing, count(distinct {0}) as \"distinct\", null::double as mean, null::double as std, list_sort(list(distinct {0}))::varchar as levels from orders"


@query("version_snapshot", V.format("o_orderstatus") + " union all " + V.format("o_orderpriority") + " union all select 'o_totalprice', 'numeric', count(*), count(*) - count(o_totalprice), count(distinct o_totalprice), {{avg(o_totalprice)}}, {{stddev_samp(o_totalprice)}}, null from orders")
def _(spark, d):
    got = rounded(S.version_snapshot(table(spark, d, "orders").select("o_orderstatus", "o_orderpriority", "o_totalprice")))
    return got.withColumn("levels", F.when(F.col("levels").isNotNull(), F.concat(F.lit("["), F.concat_ws(", ", "levels"), F.lit("]"))))


@query("version_diff", f"with {GAPPY} select 'added' as variable, 'added' as change union all select 'o_custkey', 'removed' union all select 'o_orderstatus', 'kind' union all select 'o_orderpriority', case when (select list_sort(list(distinct o_orderpriority)) from a) = (select list_sort(list(distinct o_orderpriority)) from b) then 'same' else 'levels' end union all select 'o_totalprice', case when abs((select 1 - count(o_totalprice) / count(*) from a) - (select 1 - count(o_totalprice) / count(*) from b)) >= 0.02 then 'missing' else 'same' end union all select 'o_orderkey', case when abs((select avg(o_orderkey) from b) - avg(o_orderkey)) >= 0.2 * stddev_samp(o_orderkey) then 'mean' else 'same' end from a union all select null, 'rows' where (select count(*) from a) <> (select count(*) from b)")
def _(spark, d):
    old, new = halves(spark, d)
    new = new.selectExpr("o_orderkey", "case when o_orderkey % 3 <> 0 then o_totalprice end as o_totalprice", "case when o_orderkey % 50 = 0 then 'unheard' else o_orderpriority end as o_orderpriority", "length(o_orderstatus) as o_orderstatus", "1 as added")
    return S.version_diff(old.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice"), new)


@query("build_contract", "select 'o_orderstatus' as variable, 'text' as kind, count(distinct o_orderstatus) as levels, 0.05::double as missing_limit from orders union all select 'o_orderpriority', 'text', count(distinct o_orderpriority), 0.05 from orders union all select 'o_totalprice', 'numeric', null, 0.05")
def _(spark, d):
    return rounded(S.contract_rows(S.build_contract(table(spark, d, "orders").select("o_orderstatus", "o_orderpriority", "o_totalprice")), spark))


CONTRACT = ["o_orderstatus", "o_orderpriority", "o_totalprice"]
AGAINST = f"with a as (select * from orders where {OLD}), b as (select o_orderstatus, case when o_orderkey % 50 = 0 then 'unheard' else o_orderpriority end as o_orderpriority, case when o_orderkey % 3 <> 0 then o_totalprice end as o_totalprice from orders where {NEW}), n as (select count(*) as k from b), "


@query(
    "check_contract",
    AGAINST
    + "g as (" + " union all ".join(f"select '{c}' as v, (select 1 - count({c}) / count(*) from b) <= greatest(0.05, 2 * (1 - count({c}) / count(*))) as ok from a" for c in CONTRACT) + "), l as (" + " union all ".join(f"select '{c}' as v, (select count(*) from b where {c} not in (select distinct {c} from a)) = 0 as ok, count(distinct {c}) <= 50 as few from a" for c in CONTRACT[:2]) + ") "
    f"select 'column_present' as rule, unnest({CONTRACT}) as variable, true as passed, 'blocking' as severity union all select 'missing_share', v, ok, 'warning' from g union all select 'known_levels', v, ok, 'warning' from l union all select 'few_levels', v, few, 'warning' from l "
    "union all select 'least_rows', null, k >= (select greatest(30, floor(count(*) / 100)) from a), 'blocking' from n union all select 'duplicates', null, k - (select count(*) from (select distinct * from b)) <= 0.05 * k, 'warning' from n union all select 'leakage', null, true, 'warning' union all select 'target_present', 'o_orderstatus', true, 'blocking' "
    "union all select 'target_missing', 'o_orderstatus', 1 - count(o_orderstatus) / count(*) <= 0.3, case when 1 - count(o_orderstatus) / count(*) > 0.6 then 'blocking' else 'warning' end from b union all select 'classes', 'o_orderstatus', count(distinct o_orderstatus) >= 2, 'blocking' from b",
)
def _(spark, d):
    old, new = halves(spark, d)
    new = new.withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 50 == 0, "unheard").otherwise(F.col("o_orderpriority"))).withColumn("o_totalprice", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")))
    return S.check_contract(new.select(*CONTRACT), S.build_contract(old.select(*CONTRACT)), "o_orderstatus", "classification")
