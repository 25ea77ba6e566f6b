"""Queries of section 2.11: evaluation over fixed predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import evaluate as E
from tesserae.plans.describing import rounded
from tesserae.plans.registry import query
from tesserae.plans.tables import KEY, daily, predictions
from tesserae.session import table

P = "(select *, l_extendedprice as actual, 2000 * l_quantity as predicted, l_extendedprice - 2000 * l_quantity as e, (l_returnflag = 'R')::int as label, l_discount * 10 as score, (l_discount * 10 >= 0.5)::int as said from lineitem)"


@query("regression_metrics", f"select count(*) as n, {{{{1 - sum(e * e) / (var_pop(actual) * count(*))}}}} as r2, {{{{sqrt(avg(e * e))}}}} as rmse, {{{{avg(abs(e))}}}} as mae, {{{{quantile_cont(abs(e), 0.5)}}}} as median_ae, {{{{max(abs(e))}}}} as max_error, {{{{avg(abs(e / actual))}}}} as mape, {{{{avg(2 * abs(e) / (abs(actual) + abs(predicted)))}}}} as smape, {{{{1 - var_pop(e) / var_pop(actual)}}}} as explained_variance from {P}")
def _(spark, d):
    return rounded(E.regression_metrics(predictions(spark, d)))


def labelled(spark, d):
    return predictions(spark, d).withColumn("said", (F.col("score") >= 0.5).cast("int"))


@query("confusion_matrix", f"select label as actual, said as predicted, count(*) as n from {P} group by 1, 2")
def _(spark, d):
    return E.confusion_matrix(labelled(spark, d), "label", "said")


@query("confusion_rates", f"with c as (select count(*) filter (label = 1 and said = 1) as tp, count(*) filter (label = 0 and said = 1) as fp, count(*) filter (label = 0 and said = 0) as tn, count(*) filter (label = 1 and said = 0) as fn from {P}) select 1 as class, tp, fp, tn, fn, {{{{tp / (tp + fn)}}}} as sensitivity, {{{{tn / (tn + fp)}}}} as specificity, {{{{fp / (tn + fp)}}}} as false_positive_rate, {{{{fn / (tp + fn)}}}} as false_negative_rate from c union all select 0, tn, fn, tp, fp, {{{{tn / (tn + fp)}}}}, {{{{tp / (tp + fn)}}}}, {{{{fn / (tp + fn)}}}}, {{{{fp / (tn + fp)}}}} from c")
def _(spark, d):
    return rounded(E.confusion_rates(labelled(spark, d), "label", "said"))


C = f"with c as (select count(*) filter (label = 1 and said = 1)::double as tp, count(*) filter (label = 0 and said = 1)::double as fp, count(*) filter (label = 0 and said = 0)::double as tn, count(*) filter (label = 1 and said = 0)::double as fn, count(*)::double as n from {P}) "


@query("classification_metrics", C + f"select n::bigint as n, {{{{(tp + tn) / n}}}} as accuracy, {{{{(tp / (tp + fn) + tn / (tn + fp)) / 2}}}} as balanced_accuracy, {{{{(tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))}}}} as mcc, {{{{((tp + tn) / n - ((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn)) / (n * n)) / (1 - ((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn)) / (n * n))}}}} as kappa, {{{{tp / (tp + fp)}}}} as precision, {{{{tp / (tp + fn)}}}} as recall, {{{{2 * tp / (2 * tp + fp + fn)}}}} as f1, {{{{(select avg((score - label) ** 2) from {P})}}}} as brier from c")
def _(spark, d):
    return rounded(E.classification_metrics(labelled(spark, d), "label", "said", "score").drop("log_loss"))


@query("per_class_report", C + "select 0 as class, (tn + fp)::bigint as support, (tn + fn)::bigint as predicted, {{tn / (tn + fn)}} as precision, {{tn / (tn + fp)}} as recall, {{2 * tn / (2 * tn + fp + fn)}} as f1, false as ignored from c union all select 1, (tp + fn)::bigint, (tp + fp)::bigint, {{tp / (tp + fp)}}, {{tp / (tp + fn)}}, {{2 * tp / (2 * tp + fp + fn)}}, false from c")
def _(spark, d):
    return rounded(E.per_class_report(labelled(spark, d), "label", "said"))


@query("roc_auc", f"with r as (select label, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2 as r from {P}), s as (select sum(r) filter (label = 1) as rs, count(*) filter (label = 1) as p, count(*) filter (label = 0) as q from r) select {{{{(rs - p * (p + 1) / 2) / (p * q)}}}} as roc_auc, p + q as n from s")
def _(spark, d):
    return rounded(E.roc_auc(predictions(spark, d), "label", "score"))


CUM = f"with c as (select score, sum(label) as p, sum(1 - label) as f from {P} group by 1), t as (select score, p, sum(p) over (order by score desc) as tp, sum(f) over (order by score desc) as fp, sum(p) over () as tpa, sum(f) over () as fpa from c) "


@query("roc_curve", CUM + "select {{score}} as score, {{fp / fpa}} as fpr, {{tp / tpa}} as tpr from t")
def _(spark, d):
    return rounded(E.roc_curve(predictions(spark, d), "label", "score"))


@query("pr_curve", CUM + "select {{score}} as score, {{tp / (tp + fp)}} as precision, {{tp / tpa}} as recall from t")
def _(spark, d):
    return rounded(E.pr_curve(predictions(spark, d), "label", "score"))


@query("pr_auc", CUM + "select {{sum(p / tpa * tp / (tp + fp))}} as pr_auc from t")
def _(spark, d):
    return rounded(E.pr_auc(predictions(spark, d), "label", "score"))


@query("calibration", f"select least(floor(score * 10), 9)::int as bin, count(*) as n, {{{{avg(score)}}}} as predicted, {{{{avg(label)}}}} as observed, {{{{abs(avg(score) - avg(label))}}}} as gap from {P} group by 1 having count(*) >= 5")
def _(spark, d):
    return rounded(E.calibration(predictions(spark, d), "label", "score"))


@query("calibration_summary", f"with x as (select label as y, score as s, least(greatest(score, 1e-15), 1 - 1e-15) as p, least(floor(score * 10), 9) as b from {P}), g as (select b, count(*) as n, abs(sum(s) - sum(y)) as gap from x group by 1), t as (select count(*) as n, avg(y) as r, avg((s - y) ** 2) as br, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) as l from x) select t.n, {{{{r}}}} as base_rate, {{{{(select sum(gap) from g) / t.n}}}} as ece, {{{{(select max(gap / n) from g)}}}} as mce, {{{{br}}}} as brier, {{{{1 - br / (r * (1 - r))}}}} as skill, {{{{l}}}} as log_loss from t")
def _(spark, d):
    return rounded(E.calibration_summary(predictions(spark, d), "label", "score"))


@query("residual_checks", f"with x as (select e, predicted as p, abs(e) as a from {P}), k as (select rank() over (order by a) + (count(*) over (partition by a) - 1) / 2 as ra, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2 as rp from x), m as (select avg(e) as b, var_pop(e) as v, count(*) as n from x) select any_value(n) as n, {{{{any_value(n) / 6 * ((avg((e - b) ** 3) / any_value(v) ** 1.5) ** 2 + (avg((e - b) ** 4) / any_value(v) ** 2 - 3) ** 2 / 4)}}}} as jarque_bera, {{{{(select corr(ra, rp) from k)}}}} as spread_with_prediction from x, m")
def _(spark, d):
    return rounded(E.residual_checks(predictions(spark, d)))


@query("threshold_costs", f"with i as (select unnest(range(1, 20)) as i), p as (select label, least(floor(round(score * 20, 9)), 19) as k from {P}) select {{{{i / 20}}}} as threshold, count(*) filter (k >= i and label = 1) as tp, count(*) filter (k >= i and label = 0) as fp, count(*) filter (k < i and label = 0) as tn, count(*) filter (k < i and label = 1) as fn, {{{{5 * count(*) filter (k < i and label = 1) + count(*) filter (k >= i and label = 0)}}}} as cost from i, p group by i")
def _(spark, d):
    return rounded(E.threshold_costs(predictions(spark, d), "label", "score", 5.0, 1.0))


@query("regression_diagnostics", f"with s as (select *, e - lag(e) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as d from {P}), m as (select avg(e) as b, stddev_samp(e) as sd from s) select {{{{b}}}} as bias, {{{{sd}}}} as std, {{{{sum((e - b) ** 3) / count(*) / (sum((e - b) ** 2) / count(*)) ** 1.5}}}} as skew, {{{{kurtosis_pop(e)}}}} as kurtosis, {{{{count(*) filter (abs((e - b) / sd) > 3) / count(*)}}}} as far, {{{{sum(d * d) / sum(e * e)}}}} as durbin_watson from s, m group by b, sd")
def _(spark, d):
    return rounded(E.regression_diagnostics(predictions(spark, d), ["l_linenumber", "l_partkey", "l_suppkey"], group="l_orderkey"))


@query("conformal_interval", f"with r as (select abs(e) as r, row_number() over (order by abs(e)) as k, count(*) over () as n from {P}) select n, {{{{r}}}} as half_width from r where k = ceil((n + 1) * 0.9::double)")
def _(spark, d):
    return rounded(E.conformal_interval(predictions(spark, d), "actual", "predicted"))


@query("subgroup_errors", f"with x as (select l_returnflag, l_linestatus, abs(e) as e from (select p.*, l_linestatus as ls from {P} p)), w as (select avg(e) as m, stddev_samp(e) as s, count(*) as n from x), g as (select l_returnflag, l_linestatus, count(*) as k, avg(e) as er from x group by grouping sets ((l_returnflag), (l_linestatus), (l_returnflag, l_linestatus))) select l_returnflag, l_linestatus, k as n, {{{{er}}}} as error, {{{{er / m}}}} as ratio, {{{{(er - m) / (s / sqrt(k))}}}} as z, abs((er - m) / (s / sqrt(k))) >= 3 and (er / m >= 1.3 or er / m <= 0.75) as notable from g, w where k >= 30 and k < 0.95 * w.n")
def _(spark, d):
    x = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_extendedprice").alias("actual"), (2000 * F.col("l_quantity")).alias("predicted"))
    return rounded(E.subgroup_errors(x, ["l_returnflag", "l_linestatus"]))


@query("subgroup_bands", "with q as (select quantile_cont(l_quantity, 1/3) as a, quantile_cont(l_quantity, 2/3) as b from lineitem), top as (select l_linenumber::varchar as v from lineitem group by 1 order by count(*) desc, 1 limit 3), x as (select case when l_quantity <= a then 'low' when l_quantity <= b then 'middle' else 'high' end as l_quantity_band, case when l_linenumber::varchar in (select v from top) then l_linenumber::varchar else 'other' end as l_linenumber_band, abs(l_extendedprice - 2000 * l_quantity) as e from lineitem, q), w as (select avg(e) as m, stddev_samp(e) as s, count(*) as n from x), g as (select l_quantity_band, l_linenumber_band, count(*) as k, avg(e) as er from x group by grouping sets ((l_quantity_band), (l_linenumber_band), (l_quantity_band, l_linenumber_band))) select l_quantity_band, l_linenumber_band, k as n, {{er}} as error, {{er / m}} as ratio, {{(er - m) / (s / sqrt(k))}} as z, abs((er - m) / (s / sqrt(k))) >= 3 and (er / m >= 1.3 or er / m <= 0.75) as notable from g, w where k >= 30 and k < 0.95 * w.n")
def _(spark, d):
    x = E.facets_of(table(spark, d, "lineitem"), ["l_quantity"], ["l_linenumber"], top=3)
    x = x.select("l_quantity_band", "l_linenumber_band", F.col("l_extendedprice").alias("actual"), (2000 * F.col("l_quantity")).alias("predicted"))
    return rounded(E.subgroup_errors(x, ["l_quantity_band", "l_linenumber_band"]))


@query("row_reliability", "with t as (select quantile_cont(o_totalprice, 0.001) as lo, quantile_cont(o_totalprice, 0.999) as hi from orders where o_orderdate < '1998-01-01'), n as (select o_orderkey, case when o_orderkey % 7 = 0 then null when o_orderkey % 11 = 0 then 1e9 else o_totalprice end as v, case when o_orderkey % 5 = 0 then 'new' else o_orderpriority end as c from orders where o_orderdate >= '1998-01-01') select o_orderkey, case when v is null or v < lo - (hi - lo) or v > hi + (hi - lo) then 'abstained' when c = 'new' then 'caution' else 'reliable' end as reliability, concat_ws('; ', case when v is null then 'half the values are missing' end, case when v < lo - (hi - lo) or v > hi + (hi - lo) then 'beyond the training range' end, case when c = 'new' then 'unseen level' end) as reasons from n, t")
def _(spark, d):
    o = table(spark, d, "orders")
    new = o.where("o_orderdate >= '1998-01-01'").selectExpr("o_orderkey", "case when o_orderkey % 7 = 0 then null when o_orderkey % 11 = 0 then 1e9 else o_totalprice end as o_totalprice", "case when o_orderkey % 5 = 0 then 'new' else o_orderpriority end as o_orderpriority")
    return E.row_reliability(new, o.where("o_orderdate < '1998-01-01'"), ["o_totalprice"], ["o_orderpriority"]).select("o_orderkey", "reliability", F.concat_ws("; ", "reasons").alias("reasons"))


R = "select l_returnflag as model, l_linenumber as fold, avg(l_discount) * 10 as train, avg(l_tax) * 10 as held_out from lineitem group by 1, 2"


def results(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("fold")).agg((F.avg("l_discount") * 10).alias("train"), (F.avg("l_tax") * 10).alias("held_out"))


@query("overfit_instability_flags", f"select model, {{{{avg(train)}}}} as train, {{{{avg(held_out)}}}} as held_out, {{{{avg(train) - avg(held_out)}}}} as gap, {{{{stddev_samp(held_out) / abs(avg(held_out))}}}} as cv, avg(train) - avg(held_out) > 0.1 as overfit, stddev_samp(held_out) / abs(avg(held_out)) > 0.3 as unstable from ({R}) group by 1")
def _(spark, d):
    return rounded(E.overfit_flags(results(spark, d)))


T = "select l_linestatus as segment, l_returnflag || l_linenumber as model, avg(l_quantity) as performance, avg(l_discount) * 10 as generalisation, avg(l_tax) * 10 as stability, 0.5 as interpretability, 0.25 as efficiency from lineitem group by 1, 2"


def entries(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("segment"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("model")).agg(F.avg("l_quantity").alias("performance"), (F.avg("l_discount") * 10).alias("generalisation"), (F.avg("l_tax") * 10).alias("stability"), F.lit(0.5).alias("interpretability"), F.lit(0.25).alias("efficiency"))


TS = f"with t as ({T}), c as (select segment, model, 0.5 * (performance - min(performance) over w) / (max(performance) over w - min(performance) over w) + 0.2 * generalisation + 0.15 * stability + 0.1 * interpretability + 0.05 * efficiency as composite from t window w as (partition by segment)), k as (select *, row_number() over (partition by segment order by composite desc, model) as rank from c) "


@query("tournament_rank", TS + "select segment, model, {{composite}} as composite, rank from k")
def _(spark, d):
    return rounded(E.tournament_rank(entries(spark, d)).select("segment", "model", "composite", "rank"))


@query("tournament_roles", TS + "select segment, 'recommended' as role, arg_min(model, struct_pack(a := -composite, b := model)) as model from c group by 1 union all select segment, 'highest', arg_min(model, struct_pack(a := -p, b := model)) from (select segment, model, performance as p from t) group by 1 union all select segment, 'simplest', arg_min(model, struct_pack(a := -composite, b := model)) from c join (select segment, model, performance >= 0.999 * max(performance) over (partition by segment) as fair from t) using (segment, model) where fair group by 1 union all select segment, 'baseline', 'A1' from c where model = 'A1'")
def _(spark, d):
    return E.tournament_roles(E.tournament_rank(entries(spark, d)), baseline="A1", tolerance=0.001)


@query("rank_per_series", TS + "select segment, model, {{composite}} as composite, rank from k where rank = 1")
def _(spark, d):
    return rounded(E.rank_per_series(E.tournament_rank(entries(spark, d)), "segment").select("segment", "model", "composite", "rank"))


@query("run_difference", "with a as (select o_orderpriority as model, avg(o_totalprice) as score, stddev_samp(o_totalprice) / sqrt(count(*)) as s from orders where o_orderdate < '1998-01-01' group by 1), b as (select o_orderpriority as model, avg(o_totalprice) as score, stddev_samp(o_totalprice) / sqrt(count(*)) as s from orders where o_orderdate >= '1998-01-01' group by 1) select model, {{a.score}} as score_old, {{b.score}} as score_new, {{b.score - a.score}} as difference, case when abs(b.score - a.score) <= greatest(a.s, b.s) then 'tie' when b.score > a.score then 'better' else 'worse' end as state from a join b using (model)")
def _(spark, d):
    o = table(spark, d, "orders")
    g = lambda x: x.groupBy(F.col("o_orderpriority").alias("model")).agg(F.avg("o_totalprice").alias("score"), (F.stddev_samp("o_totalprice") / F.sqrt(F.count(F.lit(1)))).alias("spread"))
    return rounded(E.run_difference(g(o.where("o_orderdate < '1998-01-01'")), g(o.where("o_orderdate >= '1998-01-01'"))))


@query("forecast_metrics", "with s as (select o_orderpriority as key, date_trunc('month', o_orderdate)::date as t, sum(o_totalprice) as y from orders group by 1, 2), n as (select key, avg(abs(d)) as naive from (select key, y - lag(y) over (partition by key order by t) as d from s where t < '1999-01-01') group by 1), x as (select key, y, y * 0.9 as p, lag(y) over (partition by key order by t) as b from s where t >= '1999-01-01') select key, count(*) as n, {{avg(abs(y - p))}} as mae, {{sqrt(avg((y - p) ** 2))}} as rmse, {{1 - avg((y - p) ** 2) / var_pop(y)}} as r2, {{avg(abs((y - p) / y))}} as mape, {{avg(2 * abs(y - p) / (abs(y) + abs(p)))}} as smape, {{avg(abs(y - p)) / any_value(naive)}} as mase, {{avg((sign(y - b) = sign(p - b))::int)}} as direction from x join n using (key) group by 1")
def _(spark, d):
    s = daily(spark, d)
    test = s.where("t >= '1999-01-01'").withColumn("predicted", F.col("y") * 0.9)
    return rounded(E.forecast_metrics(s.where("t < '1999-01-01'"), test, "key", "t"))


__all__ = ["KEY"]
