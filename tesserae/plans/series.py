"""Queries of section 2.12: series of orders by month and priority."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import series as S
from tesserae.plans.describing import rounded
from tesserae.plans.registry import query
from tesserae.plans.tables import DAILY, daily
from tesserae.session import table

N = f"(select *, row_number() over (partition by key order by t) - 1 as i, row_number() over (partition by key order by t desc) as k, count(*) over (partition by key) as n from ({DAILY}))"


@query("build_series", "select o_orderpriority as key, date_trunc('month', o_orderdate)::date as t, {{avg(o_totalprice)}} as y from orders group by 1, 2")
def _(spark, d):
    return rounded(S.build_series(table(spark, d, "orders"), "o_orderpriority", "o_orderdate", "o_totalprice", "month"))


TREND = f"with r as (select *, rank() over (partition by key order by y) + (count(*) over (partition by key, y) - 1) / 2 as r from {N}) select key, count(*) as n, {{{{regr_slope(y, i)}}}} as slope, {{{{corr(r, i)}}}} as spearman, {{{{arg_max(y, t) - arg_min(y, t)}}}} as change, {{{{(arg_max(y, t) - arg_min(y, t)) / abs(arg_min(y, t))}}}} as relative_change from r group by 1"


@query("series_trend", TREND)
def _(spark, d):
    return rounded(S.series_trend(daily(spark, d)))


GAPS = f"with x as (select key, t, t - lag(t) over (partition by key order by t) as gap from ({DAILY})), m as (select key, quantile_cont(gap, 0.5) as sp from x group by 1), g as (select key, any_value(sp) as sp, count(*) as n, count(*) filter (gap > 1.5 * sp) as gaps, max(gap) as largest, max(t) - min(t) as span from x join m using (key) group by 1) "


GAP_ROWS = GAPS + "select key, n, {{sp}} as spacing, gaps, largest::bigint as largest, (floor(span / sp) + 1)::bigint as expected from g"


@query("series_gaps", GAP_ROWS)
def _(spark, d):
    return rounded(S.series_gaps(daily(spark, d)))


@query("infer_frequency", GAPS + "select key, {{sp}} as spacing, case when sp <= 1.5 then 'daily' when sp <= 8 then 'weekly' when sp <= 32 then 'monthly' when sp <= 95 then 'quarterly' else 'yearly' end as frequency, (floor(span / sp) + 1)::bigint as expected, n as actual from g")
def _(spark, d):
    return rounded(S.infer_frequency(daily(spark, d)))


@query("seasonal_period", GAPS + "select key, case when sp <= 1.5 then 7 when sp between 6 and 8 then 52 when sp between 28 and 32 then 12 when sp between 88 and 93 then 4 else 1 end as period from g")
def _(spark, d):
    return S.seasonal_period(daily(spark, d))


@query("autocorrelation", f"with x as (select key, i, y - avg(y) over (partition by key) as d, n from {N}), l as (select unnest(range(1, 7))::int as lag), p as (select key, lag, d, n, lag(d, lag) over (partition by key, lag order by i) as b from x, l) select key, lag, {{{{sum(d * b) / sum(d * d)}}}} as r, abs(sum(d * b) / sum(d * d)) > 1.96 / sqrt(count(*)) as significant from p group by 1, 2")
def _(spark, d):
    return rounded(S.autocorrelation(daily(spark, d), 6))


SEASONS = f"with l as (select key, regr_slope(y, i) as a, regr_intercept(y, i) as b from {N} group by 1), x as (select key, i % 12 as pos, y - a * i - b as d from {N} join l using (key)), g as (select key, pos, count(*) as n, avg(d) as m, var_pop(d) as v from x group by 1, 2), h as (select *, sum(n * m) over (partition by key) / sum(n) over (partition by key) as gm from g), a as (select key, sum(n) as n, count(*) as k, sum(n * (m - gm) ** 2) as b, sum(n * v) as w, arg_max(pos, m)::bigint as peak, arg_min(pos, m)::bigint as trough, max(m) - min(m) as amp from h group by 1) select key, {{{{b / (b + w)}}}} as strength, {{{{(b / (k - 1)) / (w / (n - k))}}}} as f, peak, trough, {{{{amp}}}} as amplitude from a"


@query("series_seasonality", SEASONS)
def _(spark, d):
    return rounded(S.series_seasonality(daily(spark, d), 12))


@query("decompose_series", f"with x as (select *, case when i >= 6 and k > 6 then (sum(y) over w - (lag(y, 6) over (partition by key order by t) + lead(y, 6) over (partition by key order by t)) / 2) / 12 end as trend from {N} window w as (partition by key order by t rows between 6 preceding and 6 following)), r as (select *, avg(y - trend) over (partition by key, i % 12) as raw from x), z as (select *, raw - avg(case when i < 12 then raw end) over (partition by key) as seasonal from r) select key, t, {{{{y}}}} as y, {{{{trend}}}} as trend, {{{{seasonal}}}} as seasonal, {{{{y - trend - seasonal}}}} as residual from z")
def _(spark, d):
    return rounded(S.decompose_series(daily(spark, d), 12))


BREAKS = f"with c as (select key, t, i, n, sum(y) over b as s1, sum(y * y) over b as q1, sum(y) over (partition by key) as s, sum(y * y) over (partition by key) as q from {N} window b as (partition by key order by t rows between unbounded preceding and 1 preceding)), m as (select *, s1 / i as m1, (s - s1) / (n - i) as m2 from c where i >= 10 and n - i >= 10), h as (select *, abs(m2 - m1) / sqrt((q1 - i * m1 * m1 + q - q1 - (n - i) * m2 * m2) / (n - 2)) as shift from m), r as (select *, row_number() over (partition by key order by shift desc, i) as rn from h) select key, t, i as position, {{{{shift}}}} as shift, {{{{m1}}}} as before, {{{{m2}}}} as after, shift >= 1 as flagged from r where rn = 1"


@query("structural_break", BREAKS)
def _(spark, d):
    return rounded(S.structural_break(daily(spark, d)))


@query("series_stationarity")
def _(spark, d):
    return rounded(S.series_stationarity(daily(spark, d)))


LAGS = f"with x as (select key, i, y - avg(y) over (partition by key) as d, n from {N}), l as (select unnest(range(1, 25))::int as lag), p as (select key, lag, d, n, lag(d, lag) over (partition by key, lag order by i) as b from x, l), r as (select key, lag, abs(sum(d * b) / sum(d * d)) > 1.96 / sqrt(count(*)) as hit from p group by 1, 2 having count(*) > lag) select key, string_agg(lag::varchar, ',' order by lag) as significant_lags from r where hit group by 1"


@query("analyse_series", f"select * exclude (significant_lags), coalesce(significant_lags, '') as significant_lags, concat_ws(',', case when flagged then 'break' end, case when expected > n then 'missing periods' end, case when n < 24 then 'too short' end) as issues from ({TREND}) join (select * exclude (n) from ({GAP_ROWS})) using (key) join ({SEASONS}) using (key) left join (select key, shift, flagged from ({BREAKS})) using (key) left join ({LAGS}) using (key)")
def _(spark, d):
    """Without the columns of series_stationarity, which SQL cannot check."""
    got = S.analyse_series(daily(spark, d), 12).drop("adf_p", "kpss_p", "stationarity")
    return rounded(got.withColumns({c: F.array_join(c, ",") for c in ("significant_lags", "issues")}))


H = "(select unnest(range(1, 7))::int as step)"


@query("forecast_naive", f"select key, step, {{{{y}}}} as forecast from {N}, {H} where k <= 3 and 3 - k = (step - 1) % 3")
def _(spark, d):
    return rounded(S.forecast_naive(daily(spark, d), 6, 3))


DRIFT = "select key, step, {{{{b + step * (b - a) / (n - 1)}}}} as forecast from (select key, arg_min(y, t) as a, arg_max(y, t) as b, count(*) as n from ({0}) group by 1), {1}"


@query("forecast_drift", DRIFT.format(DAILY, H))
def _(spark, d):
    return rounded(S.forecast_drift(daily(spark, d), 6))


@query("forecast_moving_average", f"select key, step, {{{{avg(y)}}}} as forecast from {N}, {H} where k <= 3 group by 1, 2")
def _(spark, d):
    return rounded(S.forecast_moving_average(daily(spark, d), 6))


@query("forecast_ses", f"with recursive a as (select unnest(range(1, 20)) / 20 as alpha), z as (select key, alpha, 0 as i, y as l, 0::double as e from {N}, a where i = 0 union all select z.key, z.alpha, x.i, z.l + z.alpha * (x.y - z.l), z.e + (x.y - z.l) ** 2 from z join {N} x on x.key = z.key and x.i = z.i + 1), f as (select z.*, row_number() over (partition by z.key order by e, alpha) as rn from z join (select key, max(i) as i from z group by 1) m on m.key = z.key and m.i = z.i) select key, step, {{{{l}}}} as forecast, {{{{alpha}}}} as alpha from f, {H} where rn = 1")
def _(spark, d):
    return rounded(S.forecast_ses(daily(spark, d), 6))


@query("forecast_holt")
def _(spark, d):
    return rounded(S.forecast_holt_winters(daily(spark, d), 6))


@query("forecast_holt_winters")
def _(spark, d):
    return rounded(S.forecast_holt_winters(daily(spark, d), 6, 12))


@query("forecast_theta")
def _(spark, d):
    return rounded(S.forecast_theta(daily(spark, d), 6))


@query("forecast_lagged_ml")
def _(spark, d):
    return rounded(S.forecast_lagged_ml(daily(spark, d), 4))


@query("forecast_var")
def _(spark, d):
    return rounded(S.forecast_var(daily(spark, d), 4))


@query("backtest", f"with o as (select unnest([1, 2, 3])::int as origin), c as (select key, origin, arg_min(y, t) as a, arg_max(y, t) as b, count(*) as n from {N} x, o where x.k - 1 >= origin * 4 group by 1, 2), s as (select key, origin, (origin * 4 - (k - 1))::int as step, y from {N} x, o where k - 1 < origin * 4 and k - 1 >= origin * 4 - 4) select key, origin, step, {{{{y}}}} as y, {{{{b + step * (b - a) / (n - 1)}}}} as forecast from s join c using (key, origin)")
def _(spark, d):
    return rounded(S.backtest(daily(spark, d), "drift", 4))


@query("forecast_run", f"with o as (select unnest([1, 2, 3])::int as origin), c as (select key, origin, arg_min(y, t) as a, arg_max(y, t) as b, count(*) as n from {N} x, o where x.k - 1 >= origin * 4 group by 1, 2), s as (select key, origin, (origin * 4 - (k - 1))::int as step, y from {N} x, o where k - 1 < origin * 4 and k - 1 >= origin * 4 - 4), e as (select key, abs(y - (b + step * (b - a) / (n - 1))) as e from s join c using (key, origin)), r as (select key, e, row_number() over (partition by key order by e) as i, count(*) over (partition by key) as m from e), h as (select key, e as half from r where i = least(ceil((m + 1) * 0.9::double), m)), w as (select key, arg_min(y, t) as a, arg_max(y, t) as b, count(*) as n from {N} x group by 1), g as (select unnest([1, 2, 3, 4])::int as step) select key, step, {{{{b + step * (b - a) / (n - 1)}}}} as forecast, {{{{b + step * (b - a) / (n - 1) - half}}}} as low, {{{{b + step * (b - a) / (n - 1) + half}}}} as high from w join h using (key), g")
def _(spark, d):
    return rounded(S.forecast_run(daily(spark, d), 4))

