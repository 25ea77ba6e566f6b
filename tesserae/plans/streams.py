"""Queries of section 2.14: events replayed as files, drained into a table and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import models, scoring
from tesserae.plans.describing import rounded
from tesserae.plans.registry import query
from tesserae.sources.written import new_folder
from tesserae.session import table
from tesserae.streaming import jobs as J


#: Rows of one file of a replayed stream, about.
FILE_ROWS = 500_000


def events(spark, d, close=False):
    """events written in four parts, one after the other in the order of time, then read as a stream of one part a trigger.

    A part is one file, or several of about FILE_ROWS rows, as many in each part, so that a trigger takes a whole part.
    close: a last event long after the others, so that the watermark passes every window of theirs; its own stays open.
    """
    path = new_folder(spark)
    t = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    part, last, files = F.lit(0), None, 1
    if cut := t.agg(F.percentile_approx(F.unix_micros("ts"), [0.25, 0.5, 0.75])).first()[0]:
        part = sum((F.when(F.unix_micros("ts") > e, 1).otherwise(0) for e in cut), F.lit(0))
        row = t.agg(F.max("ts") + F.expr("interval 2 days"), *[F.count_if(part == i) for i in range(4)]).first()
        last, files = row[0], max(1, min(row[1:]) // FILE_ROWS)
    for i in range(4):  # the source orders files by the time of writing
        own = t.where(part == i)
        (own.coalesce(1) if files == 1 else own.repartition(files)).write.mode("append").parquet(path)
    if close and last:
        spark.range(1).select(*[F.lit(last if f.name == "ts" else None).cast(f.dataType).alias(f.name) for f in t.schema.fields]).coalesce(1).write.mode("append").parquet(path)
    return J.replay(spark, path, t.schema, files)


def drained(spark, stream):
    path = new_folder(spark)
    J.drain(stream, path, new_folder(spark))
    return spark.read.schema(stream.schema).parquet(path)


@query("stream_dedup", "select event_id, user_id from events")
def _(spark, d):
    return drained(spark, J.stream_dedup(events(spark, d), ["event_id"], late="60 days").select("event_id", "user_id"))


def said(df, *times):
    """Times as text."""
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in times})


@query("stream_drift_tumbling", "with b as (select avg(value) as m, stddev_samp(value) as s from events) select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n, {{avg(value)}} as mean, {{(avg(value) - any_value(m)) / any_value(s)}} as drift from events, b group by 1")
def _(spark, d):
    base = table(spark, d, "events").agg(F.avg("value"), F.stddev_samp("value")).first()
    return said(rounded(drained(spark, J.stream_drift_tumbling(events(spark, d, close=True), "value", base[0], base[1]))), "start")


@query("stream_profile_sliding", "with w as (select unnest(range(0, 6)) as k), e as (select date_trunc('hour', ts) - k * interval 1 hour as start, value from events, w) select strftime(start, '%Y-%m-%d %H:%M:%S') as start, count(*) as n, {{avg(value)}} as mean, {{min(value)}} as min, {{quantile_disc(value, 0.25)}} as q1, {{quantile_disc(value, 0.5)}} as median, {{quantile_disc(value, 0.75)}} as q3, {{max(value)}} as max from e group by 1")
def _(spark, d):
    return said(rounded(drained(spark, J.stream_profile_sliding(events(spark, d, close=True), "value"))), "start")


@query("stream_profile_keys")
def _(spark, d):
    return said(rounded(drained(spark, J.stream_profile_sliding(events(spark, d, close=True), "value", "user_id"))), "start")


@query("stream_sessions", "with p as (select user_id, ts, ts - lag(ts) over w > interval 30 minutes as new from events window w as (partition by user_id order by ts)), s as (select user_id, ts, sum(coalesce(new, true)::int) over (partition by user_id order by ts) as k from p) select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, strftime(max(ts) + interval 30 minutes, '%Y-%m-%d %H:%M:%S') as end, count(*) as n from s group by user_id, k")
def _(spark, d):
    return said(drained(spark, J.stream_sessions(events(spark, d, close=True), "user_id")), "start", "end")


@query("stream_zscore", "with e as (select user_id as key, ts, value, avg(value) over w as m, stddev_pop(value) over w as s from events where value is not null window w as (partition by user_id order by ts, value rows between unbounded preceding and 1 preceding)) select key, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, {{value}} as value, {{case when s > 0 then (value - m) / s else 0 end}} as z, coalesce(case when s > 0 then abs((value - m) / s) > 3 * (1 + 1e-9) end, false) as anomaly from e")
def _(spark, d):
    return said(rounded(drained(spark, J.stream_zscore(events(spark, d), "user_id", "value"))), "ts")


@query("stream_zscore_expiring", "with p as (select user_id, ts, value, coalesce(ts - lag(ts) over (partition by user_id order by ts, value) > interval 6 hours, false)::int as new from events where value is not null), g as (select *, sum(new) over (partition by user_id order by ts, value rows unbounded preceding) as part from p), e as (select user_id as key, ts, value, avg(value) over w as m, stddev_pop(value) over w as s from g window w as (partition by user_id, part order by ts, value rows between unbounded preceding and 1 preceding)) select key, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, {{value}} as value, {{case when s > 0 then (value - m) / s else 0 end}} as z, coalesce(case when s > 0 then abs((value - m) / s) > 3 * (1 + 1e-9) end, false) as anomaly from e")
def _(spark, d):
    """A user starts afresh after six hours; the state goes with the watermark."""
    return said(rounded(drained(spark, J.stream_zscore(events(spark, d), "user_id", "value", forget="6 hours"))), "ts")


@query("stream_score", "with q as (select quantile_cont(value, 0.001) as lo, quantile_cont(value, 0.999) as hi from events) select event_id, {{(select avg(value) from events)}} as prediction, case when value is null or event_type is null or coalesce(value < lo - (hi - lo) or value > hi + (hi - lo), false) then 'abstained' else 'reliable' end as reliability from events, q")
def _(spark, d):
    t = table(spark, d, "events")
    model = models.fit("baseline_dummy", t, ["value"], "value")
    got = J.stream_score(events(spark, d), model, t, ["value"], ["event_type"])
    return rounded(drained(spark, got.select("event_id", "prediction", "reliability")))


@query("stream_contract", "select event_type <> 'purchase' as kept, count(*) as n from events group by 1")
def _(spark, d):
    t = table(spark, d, "events").select("event_id", "event_type", "value")
    contract = scoring.build_contract(t.where("event_type <> 'purchase'"))
    good, bad = new_folder(spark), new_folder(spark)
    J.stream_contract(events(spark, d).select("event_id", "event_type", "value"), contract, good, bad, new_folder(spark)).trigger(availableNow=True).start().awaitTermination()
    parts = [spark.read.parquet(p).select(F.lit(k).alias("kept")) for p, k in ((good, True), (bad, False))]
    return parts[0].unionAll(parts[1]).groupBy("kept").agg(F.count(F.lit(1)).alias("n"))


@query("score_new_data")
def _(spark, d):
    """Check, skip empty rows, predict, intervals from held-out residuals, reliability."""
    from tesserae.operators import evaluate, rows

    x = table(spark, d, "lineitem")
    old, new = x.where("l_shipdate < '1998-01-01'"), x.where("l_shipdate >= '1998-01-01'")
    if not scoring.schema_check(old, new).where("severity = 'fatal'").isEmpty():
        raise ValueError("columns are missing")
    train, held = models.train_holdout(old, ["l_orderkey", "l_linenumber", "l_partkey"])
    model = models.fit("gram_ridge", train, ["l_quantity", "l_discount"], "l_extendedprice")
    half = evaluate.conformal_interval(model(held), "l_extendedprice", "prediction").first()["half_width"]
    got = model(rows.drop_empty_rows(new, ["l_quantity", "l_discount"]))
    got = got.withColumn("low", F.col("prediction") - half).withColumn("high", F.col("prediction") + half)
    got = evaluate.row_reliability(got, old, ["l_quantity", "l_discount"], ["l_returnflag"])
    return rounded(got.select("l_orderkey", "l_linenumber", "prediction", "low", "high", "reliability"))
