"""Streams against the batch aggregates of the same events."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.plans import registry


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("events"))
    rng = np.random.default_rng(9)
    rows = [(i, int(s), int(u), "view", float(v)) for i, (s, u, v) in enumerate(zip(rng.integers(0, 5 * 86400, 1500), rng.integers(0, 20, 1500), rng.normal(size=1500), strict=True))]
    t = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double")
    t.select("event_id", F.timestamp_seconds(F.col("s") + 1704067200).alias("ts"), "user_id", "event_type", "value").write.parquet(f"{d}/events.parquet")
    return d


def counts(df, *cols):
    """Rows with times as text, as the queries return them."""
    times = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp"]
    return sorted(tuple(r) for r in df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in times}).select(*cols, "n").collect())


@pytest.mark.parametrize("name, width, slide", [("stream_drift_tumbling", "1 hour", None), ("stream_profile_sliding", "6 hours", "1 hour")])
def test_streams_emit_every_window(spark, folder, name, width, slide):
    t = spark.read.parquet(f"{folder}/events.parquet")
    want = t.groupBy(F.window("ts", width, slide)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "n")
    assert counts(registry.queries()[name](spark, folder), "start") == counts(want, "start")


def test_stream_emits_every_session(spark, folder):
    t = spark.read.parquet(f"{folder}/events.parquet")
    want = t.groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
    assert counts(registry.queries()["stream_sessions"](spark, folder), "user_id", "start", "end") == counts(want, "user_id", "start", "end")


def test_zscore_leaves_missing_values_out(spark, tmp_path):
    from tesserae.streaming import jobs

    rows = [(i, i, i % 3, None if i % 7 == 0 else float("nan") if i % 11 == 0 else float((i * 37) % 23)) for i in range(300)]
    t = spark.createDataFrame(rows, "event_id long, s long, user_id long, value double").withColumn("ts", F.timestamp_seconds(F.col("s") + 1704067200))
    t.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = jobs.stream_zscore(jobs.replay(spark, f"{tmp_path}/in", t.schema), "user_id", "value")
    jobs.drain(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    got = {(r["key"], r["ts"]): r["z"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    pdf = t.toPandas().dropna()
    assert len(got) == len(pdf)
    for key, own in pdf.groupby("user_id"):
        x = own.sort_values("ts")
        for k, (when, v) in enumerate(zip(x["ts"], x["value"], strict=True)):
            past = x["value"].to_numpy()[:k]
            want = (v - past.mean()) / past.std() if k > 1 and past.std() > 0 else 0.0
            assert abs(got[key, when.to_pydatetime()] - want) < 1e-9


def test_state_of_silent_keys_is_dropped(spark, tmp_path):
    """Every key is active for a day, one after the other: with forget, state rows fall; results are those of fresh starts."""
    from tesserae.streaming import jobs

    rows = [(86400 * k + 600 * i, k, float((i * 29) % 31)) for k in range(12) for i in range(60)] + [(86400 * 11 + 40_000 + 60 * i, 0, float(i % 5)) for i in range(30)]
    t = spark.createDataFrame(rows, "s long, user_id long, value double").withColumn("ts", F.timestamp_seconds(F.col("s") + 1704067200))
    for day in range(13):
        t.where((F.col("s") / 86400).cast("int") == day).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    totals = {}
    for forget in (None, "3 hours"):
        stream = jobs.stream_zscore(jobs.replay(spark, f"{tmp_path}/in", t.schema), "user_id", "value", forget=forget)
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out{forget}").option("checkpointLocation", f"{tmp_path}/c{forget}").trigger(availableNow=True).start()
        q.awaitTermination()
        totals[forget] = [p.stateOperators[0].numRowsTotal for p in q.recentProgress]
    assert max(totals[None]) == 12 and totals["3 hours"][-1] <= 2 and max(totals["3 hours"]) <= 3
    got = {(r["key"], r["ts"]): r["z"] for r in spark.read.parquet(f"{tmp_path}/out3 hours").collect()}
    assert len(got) == len(rows)
    pdf = t.toPandas().sort_values("ts")
    for key, own in pdf.groupby("user_id"):
        past, last = [], None
        for when, v in zip(own["ts"], own["value"], strict=True):
            if last is not None and (when - last).total_seconds() > 3 * 3600:
                past = []
            want = (v - np.mean(past)) / np.std(past) if len(past) > 1 and np.std(past) > 0 else 0.0
            assert abs(got[key, when.to_pydatetime()] - want) < 1e-9
            past.append(v)
            last = when


def test_quartiles_of_windows(spark, folder):
    t = spark.read.parquet(f"{folder}/events.parquet").toPandas()
    got = registry.queries()["stream_profile_sliding"](spark, folder).toPandas().set_index("start")
    for start, row in list(got.iterrows())[::15]:
        begin = np.datetime64(start)
        own = np.sort(t["value"][(t["ts"] >= begin) & (t["ts"] < begin + np.timedelta64(6, "h"))])
        for p, c in ((0.25, "q1"), (0.5, "median"), (0.75, "q3")):
            assert abs(row[c] - own[int(np.ceil(p * len(own))) - 1]) < 1e-6


def test_quartiles_of_large_windows_are_exact(spark, tmp_path):
    from tesserae.streaming import jobs

    x = np.random.default_rng(4).normal(size=30_001)
    t = spark.createDataFrame([(i % 3000, float(v)) for i, v in enumerate(x)], "s long, value double").select(F.timestamp_seconds(F.col("s") + 1704067200).alias("ts"), "value")
    t.coalesce(1).write.parquet(f"{tmp_path}/in")
    late = spark.createDataFrame([(1704067200 + 86400, None)], "s long, value double").select(F.timestamp_seconds("s").alias("ts"), "value")
    late.write.mode("append").parquet(f"{tmp_path}/in")
    stream = jobs.stream_profile_sliding(jobs.replay(spark, f"{tmp_path}/in", t.schema), "value", width="1 hour")
    jobs.drain(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    (row,) = spark.read.parquet(f"{tmp_path}/out").collect()
    own = np.sort(x)
    assert (row["q1"], row["median"], row["q3"]) == tuple(own[int(np.ceil(p * len(own))) - 1] for p in (0.25, 0.5, 0.75))


def test_score_and_its_sql_abstain_beyond_the_training_range(spark, tmp_path):
    import duckdb

    rows = [(i, None if i == 7 else 1e6 if i == 8 else float(i % 10), None if i == 9 else "view") for i in range(2000)]
    t = spark.createDataFrame(rows, "event_id long, value double, event_type string").withColumn("ts", F.timestamp_seconds(F.col("event_id") + 1704067200))
    t.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = {r["event_id"]: r["reliability"] for r in registry.queries()["stream_score"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    assert got == {r[0]: r[2] for r in con.execute(registry.oracle_sql()["stream_score"]).fetchall()}
    assert {i for i, r in got.items() if r == "abstained"} == {7, 8, 9}


def test_zscore_keeps_digits_and_leaves_ties_at_the_limit(spark, tmp_path):
    from tesserae.streaming import jobs

    values = [20.23, 20.25, 112.4] + [7.27] * 40 + [1.1]  # key 0: 9216 deviations; key 1: no spread before 1.1; key 2: exactly 3
    keys = [0] * 3 + [1] * 41
    values, keys = values + [27.69, 29.69, 31.69], keys + [2] * 3
    t = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(zip(keys, values, strict=True))], "s long, user_id long, value double").withColumn("ts", F.timestamp_seconds(F.col("s") + 1704067200))
    t.coalesce(1).write.parquet(f"{tmp_path}/in")
    jobs.drain(jobs.stream_zscore(jobs.replay(spark, f"{tmp_path}/in", t.schema), "user_id", "value"), f"{tmp_path}/out", f"{tmp_path}/state")
    got = {(r["key"], r["value"]): r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert abs(got[0, 112.4]["z"] - 9216) < 1e-6
    assert got[1, 1.1]["z"] == 0.0
    assert abs(got[2, 31.69]["z"] - 3) < 1e-12 and not got[2, 31.69]["anomaly"]


def test_zscore_orders_a_key_that_comes_in_several_frames(spark, tmp_path):
    from tesserae.streaming import jobs

    rng = np.random.default_rng(3)
    x, when = rng.normal(size=25_000), rng.permutation(25_000)
    t = spark.createDataFrame([(int(s), 1, float(v)) for s, v in zip(when, x, strict=True)], "s long, user_id long, value double").withColumn("ts", F.timestamp_seconds(F.col("s") + 1704067200))
    t.coalesce(1).write.parquet(f"{tmp_path}/in")
    jobs.drain(jobs.stream_zscore(jobs.replay(spark, f"{tmp_path}/in", t.schema), "user_id", "value"), f"{tmp_path}/out", f"{tmp_path}/state")
    got = [r["z"] for r in spark.read.parquet(f"{tmp_path}/out").orderBy("ts").collect()]
    own = x[np.argsort(when)]
    for k in range(2, 25_000, 499):
        assert abs(got[k] - (own[k] - own[:k].mean()) / own[:k].std()) < 1e-9


def test_a_trigger_takes_all_files_of_a_part(spark, folder, monkeypatch):
    """one task wrote each part of the replayed events, reading all of them."""
    from tesserae.plans import streams

    want = counts(registry.queries()["stream_sessions"](spark, folder), "user_id", "start", "end")
    monkeypatch.setattr(streams, "FILE_ROWS", 100)
    made = []
    monkeypatch.setattr(streams.J, "replay", lambda s, path, schema, files=1, f=streams.J.replay: (made.append((files, len(s.read.parquet(path).inputFiles()))), f(s, path, schema, files))[1])
    assert counts(registry.queries()["stream_sessions"](spark, folder), "user_id", "start", "end") == want
    assert registry.queries()["stream_dedup"](spark, folder).distinct().count() == 1500
    assert made == [(3, 13), (3, 12)]
