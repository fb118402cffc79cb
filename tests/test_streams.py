"""Streams against their batch forms, stopped and run again in the middle."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import logs, pairs
from quarry.queries import learned, outcomes
from quarry.sources import merge
from quarry.streaming import logs as streams

D = "/root/testdata/sf0.001"
ORDER = ["ts", "event_id"]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def events(spark):
    return outcomes(spark, D).withColumn("ts", F.col("ts").cast("timestamp"))


def halves(spark, events, folder):
    """A function that brings in the next part of the events, in two files."""
    mid = events.select(F.percentile_approx("ts", 0.5)).first()[0]
    for part in (events.filter(F.col("ts") <= F.lit(mid)), events.filter(F.col("ts") > F.lit(mid))):
        yield streams.in_files(part, folder, "ts", 2)


def test_failures_and_reverts(spark, events, tmp_path):
    source, out, at = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    failed, reset, reverted = F.col("outcome") == "failure", F.col("event_type") == "signup", F.col("outcome") == "partial"
    for _ in halves(spark, events, source):
        streams.to_files(streams.counted(streams.files_as_stream(spark, source, events.schema), failed, reset, reverted, ORDER), out, at).awaitTermination()
    got = spark.read.parquet(out)
    assert rows(got.select("event_id", "failure_count", "near", "intervene", "interventions", "escalate")) == rows(logs.failure_runs(events, failed, reset, ORDER).select("event_id", "failure_count", "near", "intervene", "interventions", "escalate"))
    assert rows(got.select("event_id", "reverts", "forced")) == rows(logs.revert_cap(events, reverted, ORDER).select("event_id", "reverts", "forced"))


def test_idle_sessions_are_forgotten(spark, tmp_path):
    source, out, at = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    schema = "session_id long, ts timestamp, event_id long, bad boolean"
    for part in ([(1, "2024-01-01 00:00:00", 1, True)], [(2, "2024-01-03 00:00:00", 2, True)], [(2, "2024-01-03 00:01:00", 3, True)], [(1, "2024-01-03 00:02:00", 4, True), (2, "2024-01-03 00:02:00", 5, None)]):
        spark.createDataFrame(part, "session_id long, ts string, event_id long, bad boolean").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(source)
    stream = streams.files_as_stream(spark, source, schema).withWatermark("ts", "1 minute")
    streams.to_files(streams.counted(stream, F.col("bad"), F.lit(False), F.lit(False), ORDER, idle="1 hour"), out, at).awaitTermination()
    assert {r.event_id: r.failure_count for r in spark.read.parquet(out).collect()} == {1: 1, 2: 1, 3: 2, 4: 1, 5: 2}


def test_outcomes_with_decisions(spark, events, tmp_path):
    decided = events.filter("event_type = 'click'").select("session_id", "ts", "event_id")
    left = events.filter("event_type <> 'click'").select("session_id", "ts", "event_id")
    a, b, out, at = (str(tmp_path / x) for x in ("a", "b", "out", "checkpoint"))
    last = spark.createDataFrame([(-1, "2099-01-01", -1)], "session_id long, ts string, event_id long").withColumn("ts", F.col("ts").cast("timestamp")).select("session_id", "ts", F.col("event_id").cast(left.schema["event_id"].dataType))
    for _ in zip(halves(spark, left, a), halves(spark, decided, b), strict=True):
        stream = streams.with_decisions(streams.files_as_stream(spark, a, left.schema), streams.files_as_stream(spark, b, decided.schema), late="30 days")
        streams.to_files(stream, out, at).awaitTermination()
    for folder in (a, b):  # time goes on, so what is still waited for comes out
        last.coalesce(1).write.mode("append").parquet(folder)
    streams.to_files(streams.with_decisions(streams.files_as_stream(spark, a, left.schema), streams.files_as_stream(spark, b, decided.schema), late="30 days"), out, at).awaitTermination()
    got = spark.read.parquet(out).filter("session_id >= 0")
    want = streams.with_decisions(left, decided)
    assert rows(got.select("event_id", "decision_id")) == rows(want.select("event_id", "decision_id"))
    assert got.filter("decision_id IS NULL").count() > 0 and got.filter("decision_id IS NOT NULL").count() > 0


def test_pairs_expire(spark, tmp_path):
    own = learned(spark, D).withColumn("learned_at", F.col("learned_at").cast("timestamp")).withColumn("at", F.struct("learned_at", "event_id"))
    # Four months between the first and the last.
    own = own.withColumn("learned_at", F.timestamp_add("DAY", (F.col("event_id") % 120).cast("int"), F.col("learned_at"))).withColumn("at", F.struct("learned_at", "event_id"))
    source, path, at = (str(tmp_path / x) for x in ("in", "table", "checkpoint"))
    merge.create(own.limit(0), path, ["nl_term", "symbol"], 4)
    seen = None
    for k in range(3):
        part = own.filter(F.col("event_id") % 3 == k)
        part.coalesce(1).write.mode("append").parquet(source)
        streams.keep_newest(streams.files_as_stream(spark, source, own.schema), path, at, "at").awaitTermination()
        seen = part if seen is None else seen.unionByName(part)
        newest = pairs.latest(seen, ["learned_at", "event_id"])
        now = newest.agg(F.max("learned_at").alias("now"))
        want = pairs.unexpired(newest.join(F.broadcast(now)), F.col("now"))
        assert rows(merge.Snapshot(spark, path).read().select("nl_term", "symbol", "event_id")) == rows(want.select("nl_term", "symbol", "event_id"))
        assert want.count() < newest.count()


def test_a_long_log_is_in_files_beside_each_other(spark, events, tmp_path, monkeypatch):
    """With many rows a stretch of a log is written by several tasks; sessions stay together and in order."""
    monkeypatch.setattr(streams, "FILE_ROWS", 100, raising=False)
    source, out, at = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    beside = streams.in_files(events, source, "ts", 2, "session_id")
    assert beside == -(-events.count() // 200)
    named = spark.read.parquet(source).withColumn("f", F.input_file_name())
    assert 2 < named.select("f").distinct().count() <= 2 * beside
    assert named.groupBy("session_id").agg(F.count_distinct("f").alias("n")).agg(F.max("n")).first()[0] <= 2
    reverted = F.col("outcome") == "partial"
    stream = streams.files_as_stream(spark, source, events.schema, beside)
    streams.to_files(streams.counted(stream, F.lit(False), F.lit(False), reverted, ORDER), out, at).awaitTermination()
    assert rows(spark.read.parquet(out).select("event_id", "reverts", "forced")) == rows(logs.revert_cap(events, reverted, ORDER).select("event_id", "reverts", "forced"))
