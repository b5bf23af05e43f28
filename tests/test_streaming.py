"""Replayed files: high-water marks, repeated batches, late rows, duplicates."""

import datetime as dt

from pyspark.sql import functions as F

from larkspur.session import work_path
from larkspur.streaming.collector import Collector
from larkspur.streaming.monitor import append_to, dedupe, windowed_mentions

DDL = "id LONG, term STRING, ts TIMESTAMP"
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def event(i, term, minutes):
    return (i, term, START + dt.timedelta(minutes=minutes))


def put(spark, folder, rows):
    spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema(DDL).parquet(folder)


def test_collector_takes_only_newer_rows(spark):
    source, collector = work_path(spark, "in"), Collector(work_path(spark, "out"), "term", "id", "ts")
    put(spark, source, [event(1, "a", 0), event(2, "b", 1), event(3, "a", 2)])
    collector.start(stream(spark, source), availableNow=True).awaitTermination()
    put(spark, source, [event(3, "a", 2), event(4, "a", 5), event(1, "c", 6)])
    collector.start(stream(spark, source), availableNow=True).awaitTermination()
    state = {r["term"]: (r["since_id"], r["collected"]) for r in collector.state(spark).collect()}
    assert state == {"a": (4, 3), "b": (2, 1), "c": (1, 1)}
    assert sorted((r["id"], r["term"]) for r in collector.rows(spark).collect()) == [(1, "a"), (1, "c"), (2, "b"), (3, "a"), (4, "a")]


def test_repeated_batch_changes_nothing(spark):
    collector = Collector(work_path(spark, "out"), "term", "id", "ts")
    first = spark.createDataFrame([event(1, "a", 0)], DDL)
    second = spark.createDataFrame([event(1, "a", 0), event(2, "a", 1)], DDL)
    collector.collect_batch(first, 0)
    collector.collect_batch(second, 1)
    before = collector.state(spark).collect()
    collector.collect_batch(second, 1)
    assert collector.state(spark).collect() == before
    assert before[0]["since_id"] == 2 and collector.rows(spark).count() == 2


def test_empty_batch_keeps_state(spark):
    collector = Collector(work_path(spark, "out"), "term", "id", "ts")
    collector.collect_batch(spark.createDataFrame([event(5, "a", 0)], DDL), 0)
    collector.collect_batch(spark.createDataFrame([], DDL), 1)
    assert [(r["term"], r["since_id"]) for r in collector.state(spark).collect()] == [("a", 5)]


def test_late_rows_are_dropped_and_final_windows_match_batch(spark):
    source, folder = work_path(spark, "in"), work_path(spark, "out")
    on_time = [event(i, "a", 10 * i) for i in range(30)]
    put(spark, source, on_time)
    append_to(windowed_mentions(stream(spark, source), "ts", "term"), folder, availableNow=True).awaitTermination()
    put(spark, source, [event(100, "a", 0), event(101, "a", 600)])
    append_to(windowed_mentions(stream(spark, source), "ts", "term"), folder, availableNow=True).awaitTermination()
    got = spark.read.parquet(f"{folder}/rows")
    batch = spark.createDataFrame(on_time, DDL).groupBy(F.window("ts", "15 minutes").alias("w"), "term").agg(F.count("*").alias("n"))
    want = {(r["w"]["start"], r["n"]) for r in batch.collect()}
    assert {(r["window_start"], r["n"]) for r in got.collect()} == want


def test_duplicates_within_the_delay(spark):
    source, folder = work_path(spark, "in"), work_path(spark, "out")
    put(spark, source, [event(1, "a", 0), event(2, "a", 10)])
    append_to(dedupe(stream(spark, source), "ts", "id"), folder, availableNow=True).awaitTermination()
    put(spark, source, [event(2, "a", 10), event(3, "a", 20)])
    append_to(dedupe(stream(spark, source), "ts", "id"), folder, availableNow=True).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(f"{folder}/rows").collect()) == [1, 2, 3]
