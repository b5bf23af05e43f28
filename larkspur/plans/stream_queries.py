"""Streaming queries: the whole events table runs through a file stream, results are read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.plans.registry import query
from larkspur.session import work_path
from larkspur.streaming.collector import Collector
from larkspur.streaming.monitor import all_windows, append_to, dedupe, state_on_disk, windowed_mentions


def stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def run_collector(t) -> Collector:
    collector = Collector(work_path(t.spark, "collector"), "event_type", "event_id", "ts")
    collector.start(t.stream("events"), availableNow=True).awaitTermination()
    return collector


@query("incremental_since_id", "SELECT event_type, max(event_id) AS since_id FROM events GROUP BY event_type")
def incremental_since_id(t):
    return run_collector(t).state(t.spark).select("event_type", "since_id")


@query("state_upsert", """
    SELECT event_type, max(event_id) AS since_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_search FROM events GROUP BY event_type""")
def state_upsert(t):
    return run_collector(t).state(t.spark).select("event_type", "since_id", stamp("last_search").alias("last_search"))


@query("trigger_15min", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def trigger_15min(t):
    """The first run of a 15-minute schedule takes all that is there; then the schedule is stopped."""
    collector = Collector(work_path(t.spark, "scheduled"), "event_type", "event_id", "ts")
    schedule = collector.start(t.stream("events"), processingTime="15 minutes")
    try:
        while not schedule.recentProgress and schedule.isActive:
            schedule.awaitTermination(1)
        if schedule.exception():
            raise schedule.exception()
    finally:
        schedule.stop()
    return collector.rows(t.spark).groupBy("event_type").agg(F.count("*").alias("n"))


@query("windowed_mentions", """
    WITH w AS (SELECT time_bucket(INTERVAL 15 MINUTES, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY ALL)
    SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, n,
           start + INTERVAL 15 MINUTES <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR AS final FROM w""")
def windowed_mentions_query(t):
    """Every window of the stream: those that are final, i.e. end no later than one hour before the newest event, and those still
    open as they stand."""
    folder = work_path(t.spark, "mentions")
    with state_on_disk(t.spark):
        append_to(windowed_mentions(t.stream("events"), "ts", "event_type"), folder, availableNow=True).awaitTermination()
    done = all_windows(t.spark, folder, "event_type")
    return done.select(stamp("window_start").alias("window_start"), "event_type", "n", "final")


@query("dedupe_stream", "SELECT event_type, count(*) AS n, sum(event_id)::bigint AS id_sum FROM events GROUP BY event_type")
def dedupe_stream(t):
    """Two overlapping pulls of the same events leave every event once."""
    folder = work_path(t.spark, "dedupe")
    both = t.stream("events").union(t.stream("events"))
    with state_on_disk(t.spark):
        append_to(dedupe(both, "ts", "event_id"), folder, availableNow=True).awaitTermination()
    return t.spark.read.parquet(f"{folder}/rows").groupBy("event_type").agg(
        F.count("*").alias("n"), F.sum("event_id").alias("id_sum")
    )
