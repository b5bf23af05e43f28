"""Windowed counts and duplicate removal on streams."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_mentions(stream: DataFrame, ts: str, term: str, late: str = "1 hour", every: str = "15 minutes") -> DataFrame:
    """Mentions per term and window. Rows later than ``late`` behind the newest are dropped; a window
    is final once the watermark passes its end."""
    return (
        stream.withColumn(ts, F.col(ts).cast("timestamp"))
        .withWatermark(ts, late)
        .groupBy(F.window(ts, every).alias("w"), term)
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), term, "n")
    )


def dedupe(stream: DataFrame, ts: str, *ids: str, late: str = "1 hour") -> DataFrame:
    """First row per id; repeats are recognised while they are within the watermark delay."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(list(ids))


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_on_disk(spark: SparkSession):
    """Streams that start here keep their state in RocksDB, off the heap: it may outgrow the memory of an executor."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def open_windows(spark: SparkSession, folder: str, term: str) -> DataFrame:
    """The counts of windows that the stream of :func:`windowed_mentions` has not reported yet (window_start, window_end, term, n), read
    from the state it keeps beside ``folder``/rows. Together with the reported ones these are all windows; on the next run of
    the stream the counts go on."""
    kept = spark.read.format("statestore").option("path", f"{folder}/checkpoint").load()
    return kept.select(
        F.col("key")["window"]["start"].alias("window_start"), F.col("key")["window"]["end"].alias("window_end"), F.col("key")[term].alias(term), F.col("value")["count"].alias("n"))


def all_windows(spark: SparkSession, folder: str, term: str) -> DataFrame:
    """Reported windows and open ones: window_start, window_end, term, n, final. After every run of the stream, those whose end the
    watermark has not passed are shown as they stand."""
    columns = ["window_start", "window_end", term, "n"]
    done = spark.read.schema(f"window_start timestamp, window_end timestamp, {term} string, n long").parquet(f"{folder}/rows")
    return done.select(*columns, F.lit(True).alias("final")).unionByName(open_windows(spark, folder, term).select(*columns, F.lit(False).alias("final")))


def append_to(stream: DataFrame, folder: str, **trigger) -> StreamingQuery:
    """Exactly-once parquet sink at ``folder``/rows with its checkpoint beside it."""
    return (
        stream.writeStream.outputMode("append").format("parquet")
        .option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(**trigger)
        .start()
    )
