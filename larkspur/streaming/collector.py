"""Incremental collection with one high-water mark per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from larkspur.sources.files import is_complete


class Collector:
    """Appends the rows of a stream that are not yet collected, each (key, id) once, and keeps the state:
    the largest id per key as ``since_id``.

    Files may come out of id order: a row counts as collected only when its id is among the collected
    rows, not when it is below the mark. Only rows with ids from the batch's smallest on are read for
    that, which for ids in order are none. Within a batch every id is expected once.

    ``folder`` (shared by all executors) holds ``rows/batch=N`` and ``state/batch=N``. A batch reads
    the state of the batch before it and overwrites its own folders, so a batch that is run again
    after a failure leaves the same result, and everything finished before a failure stays."""

    def __init__(self, folder: str, key: str, id_col: str, ts: str):
        self.folder, self.key, self.id_col, self.ts = folder, key, id_col, ts

    def state_path(self, batch_id: int) -> str:
        return f"{self.folder}/state/batch={batch_id}"

    def _state_before(self, spark, batch_id: int) -> DataFrame | None:
        if batch_id == 0:
            return None
        path = self.state_path(batch_id - 1)
        if not is_complete(spark, path):
            raise FileNotFoundError(f"the marks of batch {batch_id - 1} are missing: {path}")
        return spark.read.parquet(path)

    def collect_batch(self, batch: DataFrame, batch_id: int) -> None:
        spark, key = batch.sparkSession, self.key
        state = self._state_before(spark, batch_id)
        rows_path = f"{self.folder}/rows/batch={batch_id}"
        newer = batch
        if state is not None:
            low = batch.agg(F.min(self.id_col)).first()[0]
            known = spark.read.parquet(f"{self.folder}/rows").where((F.col("batch") < batch_id) & (F.col(self.id_col) >= F.lit(low)))
            known = known.select(F.col(key).alias("_key"), F.col(self.id_col).alias("_id"))
            newer = batch.join(known, (batch[self.id_col] == F.col("_id")) & batch[key].eqNullSafe(F.col("_key")), "left_anti")
        newer.write.mode("overwrite").parquet(rows_path)
        seen = spark.read.schema(batch.schema).parquet(rows_path).groupBy(key).agg(
            F.max(self.id_col).alias("since_id"), F.max(self.ts).alias("last_search"), F.count("*").alias("collected")
        )
        merged = seen if state is None else seen.unionByName(state)
        merged.groupBy(key).agg(
            F.max("since_id").alias("since_id"), F.max("last_search").alias("last_search"),
            F.sum("collected").alias("collected"),
        ).write.mode("overwrite").parquet(self.state_path(batch_id))

    def start(self, stream: DataFrame, **trigger) -> StreamingQuery:
        """Start collecting; ``trigger`` is e.g. ``availableNow=True`` or ``processingTime='15 minutes'``."""
        return (
            stream.writeStream.foreachBatch(self.collect_batch)
            .option("checkpointLocation", f"{self.folder}/checkpoint")
            .trigger(**(trigger or {"processingTime": "15 minutes"}))
            .start()
        )

    def state(self, spark) -> DataFrame:
        """The newest finished state: one row per key."""
        batches = [r.batch for r in spark.read.parquet(f"{self.folder}/state").select("batch").distinct().collect()]
        newest = next(b for b in sorted(batches, reverse=True) if is_complete(spark, self.state_path(b)))
        return spark.read.parquet(self.state_path(newest))

    def rows(self, spark) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/rows").drop("batch")
