"""Access to a folder of parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

#: Bytes of files up to which a table is dealt anew for work per row.
SMALL = 256 << 20


class Tables:
    """``Tables(spark, folder).orders`` is the lazily scanned ``folder/orders.parquet``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name not in NAMES:
            raise AttributeError(name)
        return self.spark.read.parquet(self.path(name))

    def spread(self, name: str, *keys: str) -> DataFrame:
        """The table for heavy work per row. A small table in fewer files than there are cores may be one row group, and so
        one task, whatever its number of partitions says; it is dealt to all cores. All others stay as they are."""
        table = getattr(self, name)
        cores = self.spark.sparkContext.defaultParallelism
        size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if len(table.inputFiles()) >= cores or size > SMALL:
            return table
        return table.repartition(cores, *keys)

    def stream(self, name: str, **options) -> DataFrame:
        """The same table as an unbounded file source. A stream wants a folder or a pattern, and the
        table may be one file, hence the one-letter pattern."""
        schema = getattr(self, name).schema
        return self.spark.readStream.schema(schema).options(**options).parquet(f"{self.folder}/{name}.parque[t]")
