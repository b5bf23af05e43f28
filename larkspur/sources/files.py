"""Readers and writers for CSV, JSON and parquet."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").csv(path, header=True)


def read_csv_infer(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV with inferred types. Inference is one more pass; prefer ``read_csv_typed``."""
    return spark.read.csv(path, header=True, inferSchema=True)


def read_csv_typed(spark: SparkSession, path: str, ddl: str, null_value: str = "NA") -> DataFrame:
    """CSV under a fixed schema. ``null_value`` reads as null; a cell that does not parse reads as
    null too, and the whole line is kept in ``_corrupt_record``."""
    schema = T.StructType.fromDDL(ddl).add("_corrupt_record", T.StringType())
    return (
        spark.read.schema(schema)
        .option("nullValue", null_value)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .csv(path, header=True)
    )


def write_json_lines(df: DataFrame, path: str, compression: str | None = None) -> None:
    """JSON Lines: one record per line keeps the file splittable, unlike one big array."""
    df.write.option("compression", compression or "none").json(path)


def read_json_records(spark: SparkSession, path: str, ddl: str, array: bool = False) -> DataFrame:
    """JSON Lines, or (``array=True``) files that each hold one JSON array of records."""
    return spark.read.schema(ddl).option("multiLine", array).json(path)


def inline_table(spark: SparkSession, rows: Iterable[tuple], ddl: str) -> DataFrame:
    return spark.createDataFrame(list(rows), ddl)


def create_table_as(spark: SparkSession, name: str, df: DataFrame, casts: dict[str, str], path: str) -> DataFrame:
    """CREATE TABLE ... AS SELECT with one explicit cast per column, stored at ``path``."""
    view = f"{name}_source"
    df.createOrReplaceTempView(view)
    columns = ", ".join(f"CAST(`{c}` AS {t}) AS `{c}`" for c, t in casts.items())
    spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{path}' AS SELECT {columns} FROM {view}")
    spark.catalog.dropTempView(view)
    return spark.table(name)


def is_complete(spark: SparkSession, path: str) -> bool:
    """True when a finished job left its ``_SUCCESS`` marker; a half-written folder does not count."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def materialize_if_absent(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read the saved result at ``path``; compute and save it first when it is missing."""
    if not is_complete(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def sink_by_key_time(df: DataFrame, key: str, run_time: str, path: str) -> None:
    """One folder per (key, run time); spaces in keys become underscores. A hot key still spreads
    over as many files as it has input partitions, because nothing is shuffled to one writer."""
    safe = F.replace(F.col(key), F.lit(" "), F.lit("_"))
    out = df.withColumn("term", safe).withColumn("run_ts", F.col(run_time))
    out.write.partitionBy("term", "run_ts").json(path)
