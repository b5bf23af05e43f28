"""Sources and sinks."""

import json

from pyspark.sql import functions as F

from larkspur.session import shared_root, work_path
from larkspur.sources import files


def test_typed_csv_tolerates_bad_cells(spark, tmp_path):
    (tmp_path / "y.csv").write_text("id,grams,name\n1,50,Wool\n2,NA,NA\n3,heavy,Silk\n")
    rows = files.read_csv_typed(spark, str(tmp_path), "id INT, grams INT, name STRING").orderBy("id").collect()
    assert [(r["id"], r["grams"], r["name"]) for r in rows] == [(1, 50, "Wool"), (2, None, None), (3, None, "Silk")]
    assert [r["_corrupt_record"] is not None for r in rows] == [False, False, True]


def test_json_array(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "t": "x"}, {"id": 2, "t": "é"}]))
    rows = files.read_json_records(spark, str(tmp_path), "id LONG, t STRING", array=True).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, "x"), (2, "é")]


def test_materialize_if_absent_ignores_half_written_results(spark):
    path = work_path(spark, "t")
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    spark.range(7).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    assert files.materialize_if_absent(spark, path, build).count() == 3
    assert files.materialize_if_absent(spark, path, build).count() == 3
    assert len(built) == 1


def test_sink_by_key_time_replaces_spaces(spark):
    path = work_path(spark, "t")
    df = spark.createDataFrame([(1, "big news", "2024-01-01"), (2, "x", "2024-01-02")], "id INT, k STRING, r STRING")
    files.sink_by_key_time(df, "k", "r", path)
    got = spark.read.json(path).select("term", F.col("run_ts").cast("string")).collect()
    assert {tuple(r) for r in got} == {("big_news", "2024-01-01"), ("x", "2024-01-02")}


def test_shared_root_is_the_checkpoint_folder(spark):
    assert shared_root(spark)
    assert work_path(spark, "a") != work_path(spark, "a")
