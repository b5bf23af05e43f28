"""Sources and sinks: every query writes a whole table to the shared folder and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from larkspur.functions.scalar import seeded_score
from larkspur.operators.text import page_metadata
from larkspur.plans.registry import query
from larkspur.session import work_path
from larkspur.sources import files


@query("scan_csv_infer", """
    SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def scan_csv_infer(t):
    path = work_path(t.spark, "csv")
    files.write_csv(t.customer, path)
    return files.read_csv_infer(t.spark, path).select(
        F.col("c_custkey").cast("long"), "c_name", F.col("c_nationkey").cast("int"), "c_acctbal", "c_mktsegment"
    )


@query("scan_csv_typed", """
    WITH s AS (SELECT *, ('0x' || substr(md5(concat('na|', cast(p_partkey AS VARCHAR))), 1, 4))::int AS s FROM part)
    SELECT p_partkey,
           CASE WHEN s % 10 = 0 THEN NULL ELSE p_size END AS p_size,
           CASE WHEN s % 17 = 0 THEN NULL ELSE p_retailprice END AS p_retailprice,
           s % 17 = 0 AS bad_cell
    FROM s""")
def scan_csv_typed(t):
    path = work_path(t.spark, "csv-typed")
    score = seeded_score("na", "p_partkey")
    raw = t.part.select(
        "p_partkey",
        F.when(score % 10 == 0, "NA").otherwise(F.col("p_size").cast("string")).alias("p_size"),
        F.when(score % 17 == 0, "oops").otherwise(F.col("p_retailprice").cast("string")).alias("p_retailprice"),
    )
    files.write_csv(raw, path)
    typed = files.read_csv_typed(t.spark, path, "p_partkey LONG, p_size INT, p_retailprice DOUBLE")
    return typed.select("p_partkey", "p_size", "p_retailprice", F.col("_corrupt_record").isNotNull().alias("bad_cell"))


@query("scan_parquet", """
    SELECT o_orderstatus, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total
    FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY o_orderstatus""")
def scan_parquet(t):
    path = work_path(t.spark, "parquet")
    t.orders.write.partitionBy("o_orderstatus").parquet(path)
    return (
        t.spark.read.parquet(path)
        .where(F.col("o_orderdate") >= F.to_timestamp_ntz(F.lit("1996-01-01 00:00:00")))
        .groupBy("o_orderstatus")
        .agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    )


@query("json_array_io", "SELECT conv_id, turn, role, text FROM conversations")
def json_array_io(t):
    path = work_path(t.spark, "json")
    files.write_json_lines(t.conversations, path)
    return files.read_json_records(t.spark, path, "conv_id LONG, turn LONG, role STRING, text STRING")


@query("inline_table", """
    WITH w(o_orderpriority, weight, urgent) AS (VALUES
        ('1-URGENT', 5, true), ('2-HIGH', 4, true), ('3-MEDIUM', 3, false), ('4-NOT SPECIFIED', 2, false), ('5-LOW', 1, false))
    SELECT o_orderpriority, urgent, count(*) AS n_orders, sum(weight)::bigint AS total_weight
    FROM orders JOIN w USING (o_orderpriority) GROUP BY ALL""")
def inline_table(t):
    weights = files.inline_table(
        t.spark,
        [("1-URGENT", 5, True), ("2-HIGH", 4, True), ("3-MEDIUM", 3, False), ("4-NOT SPECIFIED", 2, False), ("5-LOW", 1, False)],
        "o_orderpriority STRING, weight INT, urgent BOOLEAN",
    )
    counts = t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n_orders"))
    return counts.join(F.broadcast(weights), "o_orderpriority").select(
        "o_orderpriority", "urgent", "n_orders", (F.col("weight") * F.col("n_orders")).alias("total_weight")
    )


@query("ctas_cast", """
    SELECT cast(event_id AS BIGINT) AS event_id, strftime(cast(ts AS DATE), '%Y-%m-%d') AS day,
           cast(user_id AS VARCHAR) AS user_id, cast(value AS FLOAT)::DOUBLE AS value
    FROM events""")
def ctas_cast(t):
    name = f"typed_events_{uuid.uuid4().hex}"
    made = files.create_table_as(
        t.spark, name, t.events,
        {"event_id": "BIGINT", "ts": "DATE", "user_id": "STRING", "value": "FLOAT"}, work_path(t.spark, "ctas"),
    )
    t.spark.sql(f"DROP TABLE {name}")  # the name only: the rows lie outside the warehouse and are read below
    return made.select(
        "event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "user_id", F.col("value").cast("double").alias("value")
    )


@query("materialize_if_absent", """
    SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey""")
def materialize_if_absent(t):
    path = work_path(t.spark, "saved")

    def build():
        return t.orders.groupBy("o_custkey").agg(
            F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total")
        )

    files.materialize_if_absent(t.spark, path, build)
    return files.materialize_if_absent(t.spark, path, build)


@query("sink_by_key_time", """
    SELECT 'type_' || event_type AS term, strftime(ts, '%Y-%m-%d') AS run_ts, count(*) AS n, sum(event_id)::bigint AS id_sum
    FROM events GROUP BY ALL""")
def sink_by_key_time(t):
    path = work_path(t.spark, "by-key")
    events = t.events.select(
        "event_id", F.concat(F.lit("type "), "event_type").alias("key"), F.date_format("ts", "yyyy-MM-dd").alias("run")
    )
    files.sink_by_key_time(events, "key", "run", path)
    back = t.spark.read.schema("event_id LONG, key STRING, run STRING, term STRING, run_ts STRING").json(path)
    return back.groupBy("term", "run_ts").agg(F.count("*").alias("n"), F.sum("event_id").alias("id_sum"))


@query("page_metadata", r"""
    SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
           regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
           regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host
    FROM pages""")
def page_metadata_query(t):
    return page_metadata(t.pages).select("page_id", "title", "lang", "host")


@query("compressed_json_sink", """
    SELECT event_type, count(*) AS n, sum(event_id)::bigint AS id_sum FROM events GROUP BY event_type""")
def compressed_json_sink(t):
    path = work_path(t.spark, "gz")
    files.write_json_lines(t.events, path, compression="gzip")
    back = files.read_json_records(t.spark, path, "event_id LONG, event_type STRING")
    return back.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("id_sum"))
