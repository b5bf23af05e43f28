"""One query per family of scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import scalar as S
from larkspur.operators.text import parse_labelled_lines
from larkspur.plans.registry import query


@query("string_funcs", """
    SELECT c_custkey, lower(c_mktsegment) AS segment, contains(c_mktsegment, 'MACH') AS is_machinery, replace(c_name, '#', ' no. ') AS name,
           concat(c_mktsegment, '/', c_nationkey::varchar) AS label, printf('%s (%d)', c_name, c_nationkey) AS text,
           array_to_string([c_name, lower(c_mktsegment)], ', ') AS joined FROM customer""")
def string_funcs(t):
    segment = F.col("c_mktsegment")
    return t.customer.select(
        "c_custkey", F.lower(segment).alias("segment"), F.contains(segment, F.lit("MACH")).alias("is_machinery"),
        F.replace(F.col("c_name"), F.lit("#"), F.lit(" no. ")).alias("name"),
        F.concat(segment, F.lit("/"), F.col("c_nationkey").cast("string")).alias("label"),
        F.format_string("%s (%d)", "c_name", "c_nationkey").alias("text"),
        F.array_join(F.array("c_name", F.lower(segment)), ", ").alias("joined"),
    )


@query("regex_extract", r"""
    WITH e AS (SELECT event_id, strftime(ts, '%a %b %d %Y %H:%M:%S') || ' GMT+0100 (Central European Standard Time)' AS js, props FROM events)
    SELECT event_id, regexp_extract(props, '([0-9]+)', 1)::int AS first_digits, regexp_extract(js, '([A-Z][a-z]{2} [0-9]{2} [0-9]{4})', 1) AS month_day_year FROM e""")
def regex_extract(t):
    js = F.concat(F.date_format("ts", "EEE MMM dd yyyy HH:mm:ss"), F.lit(" GMT+0100 (Central European Standard Time)"))
    return t.events.select(
        "event_id", F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("first_digits"),
        F.regexp_extract(js, r"([A-Z][a-z]{2} [0-9]{2} [0-9]{4})", 1).alias("month_day_year"),
    )


@query("parse_format_date", """
    SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m') AS month, year(o_orderdate)::int AS year,
           strftime(o_orderdate, '%b') AS month_name, strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS week FROM orders""")
def parse_format_date(t):
    written = F.date_format("o_orderdate", "MMM d yyyy")
    day = F.to_date(written, "MMM d yyyy")
    return t.orders.select("o_orderkey", day.alias("d")).select(
        "o_orderkey", F.date_format("d", "yyyy-MM-dd").alias("day"), F.date_format("d", "yyyy-MM").alias("month"),
        F.year("d").alias("year"), F.date_format("d", "MMM").alias("month_name"),
        F.date_format(F.date_trunc("week", "d"), "yyyy-MM-dd").alias("week"),
    )


@query("math_funcs", """
    SELECT l_orderkey, l_linenumber, l_quantity, round(ln(l_extendedprice), 6) AS log_price, round(sqrt(l_extendedprice), 6) AS root_price,
           round(pow(1 - l_discount, 3), 6) AS kept, floor(l_extendedprice / 1000)::bigint AS thousands, (l_orderkey // 7)::bigint AS whole,
           round(l_extendedprice * l_tax, 4) + 0.0 AS tax FROM lineitem""")
def math_funcs(t):
    price = F.col("l_extendedprice")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_quantity", F.round(F.ln(price), 6).alias("log_price"), F.round(F.sqrt(price), 6).alias("root_price"),
        F.round(F.pow(1 - F.col("l_discount"), F.lit(3.0)), 6).alias("kept"), F.floor(price / 1000).alias("thousands"),
        F.expr("l_orderkey div 7").alias("whole"),
        S.rounded(price * F.col("l_tax"), 4).alias("tax"),
    )


@query("array_funcs", """
    WITH p AS (SELECT p_partkey, list_concat(string_split(p_name, ' '), [lower(p_type)]) AS tags FROM part)
    SELECT p_partkey, array_to_string(list_filter(tags, lambda x: x IN ('red', 'blue', 'ring', 'gear', 'economy')), ',') AS allowed,
           array_to_string(list_transform(tags, lambda x: upper(x)), ',') AS loud,
           array_to_string(list_transform(list_zip(tags, ['a', 'b', 'c']), lambda z: z[1] || '=' || z[2]), ',') AS zipped FROM p""")
def array_funcs(t):
    tags = F.concat(F.split("p_name", " "), F.array(F.lower("p_type")))
    keys = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    return t.part.select("p_partkey", tags.alias("tags"), keys.alias("keys")).select(
        "p_partkey",
        F.array_join(F.filter("tags", lambda x: x.isin("red", "blue", "ring", "gear", "economy")), ",").alias("allowed"),
        F.array_join(F.transform("tags", F.upper), ",").alias("loud"),
        F.array_join(F.transform(F.arrays_zip("tags", "keys"), lambda z: F.concat_ws("=", z["tags"], z["keys"])), ",").alias("zipped"),
    )


@query("json_funcs", """
    SELECT event_id, (props->>'$.k')::int AS k, '{"id":' || event_id::varchar || ',"type":"' || event_type || '"}' AS record,
           (props->>'$.k')::int + 1 AS next_k FROM events""")
def json_funcs(t):
    parsed = F.from_json("props", "k INT")
    return t.events.select(
        "event_id", parsed["k"].alias("k"),
        F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("record"),
        (F.try_variant_get(F.try_parse_json(F.col("props")), "$.k", "int") + 1).alias("next_k"),
    )


@query("tokenize_words", r"""
    WITH k AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9\s]')) AS token FROM documents)
    SELECT token, count(*) AS n FROM k GROUP BY token""")
def tokenize_words(t):
    return t.spread("documents", "doc_id").select(F.explode(S.split_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("parse_labelled_lines", """
    WITH p AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS colour, split_part(p_name, ' ', 2) AS thing, p_brand, p_type FROM part)
    SELECT p_partkey, 'COLOUR' AS label, colour AS entity FROM p UNION ALL SELECT p_partkey, 'THING', thing FROM p
    UNION ALL SELECT p_partkey, 'THING', p_brand FROM p UNION ALL SELECT p_partkey, 'KIND', p_type FROM p""")
def parse_labelled_lines_query(t):
    name = F.split("p_name", " ")
    answer = F.concat(
        F.lit("COLOUR: "), name[0], F.lit("\nTHING: "), name[1], F.lit(", "), F.col("p_brand"), F.lit("\nKIND: "), F.col("p_type")
    )
    return parse_labelled_lines(t.part.select("p_partkey", answer.alias("answer")), "answer").drop("answer")


@query("vector_distance", """
    SELECT a.vec_id, round(list_distance(a.embedding::double[], b.embedding::double[]), 5) AS l2,
           round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 5) + 0.0 AS cosine
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def vector_distance(t):
    following = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return t.embeddings.join(following, "vec_id").select(
        "vec_id", F.round(S.l2_distance(F.col("embedding"), F.col("other")), 5).alias("l2"),
        S.rounded(S.cosine_similarity(F.col("embedding"), F.col("other")), 5).alias("cosine"),
    )


@query("type_casts", r"""
    WITH x AS (SELECT event_id, value, CASE WHEN value > 20 THEN regexp_extract(props, '([0-9]+)', 1) ELSE event_type END AS raw FROM events)
    SELECT event_id, (value > 20)::int AS flag, round(value::varchar::double, 4) AS number, event_id::varchar AS id_text,
           coalesce(try_cast(raw AS INTEGER), 0) AS as_int, try_cast(raw AS INTEGER) IS NULL AS failed FROM x""")
def type_casts(t):
    raw = F.when(F.col("value") > 20, F.regexp_extract("props", "([0-9]+)", 1)).otherwise(F.col("event_type"))
    as_int = raw.try_cast("int")
    return t.events.select(
        "event_id", (F.col("value") > 20).cast("int").alias("flag"),
        F.round(F.col("value").cast("string").cast("double"), 4).alias("number"), F.col("event_id").cast("string").alias("id_text"),
        F.coalesce(as_int, F.lit(0)).alias("as_int"), as_int.isNull().alias("failed"),
    )
