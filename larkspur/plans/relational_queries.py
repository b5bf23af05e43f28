"""Projection, filter, join, sort, set and reshape queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import scalar as S
from larkspur.operators import relational as R
from larkspur.operators.text import split_overlap
from larkspur.plans.registry import query
from larkspur.plans.sqltext import score, shuffle, tokens, words
from larkspur.sources.files import inline_table


# ---- projection and filter -------------------------------------------------------------------


@query("filter_conj_notnull", """
    SELECT o_orderkey, o_totalprice FROM orders
    WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND o_totalprice IS NOT NULL""")
def filter_conj_notnull(t):
    return t.orders.where(
        (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT") & F.col("o_totalprice").isNotNull()
    ).select("o_orderkey", "o_totalprice")


@query("clip_lower", """
    SELECT l_orderkey, l_linenumber, greatest(date_diff('day', o_orderdate, l_shipdate), 0)::int AS delay_days
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def clip_lower(t):
    delay = F.datediff("l_shipdate", "o_orderdate")
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_linenumber", S.clip_lower(delay).alias("delay_days")
    )


@query("select_rename", """
    SELECT p_partkey AS "P Partkey", p_brand AS "P Brand", p_type AS "Kind" FROM part""")
def select_rename(t):
    return (
        R.title_case_names(t.part).withColumnsRenamed({"P Type": "Kind"}).drop("P Name", "P Size", "P Retailprice")
    )


@query("case_when_bucket", """
    WITH b AS (SELECT event_type, hour(ts) AS h FROM events)
    SELECT event_type, CASE WHEN h >= 22 OR h < 6 THEN 'Night' WHEN h >= 6 AND h < 12 THEN 'Morning'
        WHEN h >= 12 AND h < 18 THEN 'Afternoon' ELSE 'Evening' END AS daytime, count(*) AS n
    FROM b GROUP BY ALL""")
def case_when_bucket(t):
    return t.events.groupBy("event_type", S.daytime(F.hour("ts")).alias("daytime")).agg(F.count("*").alias("n"))


@query("conditional_label", """
    SELECT c_custkey, CASE WHEN contains(c_mktsegment, 'MACH') THEN 'Industry' ELSE 'Other' END AS sector,
           CASE WHEN c_acctbal < 0 THEN 'owes' ELSE concat_ws(' + ', 'has', cast(c_nationkey AS VARCHAR)) END AS note
    FROM customer""")
def conditional_label(t):
    return t.customer.select(
        "c_custkey",
        F.when(F.contains("c_mktsegment", F.lit("MACH")), "Industry").otherwise("Other").alias("sector"),
        F.when(F.col("c_acctbal") < 0, "owes")
        .otherwise(F.concat_ws(" + ", F.lit("has"), F.col("c_nationkey").cast("string"))).alias("note"),
    )


@query("derive_price_cols", """
    SELECT p_partkey, p_brand || '-' || p_name AS id, round(p_retailprice / 1000 * 1000, 2) AS price_1m,
           round((p_retailprice + p_size) / 2, 2) AS avg_price,
           cast(trunc(p_retailprice / 100) AS SMALLINT)::varchar || 'k' AS size_label
    FROM part""")
def derive_price_cols(t):
    per_thousand = F.col("p_retailprice") / 1000
    derived = t.part.select(
        "p_partkey",
        F.concat_ws("-", "p_brand", "p_name").alias("id"),
        (per_thousand * 1000).alias("price_1m"),
        ((F.col("p_retailprice") + F.col("p_size")) / 2).alias("avg_price"),
        F.concat((F.col("p_retailprice") / 100).cast("smallint").cast("string"), F.lit("k")).alias("size_label"),
    )
    return R.round_floats(derived, 2).orderBy("avg_price", "p_partkey")


@query("drop_any_null", """
    SELECT d.doc_id, lang, quality FROM documents d JOIN labels l USING (doc_id) WHERE quality IS NOT NULL""")
def drop_any_null(t):
    joined = t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return R.complete_cases(joined)


CUSTOMER_FIELDS = {"c_custkey": "number", "c_nationkey": "number", "c_name": "text", "c_mktsegment": "text"}


@query("search_by_field", """
    SELECT 'nation' AS search, c_custkey, c_name FROM customer WHERE c_nationkey = 7
    UNION ALL SELECT 'segment', c_custkey, c_name FROM customer WHERE lower(c_mktsegment) = lower('Building')""")
def search_by_field(t):
    nation = R.search_by_field(t.customer, CUSTOMER_FIELDS, "c_nationkey", "7")
    segment = R.search_by_field(t.customer, CUSTOMER_FIELDS, "c_mktsegment", "Building")
    return nation.select(F.lit("nation").alias("search"), "c_custkey", "c_name").unionByName(
        segment.select(F.lit("segment").alias("search"), "c_custkey", "c_name")
    )


@query("lang_keyword_filter", """
    SELECT doc_id, source FROM documents WHERE lang = 'en' AND contains(lower(text), 'erth')""")
def lang_keyword_filter(t):
    return R.keyword_filter(t.documents, "text", "lang", "erth").select("doc_id", "source")


# ---- joins -----------------------------------------------------------------------------------


@query("left_join_dim", """
    SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey
    LEFT JOIN nation ON c_nationkey = n_nationkey""")
def left_join_dim(t):
    return (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select("o_orderkey", "c_name", "n_name")
    )


@query("inner_join_meta", """
    SELECT s_suppkey, s_name, n_name, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def inner_join_meta(t):
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", "s_name", "n_name", "s_acctbal"
    )


GRID = {"status": ["F", "O", "P"], "min_price": [0, 100000, 200000, 300000], "urgent_only": [True, False]}


@query("param_grid", """
    SELECT status, min_price, urgent_only, count(o_orderkey) AS n_orders
    FROM (VALUES ('F'), ('O'), ('P')) s(status), (VALUES (0), (100000), (200000), (300000)) m(min_price),
         (VALUES (true), (false)) u(urgent_only)
    LEFT JOIN orders ON o_orderstatus = status AND o_totalprice >= min_price
        AND (NOT urgent_only OR o_orderpriority = '1-URGENT')
    GROUP BY ALL""")
def param_grid(t):
    """Every cell of the grid evaluated in one pass: orders are counted per status, price band and
    urgency, and the grid joins those few counts by status."""
    band = F.floor(F.greatest(F.col("o_totalprice"), F.lit(0)) / 100000)
    counts = t.orders.groupBy(
        F.col("o_orderstatus").alias("status"), F.least(band, F.lit(3)).alias("band"),
        (F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
    ).agg(F.count("*").alias("n"))
    fits = (F.col("band") * 100000 >= F.col("min_price")) & (~F.col("urgent_only") | F.col("urgent"))
    return (
        R.param_grid(t.spark, **GRID)
        .join(counts, "status", "left")
        .groupBy("status", "min_price", "urgent_only")
        .agg(F.coalesce(F.sum(F.when(fits, F.col("n"))), F.lit(0)).alias("n_orders"))
    )


@query("all_pairs_tournament", """
    WITH b AS (SELECT DISTINCT p_brand FROM part)
    SELECT x.p_brand AS competitor_1, y.p_brand AS competitor_2, attribute
    FROM b x JOIN b y ON x.p_brand <> y.p_brand, (VALUES ('price'), ('size')) a(attribute)""")
def all_pairs_tournament(t):
    return R.all_pairs(t.part, "p_brand", ["price", "size"])


@query("anti_join_done", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_done(t):
    return R.not_done(t.documents.select("doc_id", "lang"), t.labels, "doc_id")


@query("semi_join_selected", """
    SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'hidden' ELSE source END AS source
    FROM documents""")
def semi_join_selected(t):
    toxic = t.labels.where(F.col("toxic") == 1)
    return R.change_selected(t.documents.select("doc_id", "source"), toxic, "doc_id", "source", F.lit("hidden"))


@query("fk_violations", """
    SELECT 'lineitem.order' AS rule, l_orderkey AS missing_key, count(*) AS n_rows FROM lineitem
    WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY ALL
    UNION ALL SELECT 'lineitem.part', l_partkey, count(*) FROM lineitem
    WHERE l_partkey NOT IN (SELECT p_partkey FROM part) GROUP BY ALL
    UNION ALL SELECT 'document.label', doc_id, count(*) FROM documents
    WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY ALL""")
def fk_violations(t):
    rules = [
        ("lineitem.order", t.lineitem, "l_orderkey", t.orders, "o_orderkey"),
        ("lineitem.part", t.lineitem, "l_partkey", t.part, "p_partkey"),
        ("document.label", t.documents, "doc_id", t.labels, "doc_id"),
    ]
    parts = [
        R.foreign_key_violations(child, key, parent, pkey).select(F.lit(rule).alias("rule"), "missing_key", "n_rows")
        for rule, child, key, parent, pkey in rules
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("split_overlap", f"""
    WITH d AS (SELECT doc_id, {words('text')} AS w FROM documents),
    b AS (SELECT {words('text')} AS w FROM benchmark),
    bg AS (SELECT DISTINCT unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' '))) AS g FROM b),
    dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' '))) AS g FROM d),
    s AS (SELECT doc_id, count(*) AS shared_ngrams FROM dg JOIN bg USING (g) GROUP BY doc_id),
    t AS (SELECT doc_id, len(w) > 0 AND array_to_string(w, ' ') IN (SELECT array_to_string(w, ' ') FROM b) AS same_text FROM d)
    SELECT doc_id, same_text, coalesce(shared_ngrams, 0) AS shared_ngrams FROM t LEFT JOIN s USING (doc_id) WHERE same_text OR shared_ngrams > 0""")
def split_overlap_query(t):
    return split_overlap(t.spread("documents", "doc_id"), "doc_id", "text", t.benchmark, "text", n=8)


@query("usage_x_price", f"""
    WITH p(role, usd_per_million) AS (VALUES ('system', 5.0::double), ('user', 10.0), ('assistant', 30.0))
    SELECT conv_id, sum(tok)::bigint AS tokens, coalesce(round(sum(tok * usd_per_million / 1e6::double), 6), 0.0) AS cost,
           coalesce(sum(tok) FILTER (usd_per_million IS NULL), 0)::bigint AS unpriced_tokens
    FROM (SELECT conv_id, role, {tokens('text')} AS tok FROM conversations) LEFT JOIN p USING (role) GROUP BY conv_id""")
def usage_x_price(t):
    """Tokens of a role without a price are counted and shown, they cost nothing here."""
    prices = inline_table(
        t.spark, [("system", 5.0), ("user", 10.0), ("assistant", 30.0)], "role STRING, usd_per_million DOUBLE"
    )
    usage = t.conversations.select("conv_id", "role", S.estimated_tokens(F.col("text")).alias("tok"))
    return (
        usage.join(F.broadcast(prices), "role", "left")
        .groupBy("conv_id")
        .agg(
            F.sum("tok").alias("tokens"),
            F.coalesce(F.round(F.sum(F.col("tok") * F.col("usd_per_million") / 1e6), 6), F.lit(0.0)).alias("cost"),
            F.coalesce(F.sum(F.when(F.col("usd_per_million").isNull(), F.col("tok"))), F.lit(0)).alias("unpriced_tokens"),
        )
    )


@query("redirect_lookup", r"""
    SELECT page_id, regexp_replace(url, '[?#].*$', '') AS final_url FROM pages""")
def redirect_lookup(t):
    plain = F.regexp_replace("url", r"[?#].*$", "")
    redirects = t.pages.select(F.col("url").alias("source"), plain.alias("target")).where("source <> target").distinct()
    return R.redirect(t.pages.select("page_id", "url"), "url", redirects).select("page_id", "final_url")


# ---- sort, limit, top-k ----------------------------------------------------------------------


@query("sort_desc", "SELECT s_suppkey, s_name, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey")
def sort_desc(t):
    return t.supplier.select("s_suppkey", "s_name", "s_acctbal").orderBy(F.desc("s_acctbal"), "s_suppkey")


@query("head_n", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
def head_n(t):
    return t.events.groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(10)


@query("custom_category_order", """
    SELECT o_orderpriority, CASE o_orderpriority WHEN '3-MEDIUM' THEN 0 WHEN '1-URGENT' THEN 1 ELSE 2 END AS place,
           count(*) AS n FROM orders GROUP BY ALL ORDER BY place, o_orderpriority""")
def custom_category_order(t):
    place = F.when(F.col("o_orderpriority") == "3-MEDIUM", 0).when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(2)
    return (
        t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"))
        .withColumn("place", place).orderBy("place", "o_orderpriority")
    )


@query("priority_queue_sort", """
    SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_search, max(event_id) AS since_id
    FROM events GROUP BY user_id""")
def priority_queue_sort(t):
    latest = t.events.groupBy("user_id").agg(F.max("ts").alias("last"), F.max("event_id").alias("since_id"))
    return latest.orderBy("last", "since_id").select(
        "user_id", F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last_search"), "since_id"
    )


@query("recent_items", """
    SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20""")
def recent_items(t):
    return t.orders.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20).select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")
    )


@query("sample_n", f"""
    SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice IS NOT NULL AND o_orderstatus IS NOT NULL
    ORDER BY {shuffle('42', 'o_orderkey')}, o_orderkey LIMIT 500""")
def sample_n(t):
    rows = R.complete_cases(t.orders, ["o_totalprice", "o_orderstatus"])
    return R.sample_n(rows, 500, "42", "o_orderkey").select("o_orderkey", "o_totalprice")


# ---- set operations and reshape --------------------------------------------------------------


@query("union_all", """
    SELECT 'customer' AS kind, c_name AS name, c_acctbal AS balance FROM customer
    UNION ALL SELECT 'supplier', s_name, s_acctbal FROM supplier""")
def union_all(t):
    customers = t.customer.select(F.lit("customer").alias("kind"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    suppliers = t.supplier.select(F.col("s_acctbal").alias("balance"), F.lit("supplier").alias("kind"), F.col("s_name").alias("name"))
    return customers.unionByName(suppliers)


@query("distinct_on", """
    SELECT min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, md5(text) AS text_md5 FROM documents GROUP BY text""")
def distinct_on(t):
    return R.distinct_on(t.documents, "text", "doc_id").select("doc_id", "lang", F.md5("text").alias("text_md5"))


# Frequent short words of the text table's languages.
COMMON_WORDS = ["the", "and", "of", "le", "la", "de", "que", "der", "und", "el"]


@query("array_set_ops", f"""
    WITH d AS (SELECT doc_id, list_distinct({words('text')}) AS w,
                      ['the', 'and', 'of', 'le', 'la', 'de', 'que', 'der', 'und', 'el'] AS c FROM documents)
    SELECT doc_id, array_to_string(list_sort(list_intersect(w, c)), ' ') AS common,
           len(list_filter(w, lambda x: NOT list_contains(c, x)))::int AS only_text,
           len(list_filter(c, lambda x: NOT list_contains(w, x)))::int AS only_list,
           len(list_distinct(list_concat(w, c)))::int AS either
    FROM d""")
def array_set_ops(t):
    common = F.array(*[F.lit(w) for w in COMMON_WORDS])
    docs = t.spread("documents", "doc_id").select("doc_id", F.array_distinct(S.words(F.col("text"))).alias("w"), common.alias("c"))
    return docs.select(
        "doc_id",
        F.array_join(F.array_sort(F.array_intersect("w", "c")), " ").alias("common"),
        F.size(F.array_except("w", "c")).alias("only_text"),
        F.size(F.array_except("c", "w")).alias("only_list"),
        F.size(F.array_union("w", "c")).alias("either"),
    )


@query("duplicate_report", """
    SELECT md5(text) AS text_md5, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1""")
def duplicate_report(t):
    return R.duplicate_report(t.documents, "text", "doc_id")


@query("wide_to_long", """
    SELECT s_suppkey, metric, value FROM (SELECT s_suppkey, s_acctbal, s_nationkey::double AS s_nationkey FROM supplier)
    UNPIVOT (value FOR metric IN (s_acctbal, s_nationkey))""")
def wide_to_long(t):
    wide = t.supplier.select("s_suppkey", "s_acctbal", F.col("s_nationkey").cast("double").alias("s_nationkey"))
    return R.wide_to_long(wide, ["s_suppkey"], ["s_acctbal", "s_nationkey"], "metric", "value")


# The event types of the events table.
EVENT_TYPES = ["signup", "error", "click", "view", "purchase"]


@query("long_to_wide", """
    SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type = 'signup') AS signup,
           count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'click') AS click,
           count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'purchase') AS purchase
    FROM events GROUP BY 1""")
def long_to_wide(t):
    counts = t.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"))
    return R.long_to_wide(counts, "day", "event_type", "n", EVENT_TYPES).na.fill(0)


@query("transpose_summary", """
    WITH s AS (SELECT count(*)::double AS n, round(avg(o_totalprice), 2) AS mean, min(o_totalprice) AS min,
                      max(o_totalprice) AS max FROM orders)
    SELECT statistic, value FROM s UNPIVOT (value FOR statistic IN (n, mean, min, max))""")
def transpose_summary(t):
    one_row = t.orders.agg(
        F.count("*").cast("double").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean"),
        F.min("o_totalprice").alias("min"), F.max("o_totalprice").alias("max"),
    )
    return R.wide_to_long(one_row, [], ["n", "mean", "min", "max"], "statistic", "value")


@query("explode_unnest", r"""
    WITH m AS (SELECT doc_id, regexp_extract_all(text, '([A-Za-z0-9._%+-]+)@([A-Za-z0-9.-]+\.[A-Za-z]{2,})', 1) AS u,
                      regexp_extract_all(text, '([A-Za-z0-9._%+-]+)@([A-Za-z0-9.-]+\.[A-Za-z]{2,})', 2) AS h FROM documents)
    SELECT doc_id, unnest(CASE WHEN len(u) = 0 THEN [NULL] ELSE u END) AS mailbox,
           unnest(CASE WHEN len(h) = 0 THEN [NULL] ELSE h END) AS host FROM m""")
def explode_unnest(t):
    def part(x, i):
        return F.split(x, "@")[i]

    mails = F.transform(S.emails(F.col("text")), lambda x: F.struct(part(x, 0).alias("mailbox"), part(x, 1).alias("host")))
    return t.spread("documents", "doc_id").select("doc_id", F.explode_outer(mails).alias("m")).select("doc_id", "m.*")


@query("category_cloud", """
    WITH c AS (SELECT unnest([lang, source, CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END]) AS category FROM documents)
    SELECT category, count(*) AS n FROM c GROUP BY category""")
def category_cloud(t):
    size = F.when(F.col("n_chars") > 2000, "long").otherwise("short")
    return (
        t.documents.select(F.explode(F.array("lang", "source", size)).alias("category"))
        .groupBy("category").agg(F.count("*").alias("n"))
    )
