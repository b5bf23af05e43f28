"""Aggregation, statistics and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import scalar as S
from larkspur.operators import metrics as M, stats as A
from larkspur.operators.graph import page_rank
from larkspur.operators.ordering import join_group_stats
from larkspur.operators.reliability import reliability
from larkspur.operators.text import link_edges
from larkspur.operators.windows import learning_prefixes
from larkspur.plans.registry import query
from larkspur.plans.relational_queries import COMMON_WORDS
from larkspur.plans.sqltext import score, shuffle, student_p, tokens, words
from larkspur.plans.text_queries import PAGES_SQL



# ---- grouped aggregates ----------------------------------------------------------------------


@query("group_count_mean", """
    SELECT n_name, count(*) AS n, round(avg(delay), 4) AS mean_delay FROM (
        SELECT o_custkey, greatest(date_diff('day', o_orderdate, l_shipdate), 0) AS delay
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-02-01' AND l_shipdate IS NOT NULL)
    LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
    GROUP BY n_name ORDER BY mean_delay DESC""")
def group_count_mean(t):
    """Delays are summed per customer before the dimension joins, so those joins see one row per
    customer, however many orders a customer has."""
    month = (F.col("o_orderdate") >= F.to_timestamp_ntz(F.lit("1997-01-01 00:00:00"))) & (
        F.col("o_orderdate") < F.to_timestamp_ntz(F.lit("1997-02-01 00:00:00"))
    )
    delay = S.clip_lower(F.datediff("l_shipdate", "o_orderdate"))
    per_customer = (
        t.lineitem.where(F.col("l_shipdate").isNotNull())
        .join(t.orders.where(month), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_custkey")
        .agg(F.count("*").alias("n"), F.sum(delay).alias("days"))
    )
    return (
        per_customer.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .groupBy("n_name")
        .agg(F.sum("n").alias("n"), F.round(F.sum("days") / F.sum("n"), 4).alias("mean_delay"))
        .orderBy(F.desc("mean_delay"), "n_name")
    )


@query("value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def value_counts(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type")


@query("count_by_split", "SELECT lang, source, count(*) AS examples FROM documents GROUP BY lang, source")
def count_by_split(t):
    return t.documents.groupBy("lang", "source").agg(F.count("*").alias("examples")).orderBy("lang", "source")


@query("group_having", """
    SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 4) AS mean_price, sum(p_size)::bigint AS total_size
    FROM part GROUP BY p_brand HAVING sum(p_size) > 499""")
def group_having(t):
    return (
        t.part.groupBy("p_brand")
        .agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 4).alias("mean_price"), F.sum("p_size").alias("total_size"))
        .where(F.col("total_size") > 499)
        .orderBy(F.desc("total_size"), "p_brand")
    )


@query("group_count_dropnull", """
    SELECT lang, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY ALL""")
def group_count_dropnull(t):
    joined = t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return joined.groupBy("lang", "quality").agg(F.count("*").alias("n")).na.drop(subset=["lang", "quality"])


@query("weekly_sum", """
    SELECT event_type, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, round(coalesce(sum(value), 0), 4) AS total
    FROM events GROUP BY ALL""")
def weekly_sum(t):
    sums = A.weekly_sum(t.events, ["event_type"], "ts", "value")
    return sums.select("event_type", F.date_format("week", "yyyy-MM-dd").alias("week"), F.round("total", 4).alias("total"))


@query("month_facet", """
    WITH w AS (SELECT date_trunc('week', ts) AS week, sum(value) AS total FROM events WHERE event_type = 'purchase' GROUP BY 1)
    SELECT strftime(week, '%b') AS month, count(*) AS weeks, round(sum(total), 4) AS total FROM w GROUP BY 1""")
def month_facet(t):
    weeks = A.weekly_sum(t.events.where(F.col("event_type") == "purchase"), ["event_type"], "ts", "value")
    return weeks.groupBy(F.date_format("week", "MMM").alias("month")).agg(
        F.count("*").alias("weeks"), F.round(F.sum("total"), 4).alias("total")
    )


@query("ohlc_yearly", """
    WITH e AS (SELECT user_id, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, ts, event_id, value,
                      lead(value) OVER (PARTITION BY user_id, date_trunc('week', ts) ORDER BY ts, event_id) AS nxt
               FROM events WHERE ts >= TIMESTAMP '2017-01-01')
    SELECT user_id, week, count(value) AS trading_days, arg_min(value, (ts, event_id)) AS first,
           arg_max(value, (ts, event_id)) AS last, max(value) AS high, min(value) AS low,
           round(arg_max(value, (ts, event_id)) / nullif(arg_min(value, (ts, event_id)), 0) - 1, 6) + 0.0 AS growth,
           round(stddev_pop(CASE WHEN value > 0 AND nxt > 0 THEN ln(value / nxt) END) * sqrt(252), 6) + 0.0 AS volatility
    FROM e GROUP BY user_id, week""")
def ohlc_yearly(t):
    since = F.lit("2017-01-01").cast(t.events.schema["ts"].dataType)
    events = t.events.where(F.col("ts") >= since).withColumn("week", F.date_format(A.week_start("ts"), "yyyy-MM-dd"))
    series = A.ohlc(events, ["user_id", "week"], ["ts", "event_id"], "value", F.date_trunc("minute", "ts"))
    return series.withColumns({c: S.rounded(F.col(c), 6) for c in ("growth", "volatility")})


@query("growth", """
    SELECT user_id, round(arg_max(value, (ts, event_id)) / nullif(arg_min(value, (ts, event_id)), 0) - 1, 6) + 0.0 AS growth
    FROM events GROUP BY user_id""")
def growth(t):
    return t.events.groupBy("user_id").agg(S.rounded(A.growth("value", "ts", "event_id"), 6).alias("growth"))


@query("volatility", """
    WITH e AS (SELECT user_id, value AS v, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events)
    SELECT user_id, round(stddev_pop(CASE WHEN v > 0 AND nxt > 0 THEN ln(v / nxt) END) * sqrt(252), 6) + 0.0 AS volatility FROM e GROUP BY user_id""")
def volatility(t):
    returns = A.with_log_return(t.events, ["user_id"], ["ts", "event_id"], "value", F.date_trunc("minute", "ts"))
    return returns.groupBy("user_id").agg(S.rounded(A.volatility(), 6).alias("volatility"))


# ---- profiles and models ---------------------------------------------------------------------

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("describe", """
    WITH v AS (SELECT "column", value FROM (SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)
               UNPIVOT INCLUDE NULLS (value FOR "column" IN (l_quantity, l_extendedprice, l_discount, l_tax)))
    SELECT "column", count(value) AS count, (count(*) - count(value)) AS null_count, round(avg(value), 4) + 0.0 AS mean,
           round(stddev_samp(value), 4) + 0.0 AS std, min(value) + 0.0 AS min, max(value) + 0.0 AS max,
           round(quantile_cont(value, 0.25), 4) + 0.0 AS q25, round(quantile_cont(value, 0.5), 4) + 0.0 AS q50,
           round(quantile_cont(value, 0.75), 4) + 0.0 AS q75
    FROM v GROUP BY "column\"""")
def describe(t):
    stats = A.describe(t.lineitem, LINE_NUMBERS)
    doubles = ["mean", "std", "min", "max", "q25", "q50", "q75"]
    return stats.withColumns({c: S.rounded(F.col(c), 4) for c in doubles})


@query("null_profile", """
    WITH j AS (SELECT d.doc_id, lang, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id)),
    s AS (SELECT count(*) AS n, n - count(doc_id) AS doc_id, n - count(lang) AS lang, n - count(quality) AS quality,
                 n - count(toxic) AS toxic FROM j)
    SELECT "column", null_count, round(null_count / n, 6) AS null_share
    FROM s UNPIVOT (null_count FOR "column" IN (doc_id, lang, quality, toxic))""")
def null_profile(t):
    joined = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")
    return A.null_profile(joined).withColumn("null_share", F.round("null_share", 6)).orderBy(F.desc("null_count"), "column")


@query("corr_matrix", "\n    UNION ALL ".join(
    f"SELECT '{b}' AS row, '{a}' AS \"column\", round(corr({a}, {b}), 6) + 0.0 AS corr FROM lineitem"
    for i, a in enumerate(LINE_NUMBERS) for b in LINE_NUMBERS[i + 1:]))
def corr_matrix(t):
    return A.correlations(t.lineitem, LINE_NUMBERS).withColumn("corr", S.rounded(F.col("corr"), 6))


@query("simple_regression", """
    SELECT regr_count(l_extendedprice, l_quantity)::bigint AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
           round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
           round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem""")
def simple_regression(t):
    fit = A.simple_regression(t.lineitem, "l_extendedprice", "l_quantity")
    return fit.select("n", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 6).alias("r2"))


@query("ols", """
    WITH d AS (SELECT l_extendedprice / 1000 AS y, l_quantity AS a, (l_returnflag = 'R')::int::double AS b FROM lineitem),
    m AS (SELECT count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, regr_sxx(a, a) AS saa, regr_sxx(b, b) AS sbb,
                 regr_sxy(a, b) AS sab, regr_sxy(a, y) AS say, regr_sxy(b, y) AS sby, regr_sxx(y, y) AS syy FROM d),
    f AS (SELECT *, saa * sbb - sab * sab AS det, (say * sbb - sby * sab) / det AS ca, (sby * saa - say * sab) / det AS cb,
                 my - ca * ma - cb * mb AS c0, syy - ca * say - cb * sby AS sse, sse / (n - 3) AS s2 FROM m),
    r AS (SELECT 'quantity' AS term, ca AS coef, sqrt(s2 * sbb / det) AS se, n, 1 - sse / syy AS r2 FROM f
          UNION ALL SELECT 'returned', cb, sqrt(s2 * saa / det), n, 1 - sse / syy FROM f
          UNION ALL SELECT 'intercept', c0, sqrt(s2 * (1 / n + (ma * ma * sbb - 2 * ma * mb * sab + mb * mb * saa) / det)),
                 n, 1 - sse / syy FROM f),
    l AS (SELECT *, 1.959963984540054::double AS z, z + (pow(z, 3) + z) / (4 * (n - 3)) + (5 * pow(z, 5) + 16 * pow(z, 3) + 3 * z) / (96 * pow(n - 3, 2)) AS limit_ FROM r)
    SELECT term, round(coef, 6) + 0.0 AS coef, round(se, 6) AS se, round(coef / se, 4) + 0.0 AS t, round(""" + student_p("coef / se", "n - 3") + """, 6) + 0.0 AS p,
           round(coef - limit_ * se, 4) + 0.0 AS low, round(coef + limit_ * se, 4) + 0.0 AS high, n, round(r2, 6) AS r2 FROM l""")
def ols(t):
    rows = t.lineitem.select(
        (F.col("l_extendedprice") / 1000).alias("price"), F.col("l_quantity").alias("quantity"),
        (F.col("l_returnflag") == "R").alias("returned"),
    )
    fit = A.ols(rows, "price", ["quantity", "returned"])
    return fit.select(
        "term", S.rounded(F.col("coef"), 6).alias("coef"), F.round("se", 6).alias("se"),
        S.rounded(F.col("t"), 4).alias("t"), S.rounded(F.col("p"), 6).alias("p"),
        S.rounded(F.col("low"), 4).alias("low"), S.rounded(F.col("high"), 4).alias("high"), "n", F.round("r2", 6).alias("r2"),
    )


@query("t_test", """
    WITH s AS (SELECT count(*) FILTER (quality = 1) AS n1, avg(n_chars) FILTER (quality = 1) AS m1,
                      var_samp(n_chars) FILTER (quality = 1) AS v1, count(*) FILTER (quality <> 1) AS n2,
                      avg(n_chars) FILTER (quality <> 1) AS m2, var_samp(n_chars) FILTER (quality <> 1) AS v2
               FROM documents JOIN labels USING (doc_id)),
    u AS (SELECT *, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)) AS t, n1 + n2 - 2 AS df FROM s)
    SELECT n1, n2, round(m1, 4) AS mean1, round(m2, 4) AS mean2, round(t, 6) + 0.0 AS t, df,
           round(""" + student_p("t", "df") + """, 6) + 0.0 AS p FROM u""")
def t_test(t):
    joined = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id")
    result = A.t_test(joined, "n_chars", F.col("quality") == 1)
    return result.select("n1", "n2", F.round("mean1", 4).alias("mean1"), F.round("mean2", 4).alias("mean2"),
                         S.rounded(F.col("t"), 6).alias("t"), "df", S.rounded(F.col("p"), 6).alias("p"))


@query("box_stats", """
    SELECT event_type = 'purchase' AS is_purchase, min(value) AS min, round(quantile_cont(value, 0.25), 6) AS q1,
           round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS max
    FROM events GROUP BY 1""")
def box_stats(t):
    events = t.events.select((F.col("event_type") == "purchase").alias("is_purchase"), "value")
    return A.box_stats(events, "value", ["is_purchase"]).withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


@query("hist_2d", """
    WITH b AS (SELECT min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_extendedprice) AS y0, max(l_extendedprice) AS y1 FROM lineitem)
    SELECT least(floor((l_quantity - x0) / (x1 - x0) * 100), 99)::int AS x_bin,
           least(floor((l_extendedprice - y0) / (y1 - y0) * 100), 99)::int AS y_bin, count(*) AS n
    FROM lineitem, b GROUP BY ALL""")
def hist_2d(t):
    return A.hist_2d(t.lineitem, "l_quantity", "l_extendedprice", 100)


# ---- evaluation ------------------------------------------------------------------------------

_FOUND = f"list_filter(list_sort(list_distinct({words('text')})), lambda w: list_contains({COMMON_WORDS!r}, w))"
_WORD_SCORE = "('0x' || substr(md5(concat_ws('|', '{seed}', cast(doc_id AS VARCHAR), w)), 1, 4))::int"
ASPECTS_SQL = f"""
    WITH f AS (SELECT doc_id, {_FOUND} AS found FROM documents),
    s AS (SELECT doc_id, list_transform(found, lambda w: w || '/' || CASE WHEN {_WORD_SCORE.format(seed='gold')} % 2 = 0
                         THEN 'positive' ELSE 'negative' END) AS gold,
                 list_transform(list_filter(found, lambda w: {_WORD_SCORE.format(seed='miss')} % 4 <> 0),
                         lambda w: w || '/' || CASE WHEN ({_WORD_SCORE.format(seed='gold')} % 2 = 0) <> ({_WORD_SCORE.format(seed='flip')} % 5 = 0)
                         THEN 'positive' ELSE 'negative' END) AS pred FROM f),
    c AS (SELECT doc_id, len(list_intersect(gold, pred))::int AS tp, len(pred) - tp AS fp, len(gold) - tp AS fn FROM s)"""


def aspect_counts(t):
    """Gold and predicted (term, polarity) sets per document, made from the words found in it; the
    prediction misses some terms, flips some polarities and writes terms in capitals."""
    found = F.array_sort(F.array_intersect(S.words(F.col("text")), F.array(*[F.lit(w) for w in COMMON_WORDS])))

    def score_of(seed, w):
        return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string"), w)), 1, 4), 16, 10).cast("int")

    def aspect(w, positive, upper=False):
        return F.struct(
            (F.upper(w) if upper else w).alias("term"),
            F.when(positive, "positive").otherwise("negative").alias("polarity"),
        )

    def is_positive(w):
        return score_of("gold", w) % 2 == 0

    gold = F.transform("found", lambda w: aspect(w, is_positive(w)))
    kept = F.filter("found", lambda w: score_of("miss", w) % 4 != 0)
    pred = F.transform(kept, lambda w: aspect(w, is_positive(w) != (score_of("flip", w) % 5 == 0), upper=True))

    def normalise(a):
        return F.struct(F.lower(a["term"]).alias("term"), F.lower(a["polarity"]).alias("polarity"))

    sets = t.spread("documents", "doc_id").select("doc_id", found.alias("found")).select("doc_id", gold.alias("gold"), pred.alias("pred"))
    counts = M.set_counts(F.col("gold"), F.col("pred"), normalise)
    return sets.select("doc_id", *[c.alias(n) for n, c in counts.items()])


@query("set_f1", ASPECTS_SQL + """,
    p AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r FROM c)
    SELECT count(*) AS examples, round(avg(CASE WHEN tp + fp + fn = 0 THEN 1.0::double WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END), 6) AS mean_f1
    FROM p""")
def set_f1(t):
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return aspect_counts(t).agg(F.count("*").alias("examples"), F.round(F.avg(M.set_f1(tp, fp, fn)), 6).alias("mean_f1"))


@query("micro_pr", ASPECTS_SQL + """
    SELECT sum(tp)::bigint AS tp, sum(fp)::bigint AS fp, sum(fn)::bigint AS fn, round(sum(tp) / (sum(tp) + sum(fp)), 6) AS precision,
           round(sum(tp) / (sum(tp) + sum(fn)), 6) AS recall FROM c""")
def micro_pr(t):
    return M.micro_precision_recall(aspect_counts(t)).withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


METRICS_SQL = """count(*) AS n, count(*) FILTER (quality = 1 AND p >= 0.5) AS tp, count(*) FILTER (quality <> 1 AND p >= 0.5) AS fp,
           count(*) FILTER (quality = 1 AND p < 0.5) AS fn,
           avg(-ln(CASE WHEN quality = 1 THEN greatest(least(p, 1 - 1e-15), 1e-15) ELSE 1 - greatest(least(p, 1 - 1e-15), 1e-15) END)) AS ll"""
METRICS_OUT = """n, round((n - fp - fn) / n, 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
           round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(ll, 6) AS log_loss"""
METRIC_NAMES = ("accuracy", "precision", "recall", "f1", "log_loss")


def predictions(t):
    """Labels with a made-up predicted probability."""
    return t.labels.withColumn("p", S.seeded_score("prob", "doc_id") / 65535.0)


@query("binary_metrics", f"""
    WITH d AS (SELECT quality, {score('prob', 'doc_id')} / 65535 AS p FROM labels), m AS (SELECT {METRICS_SQL} FROM d)
    SELECT {METRICS_OUT} FROM m""")
def binary_metrics(t):
    return M.binary_metrics(predictions(t), "quality", "p").withColumns({c: F.round(c, 6) for c in METRIC_NAMES})


@query("learning_curve_metrics", f"""
    WITH d AS (SELECT quality, {score('prob', 'doc_id')} / 65535 AS p, row_number() OVER (ORDER BY {shuffle('curve', 'doc_id')}, doc_id) AS rn,
                      count(*) OVER () AS total FROM labels),
    m AS (SELECT fraction, {METRICS_SQL} FROM d, (VALUES (0.8::double), (0.9), (1.0)) f(fraction) WHERE rn <= floor(fraction * total) GROUP BY fraction)
    SELECT fraction, {METRICS_OUT} FROM m""")
def learning_curve_metrics(t):
    prefixes = learning_prefixes(predictions(t), "doc_id", "curve", [0.8, 0.9, 1.0])
    return M.binary_metrics(prefixes, "quality", "p", ["fraction"]).withColumns({c: F.round(c, 6) for c in METRIC_NAMES})


@query("throughput_report", """
    WITH s AS (SELECT user_id, count(*) AS items, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6::double AS seconds FROM events GROUP BY user_id)
    SELECT user_id, items, round(seconds, 6) AS seconds, CASE WHEN seconds = 0 THEN 0 ELSE round(items / seconds, 9) END AS per_second FROM s""")
def throughput_report(t):
    return M.throughput(t.events, "user_id", "ts").withColumns(
        {"seconds": F.round("seconds", 6), "per_second": F.round("per_second", 9)}
    )


@query("pass_at_k", """
    WITH u AS (SELECT user_id, count(*) AS k, bool_or(value > 20) AS a, bool_and(value > 20) AS e, avg((value > 20)::int) > 0.5 AS m
               FROM events GROUP BY user_id)
    SELECT count(*) AS tasks, sum(k)::bigint AS runs, round(avg(a::int), 6) AS pass_at_k, round(avg(e::int), 6) AS pass_hat_k,
           round(avg(m::int), 6) AS majority_at_k FROM u""")
def pass_at_k(t):
    result = M.pass_at_k(t.events, "user_id", F.col("value") > 20)
    return result.withColumns({c: F.round(c, 6) for c in ("pass_at_k", "pass_hat_k", "majority_at_k")})


# ---- tournaments -----------------------------------------------------------------------------

MATCHES_SQL = """
    WITH matches AS (SELECT cn.n_name AS c1, sn.n_name AS c2, l_linestatus AS attribute,
                            CASE WHEN (l_quantity + (c_nationkey - s_nationkey)) > 25 THEN 1 ELSE 2 END AS preferred
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN supplier ON l_suppkey = s_suppkey JOIN nation cn ON c_nationkey = cn.n_nationkey
        JOIN nation sn ON s_nationkey = sn.n_nationkey WHERE c_nationkey <> s_nationkey)"""


def nation_matches(t):
    """Every order line as one judged comparison of the buyer's nation with the seller's."""
    buyer = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("competitor_1"))
    seller = t.nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("competitor_2"))
    lead = F.col("l_quantity") + (F.col("c_nationkey") - F.col("s_nationkey"))
    return (
        t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .where(F.col("c_nationkey") != F.col("s_nationkey"))
        .join(buyer, "c_nationkey").join(seller, "s_nationkey")
        .select("competitor_1", "competitor_2", F.col("l_linestatus").alias("attribute"),
                F.when(lead > 25, 1).otherwise(2).alias("preferred"))
    )


@query("pairwise_wins", MATCHES_SQL + """,
    s AS (SELECT c1 AS competitor, attribute, (preferred = 1)::int AS win, (preferred = 1)::int AS fw, 1 AS f FROM matches
          UNION ALL SELECT c2, attribute, (preferred = 2)::int, 0, 0 FROM matches)
    SELECT competitor, attribute, sum(win)::bigint AS wins, count(*) AS matches,
           CASE WHEN sum(f) = 0 THEN 0 ELSE round(sum(fw) / sum(f), 6) END AS first_win_rate FROM s GROUP BY ALL""")
def pairwise_wins(t):
    return M.pairwise_wins(nation_matches(t)).withColumn("first_win_rate", F.round("first_win_rate", 6))


#: Steps that the SQL writes out; the plan stops by itself.
BT_STEPS = 60
BT_SQL = MATCHES_SQL + """,
    pairs AS MATERIALIZED (SELECT i, j, sum(w) AS w, count(*) AS n FROM (
        SELECT c1 AS i, c2 AS j, (preferred = 1)::int AS w FROM matches
        UNION ALL SELECT c2, c1, (preferred = 2)::int FROM matches) GROUP BY i, j),
    wins AS MATERIALIZED (SELECT i, sum(w) AS wins FROM pairs GROUP BY i),
    s0 AS (SELECT i, 1.0::double AS r FROM wins)""" + "".join(f""",
    s{k + 1} AS MATERIALIZED (SELECT p.i, any_value(wins) / sum(n / (a.r + b.r)) AS r FROM pairs p JOIN s{k} a ON p.i = a.i
        JOIN s{k} b ON p.j = b.i JOIN wins ON wins.i = p.i GROUP BY p.i)""" for k in range(BT_STEPS)) + f"""
    , errors AS (SELECT p.i, 1 / sqrt(sum(n * a.r * b.r / pow(a.r + b.r, 2))) AS log_error FROM pairs p JOIN s{BT_STEPS} a ON p.i = a.i JOIN s{BT_STEPS} b ON p.j = b.i GROUP BY p.i)
    SELECT i AS competitor, wins::bigint AS wins, round(r / (SELECT avg(r) FROM s{BT_STEPS}), 6) AS strength, round(log_error, 6) AS log_error
    FROM s{BT_STEPS} JOIN wins USING (i) JOIN errors USING (i)"""


@query("bradley_terry", BT_SQL)
def bradley_terry(t):
    """Every nation is tied to every other one here, so there is one component."""
    ranked = M.bradley_terry(nation_matches(t), tolerance=1e-13)
    return ranked.select("competitor", "wins", F.round("strength", 6).alias("strength"), F.round("log_error", 6).alias("log_error")).orderBy(F.desc("strength"), "competitor")


# ---- counts, votes and label checks ----------------------------------------------------------


@query("cost_totals", f"""
    WITH p(role, usd_per_million) AS (VALUES ('system', 5.0::double), ('user', 10.0), ('assistant', 30.0))
    SELECT role, count(*) AS requests, sum(tok)::bigint AS tokens, round(sum(tok * usd_per_million) / 1e6::double, 6) AS cost
    FROM (SELECT role, {tokens('text')} AS tok FROM conversations) JOIN p USING (role) GROUP BY role""")
def cost_totals(t):
    usage = t.conversations.groupBy("role").agg(
        F.count("*").alias("requests"), F.sum(S.estimated_tokens(F.col("text"))).alias("tokens")
    )
    # US dollars per million tokens by role.
    price = F.when(F.col("role") == "system", 5.0).when(F.col("role") == "user", 10.0).when(F.col("role") == "assistant", 30.0)
    return usage.select("role", "requests", "tokens", F.round(F.col("tokens") * price / 1e6, 6).alias("cost"))


@query("majority_vote", """
    WITH c AS (SELECT user_id, event_type, count(*) AS votes FROM events GROUP BY ALL)
    SELECT user_id, event_type, votes FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, event_type) = 1""")
def majority_vote(t):
    return M.majority_vote(t.events, "user_id", "event_type")


@query("annotator_agreement", f"""
    WITH l AS (SELECT quality AS a, CASE WHEN {score('second', 'doc_id')} < 6554 THEN 1 - quality ELSE quality END AS b FROM labels),
    t AS (SELECT count(*) AS n, avg((a = b)::int) AS observed FROM l),
    e AS (SELECT sum(ra * rb) AS e FROM (SELECT a AS c, count(*) AS ra FROM l GROUP BY a) JOIN (SELECT b AS c, count(*) AS rb FROM l GROUP BY b) USING (c))
    SELECT n, round(observed, 6) AS observed, round(e / (n * n), 6) AS expected, round((observed - e / (n * n)) / (1 - e / (n * n)), 6) AS kappa FROM t, e""")
def annotator_agreement(t):
    second = F.when(S.seeded_score("second", "doc_id") < 6554, 1 - F.col("quality")).otherwise(F.col("quality"))
    result = M.annotator_agreement(t.labels.withColumn("second", second), "quality", "second")
    return result.withColumns({c: F.round(c, 6) for c in ("observed", "expected", "kappa")})


#: Seeded rates (of 65536) at which five made-up annotators turn a label round, and the rounds that the SQL writes out.
TURNED = {"ann": 1300, "ben": 3300, "cai": 6600, "dia": 9800, "eve": 16400}
EM_ROUNDS = 40
EM_SQL = "WITH a AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT doc_id AS item, '{name}' AS who, CASE WHEN {score(name, 'doc_id')} < {rate} THEN 1 - quality ELSE quality END AS answer FROM labels WHERE quality IS NOT NULL"
    for name, rate in TURNED.items()) + """),
    l AS (SELECT DISTINCT answer AS label FROM a),
    b0 AS MATERIALIZED (SELECT item, label, avg((answer = label)::int) AS p FROM a, l GROUP BY ALL)""" + "".join(f""",
    s{k} AS (SELECT label, (sum(p) + 0.01::double) / (sum(sum(p)) OVER () + 0.01::double * (SELECT count(*) FROM l)) AS share FROM b{k} GROUP BY label),
    c{k} AS (SELECT who, label, answer, sum(p) AS mass FROM a JOIN b{k} USING (item) GROUP BY ALL),
    r{k} AS MATERIALIZED (SELECT who, label, answer, (mass + 0.01::double) / (sum(mass) OVER (PARTITION BY who, label) + 0.01::double * (SELECT count(*) FROM l)) AS rate FROM c{k}),
    e{k} AS (SELECT item, label, exp(sum(ln(rate)) + any_value(ln(share))) AS e FROM a JOIN r{k} USING (who, answer) JOIN s{k} USING (label) GROUP BY ALL),
    b{k + 1} AS MATERIALIZED (SELECT item, label, e / sum(e) OVER (PARTITION BY item) AS p FROM e{k})""" for k in range(EM_ROUNDS))


def answers_of_five(t):
    """The labels as five annotators with known rates of error would give them."""
    given = [F.struct(F.lit(name).alias("who"), F.when(S.seeded_score(name, "doc_id") < rate, 1 - F.col("quality")).otherwise(F.col("quality")).alias("answer")) for name, rate in TURNED.items()]
    return t.labels.where("quality IS NOT NULL").select(F.col("doc_id").alias("item"), F.inline(F.array(*given)))


@query("annotator_reliability", EM_SQL + f"""
    SELECT who, count(*) AS answers, round(sum(CASE WHEN label = answer THEN p ELSE 0 END) / sum(p), 5) AS accuracy
    FROM a JOIN b{EM_ROUNDS} USING (item) GROUP BY who""".replace("count(*) AS answers", "round(sum(p))::bigint AS answers"))
def annotator_reliability(t):
    """How reliable five annotators are, found from their answers alone."""
    found = reliability(answers_of_five(t), "item", "who", "answer", tolerance=1e-9)
    return found.annotators.withColumn("accuracy", F.round("accuracy", 5))


@query("class_balance", """
    SELECT quality, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share,
           round(max(count(*)) OVER () / count(*), 6) AS imbalance FROM labels GROUP BY quality""")
def class_balance(t):
    return M.class_balance(t.labels, "quality").withColumns({c: F.round(c, 6) for c in ("share", "imbalance")})


@query("judge_rating_mean", f"""
    WITH a AS (SELECT role, text || ' Rating: ' || ({score('judge', 'conv_id', 'turn')} % 10 + 1)::varchar AS answer FROM conversations)
    SELECT role, count(*) AS n, round(avg(regexp_extract(answer, '([0-9]+)\\s*$', 1)::int), 6) AS mean_rating FROM a GROUP BY role""")
def judge_rating_mean(t):
    stars = S.seeded_score("judge", "conv_id", "turn") % 10 + 1
    answers = t.conversations.select("role", F.concat(F.col("text"), F.lit(" Rating: "), stars.cast("string")).alias("answer"))
    rating = F.regexp_extract("answer", r"([0-9]+)\s*$", 1).try_cast("int")
    return answers.groupBy("role").agg(F.count("*").alias("n"), F.round(F.avg(rating), 6).alias("mean_rating"))


@query("mention_counts", """
    SELECT strftime(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M') AS window_start, event_type AS label, count(*) AS n
    FROM events GROUP BY ALL""")
def mention_counts(t):
    slot = F.window(F.col("ts"), "6 hours")
    return t.events.groupBy(slot.alias("w"), F.col("event_type").alias("label")).agg(F.count("*").alias("n")).select(
        F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("window_start"), "label", "n"
    )


LINKS_SQL = PAGES_SQL + """,
    links AS (SELECT {'host': host, 'path': path} AS src, {'host': to_host, 'path': to_path} AS dst, 1.0::double AS w FROM e JOIN p USING (page_id))"""


def rank_sql(steps: int) -> str:
    """Common table expressions from ``links`` (src, dst, w) to ``ranks`` (node, rank), with so many rounds written out."""
    return """,
    edges AS MATERIALIZED (SELECT src, dst, sum(w) AS w FROM links WHERE src IS NOT NULL AND dst IS NOT NULL AND w > 0 GROUP BY src, dst),
    flow AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM edges),
    nodes AS MATERIALIZED (SELECT src AS node FROM edges UNION SELECT dst FROM edges),
    y0 AS (SELECT node, 1 / 0.15::double AS y FROM nodes)""" + "".join(f""",
    y{k + 1} AS MATERIALIZED (SELECT n.node, 1 + 0.85::double * coalesce(b.s, 0) AS y FROM nodes n
        LEFT JOIN (SELECT dst, sum(y * share) AS s FROM flow JOIN y{k} ON node = src GROUP BY dst) b ON b.dst = n.node)""" for k in range(steps)) + f""",
    ranks AS (SELECT node, y / sum(y) OVER () AS rank FROM y{steps})"""


@query("degree_centrality", PAGES_SQL + """,
    k AS (SELECT host, path, to_host, to_path FROM e JOIN p USING (page_id)),
    n AS (SELECT host, path, 1 AS o, 0 AS i FROM k UNION ALL SELECT to_host, to_path, 0, 1 FROM k)
    SELECT host, path, sum(o)::bigint AS out_degree, sum(i)::bigint AS in_degree FROM n GROUP BY ALL""")
def degree_centrality(t):
    ends = F.array(
        F.struct("host", "path", F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("to_host").alias("host"), F.col("to_path").alias("path"), F.lit(0).alias("o"), F.lit(1).alias("i")),
    )
    return link_edges(t.pages).select(F.inline(ends)).groupBy("host", "path").agg(
        F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree")
    )


@query("page_rank", LINKS_SQL + rank_sql(8) + """
    SELECT node.host AS host, node.path AS path, round(rank, 9) AS rank FROM ranks""")
def page_rank_query(t):
    """PageRank of the places that pages link to and from. In these links no place is reached that has links of its own, so two
    rounds are enough for the SQL."""
    links = link_edges(t.pages).select(F.struct("host", "path").alias("src"), F.struct(F.col("to_host").alias("host"), F.col("to_path").alias("path")).alias("dst"))
    return page_rank(links).select("node.host", "node.path", F.round("rank", 9).alias("rank"))


@query("trade_rank", """
    WITH links AS (SELECT c_nationkey AS src, s_nationkey AS dst, sum(l_quantity)::double AS w
                   FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
                   WHERE c_nationkey <> s_nationkey GROUP BY ALL)""" + rank_sql(30) + """
    SELECT n_name, round(rank, 8) AS rank FROM ranks JOIN nation ON n_nationkey = node""")
def trade_rank(t):
    """PageRank of nations in the network of their trade: what customers of one order from suppliers of another."""
    lines = t.lineitem.select("l_orderkey", "l_suppkey", "l_quantity").join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    per_pair = lines.groupBy("o_custkey", "l_suppkey").agg(F.sum("l_quantity").alias("w"))
    buyers = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("src"))
    sellers = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("dst"))
    links = per_pair.join(buyers, "o_custkey").join(sellers, "l_suppkey").where("src <> dst").groupBy("src", "dst").agg(F.sum("w").alias("w"))
    ranked = page_rank(links, weight="w", tolerance=1e-12)
    nations = t.nation.select(F.col("n_nationkey").alias("node"), "n_name")
    return ranked.join(nations, "node").select("n_name", F.round("rank", 8).alias("rank"))


@query("sequence_success", """
    WITH e AS (SELECT event_type, count(*) FILTER (value < 5) / count(*) AS e FROM events GROUP BY event_type)
    SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS steps, CASE WHEN max(e) >= 1 THEN 0.0 ELSE round(exp(sum(CASE WHEN e < 1 THEN ln(1 - e) END)), 6) END AS success,
           round(pow(1 - max(e), count(*)), 6) AS worst_case
    FROM events JOIN e USING (event_type) GROUP BY ALL""")
def sequence_success(t):
    """Steps are counted per session and type first; the failure rates join those counts."""
    rates = t.events.groupBy("event_type").agg((F.count_if(F.col("value") < 5) / F.count("*")).alias("e"), F.count("*").alias("n"))
    steps = t.events.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("k"))
    rated = join_group_stats(steps, rates, ["event_type"], "n", ["user_id", "day"])
    return rated.groupBy("user_id", "day").agg(
        F.sum("k").alias("steps"),
        F.when(F.max("e") >= 1, F.lit(0.0)).otherwise(F.round(F.exp(F.sum(F.col("k") * F.ln(1 - F.col("e")))), 6)).alias("success"),
        F.round(F.pow(1 - F.max("e"), F.sum("k")), 6).alias("worst_case"),
    )


@query("row_and_time_range", """
    SELECT 'events' AS what, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM events
    UNION ALL SELECT 'documents', count(*), '', '' FROM documents
    UNION ALL SELECT 'distinct documents', count(DISTINCT text), '', '' FROM documents""")
def row_and_time_range(t):
    def stamp(c):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")

    events = t.events.agg(F.count("*").alias("n"), stamp(F.min("ts")).alias("first_ts"), stamp(F.max("ts")).alias("last_ts"))
    blank = [F.lit("").alias("first_ts"), F.lit("").alias("last_ts")]
    docs = t.documents.agg(F.count("*").alias("n"))
    distinct = t.documents.groupBy(F.sha2("text", 256)).agg(F.lit(1)).agg(F.count("*").alias("n"))
    return (
        events.select(F.lit("events").alias("what"), "*")
        .unionByName(docs.select(F.lit("documents").alias("what"), "n", *blank))
        .unionByName(distinct.select(F.lit("distinct documents").alias("what"), "n", *blank))
    )


@query("distribution_shift", """
    WITH p AS (SELECT source AS category, count(*) / sum(count(*)) OVER () AS s FROM documents JOIN labels USING (doc_id) GROUP BY source),
    w AS (SELECT source AS category, count(*) / sum(count(*)) OVER () AS s FROM documents GROUP BY source)
    SELECT category, round(coalesce(p, 0), 6) AS part_share, round(coalesce(w, 0), 6) AS whole_share,
           round(coalesce(p, 0) - coalesce(w, 0), 6) + 0.0 AS shift FROM (SELECT category, max(p) AS p, max(w) AS w FROM
        (SELECT category, s AS p, NULL AS w FROM p UNION ALL SELECT category, NULL, s FROM w) GROUP BY category)""")
def distribution_shift(t):
    docs = t.documents.select("doc_id", "source")
    shift = A.distribution_shift(docs.join(t.labels, "doc_id", "left_semi"), docs, "source")
    return shift.withColumns({c: S.rounded(F.col(c), 6) for c in ("part_share", "whole_share", "shift")})


FINGERPRINT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@query("dataset_fingerprint", f"""
    WITH h AS (SELECT md5(concat({', '.join(f"coalesce(length({c}::varchar)::varchar || ':' || {c}::varchar, 'null;')" for c in FINGERPRINT_COLUMNS)})) AS h FROM documents)
    SELECT count(*) AS n_rows, concat(sum(('0x' || substr(h, 1, 15))::hugeint)::varchar, '-', sum(('0x' || substr(h, 16, 15))::hugeint)::varchar) AS fingerprint
    FROM h""")
def dataset_fingerprint(t):
    return A.fingerprint(t.documents, FINGERPRINT_COLUMNS)
