"""Published worked numbers and hand-made edge cases."""

import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from larkspur.functions import scalar as S
from larkspur.operators import (
    answers as N, billing as B, labels as L, metrics as M, quality as Q, relational as R, stats as A, text as X,
    vectors as V, windows as W,
)


def test_split_sizes(spark):
    rows = spark.range(8542).select("id", (F.col("id") % 2).cast("int").alias("label"))
    counts = L.stratified_split(rows, "label", "id", "s").groupBy("label", "split").count().collect()
    assert {(r["label"], r["split"]): r["count"] for r in counts} == {
        (c, s): n for c in (0, 1) for s, n in (("train", 2562), ("test", 854), ("valid", 855))
    }


def test_round_robin(spark):
    names = spark.createDataFrame([("red",), ("green",), ("blue",), ("green",)], "name STRING")
    pairs = R.all_pairs(names, "name", ["memorability", "pronounceability"])
    assert pairs.count() == 12 and pairs.distinct().count() == 12
    assert pairs.where("competitor_1 < competitor_2").count() == 6
    with pytest.raises(ValueError):
        R.all_pairs(names, "name", ["x"], max_competitors=2)


def chat(spark):
    turns = []
    for i in range(3):
        if i == 0:
            turns.append((1, 0, "system", 5000))
        turns += [(1, 2 * i + 1, "user", 50), (1, 2 * i + 2, "assistant", 300)]
    return spark.createDataFrame(turns + [(2, 0, "user", 10)], "conv INT, turn INT, role STRING, tokens LONG")


def test_chat_billing(spark):
    calls = B.chat_calls(chat(spark), "conv", "turn", "role", "tokens", block_turns=2)
    rows = B.chat_billing(calls).orderBy("call").collect()
    assert [(r["cached"], r["fresh"], r["output"]) for r in rows] == [(0, 5050, 300), (5350, 50, 300), (5700, 50, 300)]
    assert [round(r["cost"], 6) for r in rows] == [0.03425, 0.011925, 0.0121]
    total = B.one_call_comparison(calls, "conv").first()
    assert round(total["cost"], 6) == 0.058275 and round(total["cost_one_call"], 6) == 0.05275
    assert round(1 - total["cost_one_call"] / total["cost_uncached"], 2) == 0.51


def test_prices(spark):
    assert round(B.blended_price(B.Price()), 6) == 4.35
    row = spark.range(1).select(
        B.tiered_cost(F.lit(272_000), F.lit(0)).alias("low"), B.tiered_cost(F.lit(272_001), F.lit(0)).alias("high"),
        B.tiered_cost(F.lit(1000), F.lit(1000), batch=True).alias("batch"),
        B.Price(10, 1, 30).cost(F.lit(11), F.lit(0), F.lit(0)).alias("ask"), B.Price(10, 1, 30).cost(F.lit(0), F.lit(0), F.lit(5)).alias("say"),
        B.break_even_reads(F.lit(3.0), F.lit(3.75), F.lit(0.3), F.lit(0.0)).alias("reads"),
    ).first()
    assert (round(row["low"], 6), round(row["high"], 5)) == (1.36, 2.72001)
    assert round(row["batch"], 6) == 0.0175 and round(row["ask"], 7) == 0.00011 and round(row["say"], 7) == 0.00015
    assert row["reads"] == 1


def test_image_tokens(spark):
    row = spark.range(1).select(S.image_tokens(F.lit(1024), F.lit(1024)), S.image_tokens(F.lit(1024), F.lit(1024), "low")).first()
    assert tuple(row) == (765, 85)


def test_set_scores(spark):
    df = spark.createDataFrame([(["A", "b"], ["a", "B"]), ([], []), (["a"], []), (["a"], ["b"])], "g ARRAY<STRING>, p ARRAY<STRING>")
    c = M.set_counts(F.col("g"), F.col("p"))
    scored = df.select(*[v.alias(k) for k, v in c.items()])
    f1 = scored.select(M.set_f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f")).collect()
    assert [r["f"] for r in f1] == [1.0, 1.0, 0.0, 0.0]
    micro = M.micro_precision_recall(scored).first()
    assert (micro["tp"], micro["fp"], micro["fn"]) == (2, 1, 2)


def test_unpivot(spark):
    wide = spark.createDataFrame([(f"m{i}", 0.8, 0.7, 0.6, 0.5) for i in range(6)], "model STRING, pass_1 DOUBLE, pass_2 DOUBLE, pass_3 DOUBLE, pass_4 DOUBLE")
    long = R.wide_to_long(wide, ["model"], [f"pass_{k}" for k in range(1, 5)], "k", "score").withColumn(
        "k", F.regexp_extract("k", r"(\d+)", 1).cast("int")
    )
    assert long.count() == 24 and {r["k"] for r in long.select("k").distinct().collect()} == {1, 2, 3, 4}


def test_js_date(spark):
    text = "Tue Nov 14 2023 17:23:29 GMT+0100 (Central European Standard Time)"
    day = F.to_date(F.regexp_extract(F.lit(text), r"([A-Z][a-z]{2} \d{2} \d{4})", 1), "MMM d yyyy")
    assert str(spark.range(1).select(day).first()[0]) == "2023-11-14"


def test_iob(spark):
    tags = ["B-PER", "O", "O", "I-LOC", "O", "B-LOC", "I-LOC", "B-PER"]
    words = ["Paul", "lives", "in", "stray", ",", "New", "York", "Ann"]
    df = spark.createDataFrame([(1, i, w, t) for i, (w, t) in enumerate(zip(words, tags))], "doc INT, pos INT, token STRING, tag STRING")
    got = W.iob_spans(df, "doc", "pos", "token", "tag", block_tokens=2).orderBy("start").collect()
    assert [(r["start"], r["label"], r["entity"]) for r in got] == [(0, "PER", "Paul"), (5, "LOC", "New York"), (7, "PER", "Ann")]


def test_clip_keeps_null_and_night_hours(spark):
    df = spark.createDataFrame([(-3,), (None,), (4,)], "x INT")
    assert [r[0] for r in df.select(S.clip_lower(F.col("x"))).collect()] == [0, None, 4]
    hours = spark.createDataFrame([(23,), (5,), (6,), (12,), (18,)], "h INT")
    assert [r[0] for r in hours.select(S.daytime(F.col("h"))).collect()] == ["Night", "Night", "Morning", "Afternoon", "Evening"]
    assert [r[0] for r in hours.select(S.daytime(F.col("h"), as_published=True)).collect()][:2] == ["Evening", "Evening"]


def test_ties_and_pivot_cells(spark):
    df = spark.createDataFrame([("a", 5), ("b", 4), ("c", 4), ("d", 1)], "k STRING, n INT")
    assert R.top_n_with_ties(df, "n", 2).count() == 3
    cells = spark.createDataFrame([(1, "x", 1), (1, "x", 2)], "i INT, c STRING, v INT")
    with pytest.raises(PySparkException):
        R.long_to_wide(cells, "i", "c", "v", ["x"]).collect()


def test_search_rejects_unknown_fields(spark):
    df = spark.createDataFrame([(1, "Germany"), (2, "France")], "id INT, country STRING")
    fields = {"id": "number", "country": "text"}
    assert R.search_by_field(df, fields, "country", "germany").first()["id"] == 1
    assert R.search_by_field(df, fields, "id", "2").count() == 1
    with pytest.raises(ValueError):
        R.search_by_field(df, fields, "name", "x")


def test_answers_errors_and_repair(spark):
    good = {"topics": ["ARTS"], "sentiment": "NEUTRAL", "named_entities": [{"text": "x", "label": "ORG"}]}
    cases = [
        json.dumps(good), "{broken", json.dumps({**good, "topics": ["ARTS", "LOCAL"]}), json.dumps({**good, "sentiment": "MIXED"}),
        json.dumps({**good, "named_entities": None}), json.dumps({**good, "topics": "ARTS"}), json.dumps({**good, "topics": []}),
    ]
    df = spark.createDataFrame(list(enumerate(cases)), "id INT, answer STRING")
    parsed = N.parse_answers(df, "answer")
    flags = {r["id"]: (r["parse_error"], r["validation_error"]) for r in parsed.collect()}
    assert flags == {0: (False, False), 1: (True, False), 2: (False, True), 3: (False, True), 4: (False, True), 5: (False, True), 6: (False, False)}
    usable, bad = N.split_valid(N.repair_answers(parsed))
    assert {r["id"] for r in usable.collect()} == {0, 2, 6} and bad.count() == 4


def test_explode_of_empty_list_gives_null_row(spark):
    df = spark.createDataFrame([(1, []), (2, ["a"])], "id INT, xs ARRAY<STRING>")
    assert df.select("id", F.explode_outer("xs").alias("x")).count() == 2


def test_requests_split_and_truncate(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (2, "x"), (3, "")], "id INT, text STRING")
    split = X.build_requests(df, "text", "sys", 2).orderBy("id", "part").collect()
    said = [json.loads(r["request"])["messages"][1]["content"] for r in split]
    assert said == ["a b", "c d", "e", "x", ""]
    cut = X.build_requests(df, "text", "sys", 2, long_text="truncate").orderBy("id").collect()
    assert [json.loads(r["request"])["messages"][1]["content"] for r in cut] == ["a b", "x", ""]


def test_labelled_lines_and_lists(spark):
    df = spark.createDataFrame([("PERSON: Ann, Bob\nORG: \nnothing here",)], "a STRING")
    got = {(r["label"], r["entity"]) for r in X.parse_labelled_lines(df, "a").collect()}
    assert got == {("PERSON", "Ann"), ("PERSON", "Bob")}
    listed = spark.createDataFrame([("Ann Lee (PERSON), Acme (ORG)",)], "a STRING")
    assert [(r["label"], r["entity"]) for r in X.parse_labelled_list(listed, "a").collect()] == [("PERSON", "Ann Lee"), ("ORG", "Acme")]


def test_chunks_cover_every_word(spark):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(251))), (2, "one"), (3, "")], "id INT, text STRING")
    rows = X.chunks(df, "id", "text", 100, 20).orderBy("id", "chunk").collect()
    seen = {w for r in rows if r["id"] == 1 for w in r["chunk_text"].split()}
    assert len(seen) == 251 and max(r["n_words"] for r in rows) == 100
    assert [r["id"] for r in rows].count(2) == 1


def test_split_overlap_brute_force(spark):
    train = [(1, "the quick brown fox jumps"), (2, "A B c"), (3, "nothing shared at all"), (4, "brown fox jumps the quick brown fox")]
    held = ["quick BROWN fox", "a b c"]
    got = X.split_overlap(
        spark.createDataFrame(train, "id INT, text STRING"), "id", "text", spark.createDataFrame([(h,) for h in held], "t STRING"), "t", n=3
    ).collect()
    assert {(r["id"], r["same_text"], r["shared_ngrams"]) for r in got} == {(1, False, 1), (2, True, 1), (4, False, 1)}


def test_ngram_overlap(spark):
    df = spark.createDataFrame([(1, "the the the cat", "the cat"), (2, "x", "y"), (3, "a b", "")], "id INT, c STRING, r STRING")
    got = {r["id"]: r for r in X.ngram_overlap(df, ["id"], "c", "r", 1).collect()}
    assert (got[1]["precision"], got[1]["recall"]) == (0.5, 1.0)
    assert got[2]["f1"] == 0.0 and got[3]["recall"] == 0.0


def test_backlinks(spark):
    pages = spark.createDataFrame([
        (1, "http://a.org/x", '<a href="/y">y</a><a href="/y">y</a><a href="http://b.org/z?q=1">z</a><a href="#top">t</a>'),
        (2, "http://a.org/y", '<a href="/y">self</a>'), (3, "http://b.org/z", ""),
    ], "page_id INT, url STRING, html STRING")
    edges = X.link_edges(pages)
    assert edges.count() == 4
    nodes = pages.select("page_id", F.regexp_extract("url", "//([^/]+)", 1).alias("host"), F.regexp_extract("url", "//[^/]+(/.*)", 1).alias("path"))
    backlinks, orphans = X.link_report(edges, nodes)
    assert {(r["to_page"], r["linking_pages"], r["links"]) for r in backlinks.collect()} == {(2, 1, 2), (3, 1, 1)}
    assert [r["page_id"] for r in orphans.collect()] == [1]


def test_redirect_and_noise(spark):
    urls = spark.createDataFrame([(1, "/old"), (2, "/keep")], "id INT, url STRING")
    moved = spark.createDataFrame([("/old", "/new")], "source STRING, target STRING")
    assert {r["final_url"] for r in R.redirect(urls, "url", moved).collect()} == {"/new", "/keep"}
    rows = spark.range(200).select("id", (F.col("id") % 2).cast("int").alias("label"))
    noisy = L.label_noise(rows, "label", "id", 0.1, "s")
    assert noisy.where("label <> noisy").groupBy("label").count().collect() == noisy.where("flipped").groupBy("label").count().collect()
    assert noisy.where("flipped").count() == 20


def test_ols_and_t_test(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 2))
    y = 3 + x @ np.array([2.0, -1.0]) + rng.normal(size=200)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a DOUBLE, b DOUBLE, y DOUBLE")
    fit = {r["term"]: r for r in A.ols(df, "y", ["a", "b"]).collect()}
    design = np.column_stack([x, np.ones(200)])
    coef, sse = np.linalg.lstsq(design, y, rcond=None)[:2]
    se = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * sse[0] / 197)
    for i, term in enumerate(["a", "b", "intercept"]):
        assert abs(fit[term]["coef"] - coef[i]) < 1e-9 and abs(fit[term]["se"] - se[i]) < 1e-9
        assert abs((fit[term]["high"] - fit[term]["low"]) / 2 / se[i] - 1.972079) < 1e-5
    two = df.select("y", (F.col("a") > 0).alias("g"))
    test = A.t_test(two, "y", F.col("g"))
    slope = [r for r in A.ols(two, "y", ["g"]).collect() if r["term"] == "g"][0]
    assert abs(test.first()["t"] - slope["t"]) < 1e-9 and abs(test.first()["p"] - slope["p"]) < 1e-9


def test_student_p_of_known_values(spark):
    # tabled two-sided 5 % points, and the exact values of one and two degrees of freedom
    cases = [(12.7062047, 1, 0.05), (4.3026527, 2, 0.05), (2.2281389, 10, 0.05), (1.9623391, 1000, 0.05), (1.0, 1, 0.5), (0.0, 7, 1.0)]
    df = spark.createDataFrame([(t, float(v), p) for t, v, p in cases], "t DOUBLE, v DOUBLE, p DOUBLE")
    for r in df.select("t", "v", "p", A.student_p(F.col("t"), F.col("v")).alias("got"), A.student_p(-F.col("t"), F.col("v")).alias("other")).collect():
        assert abs(r["got"] - r["p"]) < 1e-7 and r["got"] == r["other"]
        if 0 < r["p"] < 1:
            assert abs(A.student_limit(1 - r["p"], r["v"]) - r["t"]) < 1e-5 * r["t"]


def test_entities_are_counted_by_text_and_label(spark):
    rows = [([("a", "ORG"), ("a", "ORG")],), ([("a", "PERSON"), ("b", "ORG"), ("c", "ORG")],), (None,), ([],)]
    df = spark.createDataFrame(rows, "entities ARRAY<STRUCT<text: STRING, label: STRING>>")
    got = {(r["label"], r["text"]): (r["n"], r["rank"]) for r in N.entity_counts(df, 2).collect()}
    assert got == {("ORG", "a"): (2, 1), ("ORG", "b"): (1, 2), ("PERSON", "a"): (1, 1)}


def test_bradley_terry_order_and_fit(spark):
    rng = np.random.default_rng(2)
    true = {"a": 4.0, "b": 2.0, "c": 1.0}
    rows = []
    for _ in range(3000):
        i, j = rng.choice(list(true), 2, replace=False)
        rows.append((str(i), str(j), 1 if rng.random() < true[i] / (true[i] + true[j]) else 2))
    matches = spark.createDataFrame(rows, "competitor_1 STRING, competitor_2 STRING, preferred INT")
    r = {x["competitor"]: x["strength"] for x in M.bradley_terry(matches, tolerance=1e-9).collect()}
    assert abs(np.mean(list(r.values())) - 1) < 1e-9
    assert abs(r["a"] / r["b"] - 2) < 0.4 and abs(r["b"] / r["c"] - 2) < 0.4


def test_metrics_without_positives(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2)], "y INT, p DOUBLE")
    row = M.binary_metrics(df, "y", "p").first()
    assert (row["accuracy"], row["precision"], row["recall"], row["f1"]) == (1.0, 0.0, 0.0, 0.0)
    agree = spark.createDataFrame([(1, 1), (1, 1)], "a INT, b INT")
    assert M.annotator_agreement(agree, "a", "b").first()["kappa"] == 0.0


def test_vectors(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, [float(v) for v in row], i % 3) for i, row in enumerate(x)], "id LONG, e ARRAY<DOUBLE>, g INT")
    queries = df.where("id in (5, 7)").select(F.col("id").alias("query_id"), "e")
    for metric in ("l2", "cosine"):
        got = V.vector_topk(df.repartition(4), queries, "id", "e", 4, metric).orderBy("query_id", "rank").collect()
        for q in (5, 7):
            d = np.linalg.norm(x - x[q], axis=1) if metric == "l2" else 1 - x @ x[q] / np.linalg.norm(x, axis=1) / np.linalg.norm(x[q])
            assert [r["id"] for r in got if r["query_id"] == q] == list(np.argsort(d, kind="stable")[:4])
    near = V.vector_ann(df, queries, "id", "e", 4, tables=16).collect()
    assert {(r["query_id"], r["id"]) for r in near} >= {(5, 5), (7, 7)} and len(near) == 8
    tight = V.vector_ann(df, queries, "id", "e", 4, bucket_length=1e-6).collect()  # buckets hold the query alone
    exact = V.vector_topk(df, queries, "id", "e", 4).collect()
    assert {(r["query_id"], r["id"], r["rank"]) for r in tight} == {(r["query_id"], r["id"], r["rank"]) for r in exact}
    sim = V.mean_similarity_to_earlier(df, "g", "id", "e", 8, F.floor(F.col("id") / 16)).orderBy("id").collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in (0, 1, 2, 50, 299):
        earlier = [j for j in range(i) if j % 3 == i % 3]
        assert sim[i]["earlier"] == len(earlier)
        if earlier:
            assert abs(sim[i]["similarity"] - np.mean(unit[earlier] @ unit[i])) < 1e-9
        else:
            assert sim[i]["similarity"] is None


def test_rules_count_nulls_as_broken(spark):
    df = spark.createDataFrame([(1,), (None,), (-1,)], "x INT")
    assert Q.rule_violations(df, "t", {"positive": F.col("x") > 0}).first()["violations"] == 2


def test_fingerprint_ignores_order_and_sees_changes(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id INT, s STRING")
    one = A.fingerprint(df, ["id", "s"]).first()
    assert A.fingerprint(df.orderBy(F.desc("id")), ["id", "s"]).first() == one
    assert A.fingerprint(df.na.fill("b"), ["id", "s"]).first() != one


def test_growth_of_zero_start_is_null(spark):
    df = spark.createDataFrame([(1, 1, 0.0), (1, 2, 5.0), (1, 3, 10.0)], "k INT, t INT, v DOUBLE")
    row = A.ohlc(df, ["k"], ["t"], "v", F.lit(0)).first()
    assert row["growth"] is None and row["volatility"] == 0.0 and row["trading_days"] == 3


def test_iob_spans_of_lists_are_those_of_tokens_without_a_shuffle(spark):
    rng = random.Random(5)
    texts = [(i, [rng.choice(["B-PER", "B-LOC", "I-PER", "I-LOC", "O"]) for _ in range(rng.randint(0, 30))]) for i in range(40)] + [(100, ["I-PER"]), (101, ["B-LOC", "I-LOC"]), (102, None)]
    df = spark.createDataFrame([(i, tags and [f"w{j}" for j in range(len(tags))], tags) for i, tags in texts], "doc INT, tokens ARRAY<STRING>, tags ARRAY<STRING>")
    each = df.select("doc", F.posexplode(F.arrays_zip("tokens", "tags")).alias("pos", "x")).select("doc", "pos", F.col("x.tokens").alias("token"), F.col("x.tags").alias("tag"))
    found = W.iob_spans_of_lists(df, "doc", "tokens", "tags")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, W.iob_spans(each, "doc", "pos", "token", "tag", block_tokens=4).collect()))


def test_words_are_counted_in_their_row_where_ids_are_unique(spark):
    texts = [(1, "The cat the DOG cat the"), (2, ""), (3, None), (None, "x x"), (4, "z")]
    df = spark.createDataFrame(texts, "doc INT, text STRING")
    counts = X.term_counts(df, "doc", "text")
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    want = Counter((i, w) for i, text in texts for w in (text or "").lower().split())
    assert {(r.doc, r.term): r.tf for r in counts.collect()} == want
    twice = X.term_counts(df.unionAll(df.where("doc = 1 OR doc IS NULL")), "doc", "text")
    assert {(r.doc, r.term): r.tf for r in twice.collect()} == {k: n * (2 if k[0] in (1, None) else 1) for k, n in want.items()}
