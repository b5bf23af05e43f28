"""Hand-made frames for cases that the tables do not hold."""

import math
import random

import pytest
from pyspark.sql import functions as F

from larkspur.operators import metrics as M, ordering as O, relational as R, stats as A, text as X, vectors as V
from larkspur.streaming.collector import Collector


def test_short_texts_overlap(spark):
    train = spark.createDataFrame([(1, "Hello, world"), (2, "hello there"), (3, "?!"), (4, "a b c d e f g h i"), (5, None)], "id INT, t STRING")
    held = spark.createDataFrame([("hello world",), ("x a b c d e f g h y",), ("",), (None,)], "t STRING")
    got = {tuple(r) for r in X.split_overlap(train, "id", "t", held, "t").collect()}
    assert got == {(1, True, 0), (4, False, 1)}


LINKS = {
    "/root": ("h.org", "/root"), "next.html": ("h.org", "/a/b/next.html"), "./k": ("h.org", "/a/b/k"), "../z?q#f": ("h.org", "/a/z"),
    "../../../up": ("h.org", "/up"), "..": ("h.org", "/a/"), "//cdn.org/q": ("cdn.org", "/q"), "https://x.org/p?r": ("x.org", "/p"),
    "?page=2": ("h.org", "/a/b/c"), "sub/./d/../e": ("h.org", "/a/b/sub/e"),
}


def test_links_are_resolved(spark):
    for quote in "\"'":
        html = "".join(f"<a href={quote}{x}{quote}>x</a>" for x in [*LINKS, "#top", "mailto:a@b.c", "javascript:void(0)"])
        pages = spark.createDataFrame([(1, "http://h.org/a/b/c?x=1", html)], "page_id INT, url STRING, html STRING")
        got = [(r.to_host, r.to_path) for r in X.link_edges(pages).collect()]
        assert got == list(LINKS.values())


def test_backlinks_follow_relative_links(spark):
    pages = spark.createDataFrame([(1, "http://h.org/a/x.html", "<a href='y.html'>"), (2, "http://h.org/a/y.html", "")], "page_id INT, url STRING, html STRING")
    places = spark.createDataFrame([(1, "h.org", "/a/x.html"), (2, "h.org", "/a/y.html")], "page_id INT, host STRING, path STRING")
    back, orphans = X.link_report(X.link_edges(pages), places)
    assert [r.to_page for r in back.collect()] == [2] and [r.page_id for r in orphans.collect()] == [1]


@pytest.mark.parametrize("value", ["c", None])
def test_unlisted_pivot_value_raises(spark, value):
    rows = spark.createDataFrame([(1, "a", 5), (1, value, 6)], "i INT, c STRING, v INT")
    with pytest.raises(Exception, match="not among the known columns"):
        R.long_to_wide(rows, "i", "c", "v", ["a", "b"]).collect()
    assert R.long_to_wide(rows.limit(1), "i", "c", "v", ["a", "b"]).collect() == [(1, 5, None)]


def test_vectors_of_another_size_raise(spark):
    rows = spark.createDataFrame([(1, "g", [1.0, 0.0, 2.0]), (2, "g", [1.0, 1.0, 0.0])], "id LONG, g STRING, v ARRAY<FLOAT>")
    with pytest.raises(Exception, match="does not have 2 entries"):
        V.mean_similarity_to_earlier(rows, "g", "id", "v", 2, F.lit(0)).collect()
    got = {r.id: r.similarity for r in V.mean_similarity_to_earlier(rows, "g", "id", "v", 3, F.lit(0)).collect()}
    assert got[1] is None and math.isclose(got[2], 1 / math.sqrt(10), rel_tol=1e-6)


def test_shift_with_a_null_category(spark):
    whole = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "c STRING")
    got = {r.category: (r.part_share, r.whole_share) for r in A.distribution_shift(whole.where("c IS NULL OR c = 'b'"), whole, "c").collect()}
    assert got == {"a": (0.0, 0.5), "b": (0.5, 0.25), None: (0.5, 0.25)}


def test_series_with_leading_and_trailing_nulls(spark):
    rows = spark.createDataFrame([(1, None), (2, 4.0), (3, 5.0), (4, None)], "at LONG, v DOUBLE").withColumn("k", F.lit("s"))
    r = A.ohlc(rows, ["k"], ["at"], "v", F.lit(0)).first()
    assert (r.first, r.last, r.growth, r.trading_days) == (4.0, 5.0, 0.25, 2)


def test_fingerprint_keeps_columns_apart(spark):
    def of(*row):
        return A.fingerprint(spark.createDataFrame([row], "x STRING, y STRING"), ["x", "y"]).first().fingerprint

    rows = [("a|b", "c"), ("a", "b|c"), (None, "c"), ("null;", "c"), ("", "c"), ("a", None)]
    assert len({of(*r) for r in rows}) == len(rows)


def test_agreement_of_very_many_rows(spark, monkeypatch):
    rows = spark.createDataFrame([("x", "x"), ("x", "y"), ("y", "y")], "a STRING, b STRING")
    r = M.annotator_agreement(rows, "a", "b").first()
    assert math.isclose(r.expected, (2 * 1 + 1 * 2) / 9) and math.isclose(r.observed, 2 / 3)


def test_top_k_beyond_a_thousand(spark):
    rows = spark.range(3000).select(F.lit("k").alias("k"), "id")
    got = O.top_k(rows, ["k"], [F.desc("id")], 1500)
    assert got.count() == 1500 and got.agg(F.min("id")).first()[0] == 1500


def test_running_sum_over_ids_far_apart(spark):
    random.seed(1)
    ids = random.sample(range(1 << 62), 20_000)
    rows = spark.createDataFrame([(i,) for i in ids], "id LONG")
    block = O.range_block(rows, "id", 64)
    assert 50 < rows.select(block.alias("b")).distinct().count() <= 64
    got = {r.id: r.n for r in O.running_sum(rows, [], ["id"], F.lit(1), "n", block).collect()}
    assert got == {i: n for n, i in enumerate(sorted(ids), 1)}


def test_more_query_vectors_than_a_slice(spark, monkeypatch):
    monkeypatch.setattr(V, "SLICE", 3)
    rows = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(10)], "vec_id LONG, embedding ARRAY<FLOAT>")
    queries = rows.select(F.col("vec_id").alias("query_id"), "embedding")
    got = {(r.query_id, r.rank): r.id for r in V.vector_topk(rows, queries, "vec_id", "embedding", 2).collect()}
    assert all(got[i, 1] == i for i in range(10)) and len(got) == 20 and got[0, 2] == 1


def test_collector_takes_ids_out_of_order(spark, tmp_path):
    source = tmp_path / "in"
    for i, ids in enumerate([[1, 3, 5], [2, 6], [4, 6, 7]]):
        spark.createDataFrame([("k", x, 100 + x) for x in ids], "key STRING, id LONG, ts LONG").coalesce(1).write.mode("append").parquet(str(source))
    collector = Collector(str(tmp_path / "out"), "key", "id", "ts")
    stream = spark.readStream.schema("key STRING, id LONG, ts LONG").option("maxFilesPerTrigger", 1).parquet(str(source))
    collector.start(stream, availableNow=True).awaitTermination()
    assert sorted(r.id for r in collector.rows(spark).collect()) == [1, 2, 3, 4, 5, 6, 7]
    assert collector.state(spark).first().collected == 7 and collector.state(spark).first().since_id == 7


def test_numbered_copies(spark):
    from larkspur.operators.text import numbered_copies

    df = spark.createDataFrame([("a", 3), ("b", 0), ("c", 25), ("d", 10)], "id string, n int")
    rows = numbered_copies(df, "n", "copy", run=10).collect()
    assert sorted((r.id, r["copy"]) for r in rows) == [*(("a", i) for i in range(3)), *(("c", i) for i in range(25)), *(("d", i) for i in range(10))]


def test_ctas_leaves_no_table(spark):
    from larkspur.plans import QUERIES

    before = {t.name for t in spark.catalog.listTables()}
    assert QUERIES["ctas_cast"](spark, "/root/testdata/sf0.001").count() > 0
    assert {t.name for t in spark.catalog.listTables()} == before
