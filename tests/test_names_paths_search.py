"""Names of several words, paths of whole sessions, and the kept search index, against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import DataFrameWriter, functions as F

from larkspur.operators import names as names_module
from larkspur.operators.names import NameTrie, name_hits, name_mentions
from larkspur.operators.paths import session_paths
from larkspur.operators.search_index import SearchIndex

# ---- names -----------------------------------------------------------------------------------


def brute_hits(text, names):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    hits = [(i, n, " ".join(words[i:i + n])) for i in range(len(words)) for n in range(1, 8) if i + n <= len(words) and " ".join(words[i:i + n]) in names]
    return [h for h in hits if not any(o != h and o[0] <= h[0] and h[0] + h[1] <= o[0] + o[1] for o in hits)]


def random_texts(seed, n):
    rng = random.Random(seed)
    return [" ".join(rng.choices("a b c d".split(), k=rng.randint(0, 40))) for _ in range(n)]


def random_names(seed, n):
    rng = random.Random(seed)
    return sorted({" ".join(rng.choices("a b c d".split(), k=rng.randint(1, 5))) for _ in range(n)})


def test_trie_finds_what_brute_force_finds():
    names = random_names(1, 60)
    trie = NameTrie(names)
    for text in random_texts(2, 200):
        assert trie.find(text.split(" ")) == brute_hits(text, set(names))


@pytest.mark.parametrize("shard", [1 << 20, 40])
def test_hits_in_one_and_in_many_parts(spark, shard):
    names = ["New York", "new  YORK city", "York", "city of dreams", "city", "of", "", None, "!!", "Été à la plage", "york"] + random_names(3, 30)
    texts = ["I love New York City of dreams", "new york, new york!", "", None, "été à la plage / of", "a b c d a b"] + random_texts(4, 40)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(1, texts[1])], "doc_id long, text string")
    got = Counter((r.id, r.start, r.n_words, r.name) for r in name_hits(df, "doc_id", "text", spark.createDataFrame([(n,) for n in names], "n string"), "n", shard).collect())
    known = {" ".join(re.findall(r"[^\W_]+", (n or "").lower())) for n in names} - {""}
    want = Counter((i, *h) for i, t in [*enumerate(texts), (1, texts[1])] for h in brute_hits(t, known))
    assert got == want and (0, 2, 3, "new york city") in got and (0, 4, 3, "city of dreams") in got


def test_mentions_per_name(spark):
    df = spark.createDataFrame([(1, "red car, red car"), (2, "red car"), (3, "red")], "doc_id long, text string")
    names = spark.createDataFrame([("red",), ("red car",)], "n string")
    got = {(r.name, r.n_words, r.mentions, r.texts) for r in name_mentions(name_hits(df, "doc_id", "text", names, "n")).collect()}
    assert got == {("red car", 2, 3, 2), ("red", 1, 1, 1)}
    assert name_hits(df, "doc_id", "text", names.where("false"), "n").collect() == []


# ---- paths -----------------------------------------------------------------------------------


def brute_paths(rows, goal):
    sessions = defaultdict(list)
    for user, at, step in rows:
        sessions[user].append((at, step or "null"))
    out = defaultdict(lambda: [0, 0, 0])
    for steps in sessions.values():
        names = [s for _, s in sorted(steps)]
        won = goal in names
        taken = names[:names.index(goal)] if won else names
        entry = out[" > ".join(taken)]
        entry[0], entry[1], entry[2] = len(taken), entry[1] + 1, entry[2] + won
    return {(path, *entry) for path, entry in out.items()}


@pytest.mark.parametrize("piece", [1024, 2])
def test_paths_of_whole_sessions(spark, piece):
    rng = random.Random(3)
    rows = [(rng.choice([*range(40), None]), i, rng.choice(["view", "click", "buy", "error", None])) for i in range(300)]
    rows += [(1000, 500 + i, "view") for i in range(700)] + [(2000, 1, "buy"), (3000, 2, "view")]
    df = spark.createDataFrame(rows, "user long, at long, step string")
    got = session_paths(df, ["user"], ["at"], "step", "buy", F.expr("at div 50"), piece).collect()
    assert {(r.path, r.n_steps, r.n, r.n_goal) for r in got} == brute_paths(rows, "buy") and len(got) == len(brute_paths(rows, "buy"))
    assert session_paths(df.where("false"), ["user"], ["at"], "step", "buy", F.expr("at div 50")).collect() == []


# ---- search ----------------------------------------------------------------------------------


def brute_ranked(texts, query, k, k1=1.2, b=0.75):
    docs = {i: re.findall(r"[^\W_]+", (t or "").lower()) for i, t in texts}
    docs = {i: w for i, w in docs.items() if w}
    mean = sum(map(len, docs.values())) / len(docs)
    scores = {}
    for term, times in Counter(re.findall(r"[^\W_]+", query.lower())).items():
        holding = [i for i, w in docs.items() if term in w]
        weight = math.log(1 + (len(docs) - len(holding) + 0.5) / (len(holding) + 0.5))
        for i in holding:
            tf = docs[i].count(term)
            scores[i] = scores.get(i, 0) + times * weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(docs[i]) / mean))
    return sorted(((i, round(s, 6)) for i, s in scores.items()), key=lambda x: (-round(scores[x[0]], 9), x[0]))[:k]


def brute_phrases(texts, query):
    want = re.findall(r"[^\W_]+", query.lower())
    out = {}
    for i, t in texts:
        words = re.findall(r"[^\W_]+", (t or "").lower())
        hits = sum(words[a:a + len(want)] == want for a in range(len(words) - len(want) + 1)) if want else 0
        if hits:
            out[i] = hits
    return out


QUERIES = [(1, "a"), (2, "b c"), (3, "d d a"), (4, "nowhere"), (5, ""), (6, "a b a b"), (7, "rare word"), (8, "word")]


@pytest.mark.parametrize("block", [4096, 3])
def test_search_against_brute_force(spark, tmp_path, block):
    texts = [(i * 7 - 50, t) for i, t in enumerate(random_texts(8, 60) + ["", None, "Rare word here", "a rare, rare word a word", "x" * 3000])]
    index = SearchIndex(spark, str(tmp_path / "index"), buckets=8)
    asked = spark.createDataFrame(QUERIES, "query_id long, query string")

    def check(index, texts):
        ranked, found = defaultdict(list), defaultdict(dict)
        for r in index.ranked(asked, 5).orderBy("query_id", "rank").collect():
            ranked[r.query_id].append((r.id, round(r.score, 6)))
        for r in index.phrases(asked).collect():
            found[r.query_id][r.id] = r.hits
        for number, query in QUERIES:
            assert ranked[number] == brute_ranked(texts, query, 5), query
            assert found[number] == brute_phrases(texts, query), query

    index.add(spark.createDataFrame([*texts, (None, "a b")], "doc_id long, text string"), "doc_id", "text", 0, block)
    check(index, texts)
    more = [(10_000 + i, t) for i, t in enumerate(random_texts(9, 25) + ["rare word"])]
    index.add(spark.createDataFrame(more, "doc_id long, text string"), "doc_id", "text", 1, block)
    check(index, texts + more)
    check(index.merge(str(tmp_path / "merged")), texts + more)


def test_a_search_reads_the_buckets_of_its_terms_only(spark, tmp_path):
    index = SearchIndex(spark, str(tmp_path / "index"), buckets=32)
    index.add(spark.createDataFrame([(i, t) for i, t in enumerate(random_texts(8, 30))], "doc_id long, text string"), "doc_id", "text", 0)
    rows = index._postings(index._asked(spark.createDataFrame([(1, "a b")], "query_id long, query string")), False)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)


def test_a_ranked_search_leaves_its_best_of_each_group_only(spark, tmp_path, monkeypatch):
    """Copies have one score, so that ids decide; queries are dealt to parts, and no group gives more than k rows a query."""
    monkeypatch.setattr("larkspur.operators.search_index.QUERIES", 1)
    texts = [(i, "a b") for i in range(200)] + [(500, "b c a"), (501, "c")]
    index = SearchIndex(spark, str(tmp_path / "index"), buckets=4)
    index.add(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id", "text", 0, block=25)
    asked = spark.createDataFrame([("q1", "a"), ("q2", "b"), ("q3", "c")], "query_id string, query string")
    got = [tuple(r) for r in index.ranked(asked, 3).select("query_id", "id", "rank").orderBy("query_id", "rank").collect()]
    assert got == [("q1", 0, 1), ("q1", 1, 2), ("q1", 2, 3), ("q2", 0, 1), ("q2", 1, 2), ("q2", 2, 3), ("q3", 501, 1), ("q3", 500, 2)]
    groups = index._groups().count()
    assert groups > 1 and index._groups().groupBy().sum("n").first()[0] == 202
    plan = index.ranked(asked, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("FlatMapCoGroupsInArrow")


def test_a_phrase_is_looked_for_in_its_group(spark, tmp_path, monkeypatch):
    """Places are never rows of a shuffle: a phrase of frequent words is met where its words lie together."""
    monkeypatch.setattr("larkspur.operators.search_index.QUERIES", 2)
    texts = [(i, "a b " * 50 + "x" * (i % 3 == 0)) for i in range(60)] + [(100, "b a a b"), (101, None)]
    index = SearchIndex(spark, str(tmp_path / "index"), buckets=4)
    index.add(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id", "text", 0, block=9)
    queries = [(1, "b x"), (2, "a b a"), (3, "a a"), (4, "x a")]
    frame = index.phrases(spark.createDataFrame(queries, "query_id long, query string"))
    assert "FlatMapCoGroupsInArrow" in frame._jdf.queryExecution().optimizedPlan().toString()
    found = {(r.query_id, r.id): r.hits for r in frame.collect()}
    assert found == {(q, i): n for q, text in queries for i, n in brute_phrases(texts, text).items()}


def test_places_of_a_posting_are_one_list(spark, tmp_path):
    """A list for each text would take more room in a shuffle than its places; the counts cut the list, in a merged index too."""
    index = SearchIndex(spark, str(tmp_path / "index"), buckets=4)
    for segment, texts in enumerate([[(7, "a b a"), (3, "b a")], [(5, "a a a"), (1, "c")]]):
        index.add(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id", "text", segment)
    assert dict(index._read("postings").dtypes)["places"] == "array<int>"
    merged = index.merge(str(tmp_path / "merged"))
    rows = {r.term: (r.n, r.ids, r.tfs, r.lengths, r.places) for r in merged._read("postings").collect()}
    assert rows == {
        None: (4, [1, 2, 4, 6], [], [1, 2, 3, 3], []), "a": (3, [3, 2, 4], [1, 3, 2], [2, 3, 3], [1, 0, 1, 2, 0, 2]),
        "b": (2, [3, 4], [1, 1], [2, 3], [0, 1]), "c": (1, [1], [1], [1], [0])}


def test_postings_are_written_where_they_are_counted(spark, tmp_path, monkeypatch):
    """Texts are shuffled, and not what is counted of them, which is more; merging shuffles postings once."""
    plans = []

    def parquet(self, path, *args, write=DataFrameWriter.parquet, **kwargs):
        if "/postings/" in path:
            plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    monkeypatch.setattr("larkspur.operators.search_index.TASK", 2, raising=False)
    texts = [(i, f"a b w{i % 7}") for i in range(300)]
    index = SearchIndex(spark, str(tmp_path / "index"), buckets=4)
    index.add(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id", "text", 0, block=4)
    merged = index.merge(str(tmp_path / "merged"))
    assert len(plans) == 2 and all(p.count("Exchange") == 1 and "FlatMapGroupsInArrow" in p for p in plans)
    for i in (index, merged):
        assert {(r.id, r.hits) for r in i.phrases(spark.createDataFrame([(1, "b w3")], "query_id long, query string")).collect()} == {(n, 1) for n in range(3, 300, 7)}


def test_texts_are_searched_in_pieces(spark, monkeypatch):
    """Hits of a piece of a batch are held at a time, so that memory does not grow with the rows of a batch."""
    texts = ["a b c", None, "", "d" * 50, "a", "b"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["words"])
    parts = [p.column(0).to_pylist() for p in names_module.pieces(batch, "words", 5)]
    assert sum(parts, []) == texts and len(parts) == 2 and list(names_module.pieces(batch.slice(0, 0), "words", 5)) == []
    monkeypatch.setattr(names_module, "PIECE", 30)
    names, rows = random_names(1, 30), list(enumerate(random_texts(2, 80)))
    found = name_hits(spark.createDataFrame(rows, "id long, text string"), "id", "text", spark.createDataFrame([(n,) for n in names], "name string"), "name")
    want = sorted((i, *h) for i, text in rows for h in brute_hits(text, set(names)))
    assert sorted((r.id, r.start, r.n_words, r.name) for r in found.collect()) == want
