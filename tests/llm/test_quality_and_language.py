import re
import zlib
from collections import Counter

import numpy as np
import pytest

from larkspur.llm import language as la, quality as q

DATA = "/root/testdata/sf0.01"


def brute_stats(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


@pytest.mark.parametrize("table", ["documents", "odd"])
def test_statistics_same_as_brute_force(spark, documents, odd_docs, table):
    docs = (documents if table == "documents" else odd_docs).select("doc_id", "text")
    for r in docs.withColumn("s", q.rule_stats("text")).collect():
        assert tuple(r.s) == brute_stats(r.text), r.doc_id


def test_verdicts_on_labelled_rows(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{x}.parquet") for x in ("documents", "labels"))
    table = q.quality(docs, labels).join(q.labelled(labels), "doc_id").toPandas()
    passed = table[~table.base_failed]
    assert passed[passed.quality == 1].kept.mean() > 0.98
    assert passed[passed.quality == 0].kept.mean() < 0.4
    assert not table[table.base_failed].kept.any()


def test_forest_isolates_a_far_row():
    rows = np.random.default_rng(4).normal(size=(2000, 3))
    forest = q.IsolationForest(np.concatenate([rows, [[9, 9, 9]]]))
    scores = forest.score(np.array([[9.0, 9, 9], [0, 0, 0]]))
    assert scores[0] > scores[1] + 0.1
    assert abs(float(q.mean_depth(256)) - 10.24) < 0.05


def test_odd_rows_of_quality(spark, odd_docs, odd_labels):
    out = {(r.doc_id, r.n_words): r for r in q.quality(odd_docs, odd_labels).collect()}
    assert out[(2, 0)].base_failed and not out[(2, 0)].kept and out[(1, 14)].n_repeat_words == 0
    kept = q.keep_good(odd_docs, odd_labels)
    assert kept.columns == odd_docs.columns
    assert q.keep_good(odd_docs, odd_labels.limit(0)).where("doc_id = 1").count() == 2  # only the base rules decide
    assert q.quality(odd_docs.limit(0), odd_labels).count() == 0
    assert q.labelled(odd_labels).count() == 2  # 8 has contradicting labels, 6 none


def substrings_match(sample, text):
    """Phrases by the definition: the longest prefix of the rest that the sample holds, at least one character."""
    n, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at:at + size + 1] in sample:
            size += 1
        at += size
        n += 1
    return n


def test_phrases_same_as_brute_force():
    import pyarrow as pa
    from larkspur.llm.arrays import chunks

    samples = {"x": b"the cat sat on the mat and the dog ran", "y": "der hund läuft über die straße".encode()}
    parser = la.Parser(samples)
    texts = ["the dog sat", "die katze läuft", "", "zzz", "the cat sat on the mat and the dog ran " * 40]
    coded = {k: parser.classes[np.frombuffer(v, np.uint8)].tobytes() for k, v in samples.items()}
    got = np.concatenate([parser.phrases(part) for part in chunks(pa.array(texts))])
    for i, text in enumerate(texts):
        code = parser.classes[np.frombuffer(text.encode(), np.uint8)].tobytes()
        pieces = [code[a:a + la.PIECE] for a in range(0, len(code), la.PIECE)]
        for k, name in enumerate(parser.languages):
            assert got[i, k] == sum(substrings_match(coded[name], p) for p in pieces), (text[:20], name)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = la.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in out.doc_id]).all()
    assert (out[out.held_out].lang == out[out.held_out].lang_pred).mean() > 0.98
    assert out.score.between(0, 1).all()


def test_odd_rows_of_language(spark, odd_docs):
    out = [(r.doc_id, r.lang_pred, r.score) for r in la.language_id(odd_docs).collect()]
    assert len(out) == odd_docs.count()
    assert {x for x in out if x[0] in (2, 3, 4, 7)} == {(i, "und", 0.0) for i in (2, 3, 4, 7)}
    assert la.language_id(odd_docs.limit(0)).count() == 0
    unlabelled = la.language_id(odd_docs.selectExpr("doc_id", "text", "cast(null AS string) AS lang"))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}
