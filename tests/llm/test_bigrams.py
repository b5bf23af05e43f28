import math
import random
from collections import Counter

import numpy as np
import pytest
from test_decontamination import plain_words

from larkspur.llm import bigrams
from larkspur.llm.queries import QUERIES


def brute(texts, chosen):
    """Mean loss per word of a text, by counts in dictionaries of the chosen texts."""
    each, heads, pairs = Counter(), Counter(), Counter()
    for text in chosen:
        before = None
        for w in plain_words(text):
            each[w] += 1
            heads[before] += 1
            pairs[before, w] += 1
            before = w
    n, vocabulary = sum(each.values()), len({w for t in texts for w in plain_words(t)})

    def loss(text):
        total, before = 0.0, None
        for w in plain_words(text):
            total -= math.log((pairs[before, w] + bigrams.BACKOFF * (each[w] + 1) / (n + vocabulary + 1)) / (heads[before] + bigrams.BACKOFF))
            before = w
        return total / len(plain_words(text))

    return loss


def same(rows, texts, models):
    for r in rows:
        target, background = (m(texts[r.doc_id]) for m in models)
        assert math.isclose(r.target_loss, target, rel_tol=1e-9) and math.isclose(r.background_loss, background, rel_tol=1e-9)
        assert math.isclose(r.score, target - background, rel_tol=1e-6, abs_tol=1e-9)


def test_query_tells_all_contexts_apart(spark, tmp_path):
    """The scores of the query with many words."""
    random.seed(6)
    names = [f"word{k}" for k in range(2048)]
    docs = [(i, " ".join(random.choices(names, k=60))) for i in range(120)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 == 0), 0) for i, _ in docs], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = QUERIES["op3_lm_scoring"](spark, str(tmp_path)).collect()
    assert len(rows) == len(docs)
    texts = [t for _, t in docs]
    same(rows, dict(docs), [brute(texts, texts[::3]), brute(texts, texts)])


@pytest.mark.parametrize("block, bucket", [(bigrams.BLOCK, bigrams.BUCKET), (100, 200)])
def test_scores_follow_the_definition(spark, block, bucket):
    random.seed(2)
    docs = [(i, " ".join(random.choices(["red", "blue", "green", "grey", "Pink"] if i % 2 else ["one", "two", "three", "red"], k=random.choice([1, 5, 30])))) for i in range(40)]
    corpus, marks = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, 1, 0) for i in range(1, 40, 4)], "doc_id long, quality int, toxic int")
    rows = bigrams.cross_entropy_difference(corpus, marks, block, bucket).collect()
    new = [(100, "red red unheard blue"), (101, "of nothing known"), (102, "")]
    others = bigrams.score_others(spark.createDataFrame(new, "doc_id long, text string"), corpus, bigrams.target_ids(marks), block, bucket).collect()
    assert len(rows) == len(docs) and [r.score for r in others if r.n_words == 0] == [None]
    texts = [t for _, t in docs]
    same(rows + [r for r in others if r.n_words], dict(docs + new), [brute(texts, texts[1::4]), brute(texts, texts)])


def test_models_grow_with_the_corpus(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('word', id, ' other', id % 1000, ' same') AS text", "CAST(id < 10 AS int) AS target", "1 AS background", "true AS wanted")
    for n in (1000, 3000):
        found = bigrams.answers(bigrams.sent_keys(bigrams.into_blocks(docs.where(f"doc_id < {n}")), 3))
        words, pairs, target, background = bigrams.summed(found)
        assert (words, pairs) == (n + 1001, 2 * n + 1000) and (target, background) == (30, 3 * n)


def test_odd_rows(spark, odd_docs, odd_labels):
    out = {(r.doc_id, r.n_words): r.score for r in bigrams.cross_entropy_difference(odd_docs, odd_labels).collect()}
    assert out[(2, 0)] is None and out[(3, 0)] is None and out[(1, 14)] is not None
    assert bigrams.cross_entropy_difference(odd_docs.limit(0), odd_labels).count() == 0
    assert bigrams.cross_entropy_difference(odd_docs, odd_labels.limit(0)).count() == odd_docs.count()


def test_good_documents_score_lower(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    held = labels.where("doc_id % 2 = 0")
    out = bigrams.cross_entropy_difference(docs, labels.where("doc_id % 2 = 1")).join(held, "doc_id").toPandas()
    good, bad = out[out.quality == 1].score, out[out.quality == 0].score
    auc = sum((good < b).mean() for b in bad) / len(bad)
    assert auc > 0.75  # the target has few words at this size


def test_packed_numbers():
    for values in ([0], [1, 2, 255], [256, 0, 7], [2**40, 3], []):
        assert bigrams.unpacked(bigrams.packed(np.array(values, np.int64))).tolist() == values
    keys = np.sort(np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2))
    assert np.array_equal(bigrams.unpacked_keys(bigrams.packed_keys(keys)), keys)
