import random
from collections import defaultdict

import numpy as np
import pytest
from test_decontamination import plain_words

from larkspur.llm import jaccard as j


def shingle_set(text):
    words = plain_words(text)
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4)) or (frozenset([tuple(words)]) if words else frozenset())


def brute(docs, threshold=0.8):
    """(doc_id, n_shingles, class_id, n_links) by comparing all pairs of rows."""
    sets = [shingle_set(text) for _, text in docs]
    links, root = defaultdict(int), list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    ids = defaultdict(list)
    for i, (doc_id, _) in enumerate(docs):
        ids[find(i)].append(doc_id)
    first = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return [(doc_id, len(sets[i]), first[find(i)], links[i]) for i, (doc_id, _) in enumerate(docs)]


def rows(frame):
    return sorted([tuple(r) for r in frame.collect()], key=str)


@pytest.fixture(scope="module")
def groups():
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = []
    for group in range(12):
        base = random.choices(vocabulary, k=random.choice([4, 30, 80, 150]))
        for _ in range(random.choice([1, 2, 6, 25])):
            words = list(base)
            for _ in range(random.choice([0, 0, 1, 2, 3, 6])):
                words[random.randrange(len(words))] = random.choice(vocabulary)
            docs.append((len(docs) * 3, " ".join(words)))
    return docs


@pytest.mark.parametrize("block", [256, 4])
def test_same_as_brute_force(spark, groups, monkeypatch, block):
    monkeypatch.setattr(j, "BLOCK", block)  # 4: groups are cut into pairs of blocks
    found = j.jaccard_join(spark.createDataFrame(groups, "doc_id long, text string").repartition(3))
    assert rows(found) == sorted(brute(groups), key=str)


def test_one_of_each_class_stays(spark, groups):
    frame = spark.createDataFrame([(i, t, "en") for i, t in groups] + [(groups[0][0], groups[0][1], "en")], "doc_id long, text string, lang string")
    kept = [r.doc_id for r in j.keep_one(frame).collect()]
    assert sorted(kept) == sorted({c for _, _, c, _ in brute(groups)})


def test_odd_rows(spark, odd_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert rows(j.jaccard_join(odd_docs)) == sorted(brute(docs), key=str)
    kept = j.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.count() == 11  # of the repeated row one


def test_empty_table(spark, odd_docs):
    assert j.jaccard_join(odd_docs.limit(0)).count() == 0
    assert j.keep_one(odd_docs.limit(0)).count() == 0
    assert j.keep_one(odd_docs.where("text IS NULL")).count() == 2


def test_pruning_keeps_pairs_at_the_threshold():
    """Of signatures that agree in a share of 0.8 of the values on average, hardly any pair is dropped; of 0.5, most are."""
    random_ = np.random.default_rng(1)
    floor = j.posterior_floor()
    for share, low, high in ((0.8, 0.995, 1.0), (0.5, 0.0, 0.05)):
        a = random_.integers(0, 1 << 32, (400, j.K), np.uint64).astype(np.uint32)
        b = np.where(random_.random(a.shape) < share, a, a + np.uint32(1))
        left, right = j.surviving(a, b, False, floor)
        assert low <= (left == right).sum() / 400 <= high
        assert (left != right).sum() == 0


def test_minhash_estimates_similarity():
    random_ = np.random.default_rng(2)
    common, own = random_.integers(0, 1 << 62, 800, np.uint64), random_.integers(0, 1 << 62, 200, np.uint64)
    value = np.concatenate([np.sort(common), np.sort(np.concatenate([common, own]))])
    sig = j.signatures(value, np.repeat([0, 2], [800, 1000]), 3)
    assert abs((sig[0] == sig[2]).mean() - 0.8) < 0.15
    assert (sig[1] == 0xFFFFFFFF).all()


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i * 7919 % 1009, (i + 1) * 7919 % 1009) for i in range(500)], "a long, b long")
    found = j.components(edges)
    assert found.count() == 501 and found.select("component").distinct().count() == 1
