import random
import re

import pytest

from larkspur.llm import decontamination as de

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=13):
    out = []
    for doc_id, text in docs:
        words, hit, ids = plain_words(text), set(), set()
        for item_id, item in items:
            if item_id is None or item is None:
                continue
            own = plain_words(item)
            size = min(window, len(own))
            for at in range(len(own) - size + 1 if own else 0):
                for place in range(len(words) - size + 1):
                    if words[place:place + size] == own[at:at + size]:
                        hit |= set(range(place, place + size))
                        ids.add(item_id)
        out.append((doc_id, len(words), len(hit), sorted(ids), len(hit) > 0 and 20 * len(hit) >= len(words)))
    return out


def rows(frame):
    return [(r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in frame.collect()]


def key(row):
    return (row[0] is None, row[0] or 0, row[1:])


@pytest.fixture(scope="module")
def planted(spark):
    random.seed(3)
    vocabulary = ["alpha", "beta", "gamma", "delta", "Ümlaut", "x1"]
    items = [(i, " ".join(random.choices(vocabulary, k=k))) for i, k in enumerate([3, 5, 13, 14, 30, 45, 1, 13])]
    docs = []
    for i in range(60):
        words = random.choices(vocabulary + ["other", "Words", "here"], k=random.choice([0, 1, 4, 40, 200]))
        if i % 3:
            own = random.choice(items)[1].split()
            at = random.randrange(len(own))
            words[len(words) // 2:len(words) // 2] = own[at:at + random.choice([13, 20, 45])]
        docs.append((i, random.choice([" ", ", ", "\n"]).join(words)))
    return docs, items


@pytest.mark.parametrize("window,block_words", [(13, 10**6), (4, 10**6), (13, 5)])
def test_same_as_brute_force(spark, planted, window, block_words):
    docs, items = planted
    found = de.overlap(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), window, block_words)
    assert sorted(rows(found), key=key) == sorted(brute(docs, items, window), key=key)


def test_longest_matches_are_verbatim(spark, planted):
    docs, items = planted
    found = de.overlap(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    texts, wanted = dict(docs), dict(items)
    n = 0
    for r in found.collect():
        words = plain_words(texts[r.doc_id])
        for m in r.matches:
            own = plain_words(wanted[m.item_id])
            assert words[m.word:m.word + m.n_words] == own[m.item_word:m.item_word + m.n_words]
            before = m.word and m.item_word and words[m.word - 1] == own[m.item_word - 1]
            after = words[m.word + m.n_words:][:1] == own[m.item_word + m.n_words:][:1] != []
            assert not before and not after
            n += 1
    assert n


def test_odd_rows(spark, odd_docs, odd_benchmark):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    items = {(r.item_id, r.text) for r in odd_benchmark.collect()}
    assert sorted(rows(de.overlap(odd_docs, odd_benchmark)), key=key) == sorted(brute(docs, items), key=key)
    clean = de.decontaminate(odd_docs, odd_benchmark)
    assert clean.columns == odd_docs.columns
    assert sorted((r.doc_id or 0) for r in clean.collect()) == [0, 0, 2, 3, 4, 5, 7, 8, 8]  # 1 and 6 are hit
    assert de.decontaminate(odd_docs, odd_benchmark, block_words=1).count() == 9


def test_empty_tables(spark, odd_docs, odd_benchmark):
    none = odd_benchmark.limit(0)
    assert not any(r.contaminated for r in de.overlap(odd_docs, none).collect())
    assert de.decontaminate(odd_docs, none).count() == odd_docs.count()
    assert de.overlap(odd_docs.limit(0), odd_benchmark).count() == 0
