"""Token alignment against a plain two-pointer version, and the encoders against their own libraries."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from larkspur.llm import alignment


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(*alignment.files())


@pytest.fixture(scope="module")
def plain():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(alignment.BYTE_BPE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment.PIECE_BPE)


def brute(texts, plain, pair):
    """Rows by the definition: every pair of tokens is tested for overlap."""
    out = []
    for text in texts:
        row = {"n_a": 0, "n_b": 0, "n_groups": 0, "links": [], "groups": ""}
        data = (text or "").encode()
        if data:
            a, b = plain[0].encode(" " + text, add_special_tokens=False).ids, plain[1].encode(text)
            if b"".join(pair.a.bytes[i] for i in a) == b"".join(pair.b.bytes[i] for i in b) == b" " + data:
                spans = []
                for ids, side in ((a, pair.a), (b, pair.b)):
                    at, own = 0, []
                    for i in ids:
                        own.append((at, at + len(side.bytes[i]), i))
                        at += len(side.bytes[i])
                    spans.append(own)
                cuts = sorted({x[1] for x in spans[0]} & {x[1] for x in spans[1]})
                low, groups = 0, []
                for cut in cuts:
                    groups.append("|".join(",".join(str(x[2]) for x in own if low < x[1] <= cut) for own in spans))
                    low = cut
                links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
                row = {"n_a": len(a), "n_b": len(b), "n_groups": len(cuts), "links": links, "groups": ";".join(groups)}
        out.append(row)
    count = Counter(p for row in out for p in set(row["links"]))
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    rows = []
    for row in out:
        links = row["links"]
        rows.append((
            row["n_a"], row["n_b"], row["n_groups"], len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links),
            hashlib.sha256(row["groups"].encode()).hexdigest() if links else ""))
    return rows


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

TEXTS = [
    None, "", " ", "a", "  two  spaces ", "don't <|endoftext|> stop </s> <s> now", "ünïcödé straße 東京都 日本語 🙂🙂", "\n\n\t x\r\n y",
    "internationalization of antidisestablishmentarianism 12345678 3.14159", "▁ piece mark", "nul \x00 byte", "same text twice", "same text twice",
    "x" * 3000, "the quick brown fox " * 400]


def test_rows_are_those_of_the_definition(spark, plain, pair):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_a string").repartition(3)
    got = alignment.align(docs)[0].orderBy("doc_id").select(*COLUMNS).collect()
    assert [tuple(r) for r in got] == brute(TEXTS, plain, pair)


def test_slices_of_the_pairs_give_the_same_rows(spark, documents):
    docs = documents.limit(60)
    whole, pairs = alignment.align(docs)
    sliced, _ = alignment.align(docs, limit=pairs.count() // 3 + 1)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, sliced.select(*whole.columns).collect()))


def test_table_against_the_definition(spark, documents, plain, pair):
    rows = documents.orderBy("doc_id").limit(40).collect()
    docs = spark.createDataFrame([(r.doc_id, r.text) for r in rows], "doc_id long, text string")
    got = alignment.aligned_documents(docs).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in COLUMNS) for r in got] == brute([r.text for r in rows], plain, pair)


def test_groups_spelled_out(spark):
    docs = spark.createDataFrame([(1, "hello world")], "doc_id long, text string")
    row = alignment.align(docs, spell=True)[0].first()
    assert hashlib.sha256(row.groups.encode()).hexdigest() == row.groups_sha256
    assert row.groups.count(";") == row.n_groups - 1


def test_odd_rows(odd_docs):
    rows = alignment.aligned_documents(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert [(r.n_a, r.groups_sha256) for r in rows if r.doc_id == 3] == [(0, "")]
    one = [tuple(r) for r in rows if r.doc_id == 1]
    assert one[0] == one[1]
    assert len([r for r in rows if r.doc_id == 8 and r.n_links]) == 2
    assert alignment.aligned_documents(odd_docs.where("false")).collect() == []
    assert [r.n_links for r in alignment.aligned_documents(odd_docs.where("text IS NULL")).collect()] == [0, 0]


def test_byte_level_ids_of_both_libraries_are_equal(plain, pair):
    rng = random.Random(3)
    letters = [chr(c) for c in rng.sample([*range(0x20, 0x3000), *range(0xA000, 0xD800), *range(0x1F000, 0x20000)], 4000)]
    texts = [" ".join("".join(rng.choices(letters, k=rng.randint(1, 6))) for _ in range(20)) for _ in range(300)]
    assert pair.a.encode(texts) == [x.ids for x in plain[0].encode_batch([" " + t for t in texts], add_special_tokens=False)]


def test_common_ends():
    rng = np.random.default_rng(5)
    for n, share in ((1, 1.0), (50, 0.5), (3000, 0.95), (3000, 0.05), (5000, 1.0)):
        universe = np.cumsum(rng.integers(1, 5, n))
        a, b = (np.unique(np.concatenate([universe[rng.random(n) < share], universe[-1:]])) for _ in range(2))
        for lane in (1, 7, 128):
            to = alignment.common_ends(a, b, lane)
            assert np.array_equal(a[to >= 0], np.intersect1d(a, b)) and np.array_equal(b[to[to >= 0]], np.intersect1d(a, b))
