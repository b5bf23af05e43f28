"""Suffix arrays, common prefixes and removed bytes against brute force."""

import hashlib
import random

import numpy as np
import pytest

from larkspur.llm import suffixes
from larkspur.llm.suffixes import WINDOW


def plain_order(values):
    return sorted(range(len(values)), key=lambda i: list(values[i:]))


def test_suffix_arrays():
    rng = np.random.default_rng(1)
    cases = [np.zeros(0, np.uint16), np.array([3], np.uint16), np.zeros(40, np.uint16), np.array([1, 0] * 20, np.uint16), np.array([2, 1, 0], np.uint16), np.array([0, 1, 2], np.uint16)]
    for size in (2, 3, 10, 250):
        cases += [rng.integers(0, size, n).astype(np.uint16) for n in (2, 5, 30, 200)]
    word = rng.integers(0, 4, 30)
    cases += [np.concatenate([word, word, [3], word, word[:11]]).astype(np.uint16), np.frombuffer(b"mississippi" * 9, np.uint8).astype(np.uint16)]
    for text in cases:
        assert suffixes.suffix_array(text, 257).tolist() == plain_order(text.tolist())


def test_recursion_reaches_induced_names():
    """With few letters the string of names is sorted by inducing again, and then by doubling."""
    rng = np.random.default_rng(2)
    text = rng.integers(0, 2, 300_000).astype(np.uint16)
    order = suffixes.suffix_array(text, 257)
    assert np.array_equal(order, suffixes.doubled(text.astype(np.int64)))


def test_common_prefixes():
    rng = np.random.default_rng(3)
    for text in (rng.integers(0, 3, 400), np.zeros(300, np.int64), np.array([0, 1] * 100), np.tile(rng.integers(0, 9, 70), 5)):
        data = text.astype(np.uint8)
        text = text.astype(np.uint16)
        order = suffixes.suffix_array(text, 257)
        got = suffixes.common_prefixes(text, data, order)
        for a, b in zip(order[:-1].tolist(), order[1:].tolist()):
            n = 0
            while max(a, b) + n < len(text) and text[a + n] == text[b + n]:
                n += 1
            assert got[b] == n
        assert got[order[0]] == 0


def brute(rows, window=WINDOW):
    """doc_id and bytes: rows by the definition."""
    first = {}
    for doc, data in rows:
        rank = suffixes.LAST if doc is None else doc
        for i in range(len(data) - window + 1):
            s = data[i:i + window]
            first[s] = min(first.get(s, rank), rank)
    out = []
    for doc, data in rows:
        rank = suffixes.LAST if doc is None else doc
        gone = bytearray(len(data))
        for i in range(len(data) - window + 1):
            if first[data[i:i + window]] < rank:
                gone[i:i + window] = b"\1" * window
        kept = bytes(x for x, g in zip(data, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((doc, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(docs):
    return sorted((tuple(r) for r in suffixes.cleaned_documents(docs).collect()), key=str)


def test_repeated_windows_against_definition():
    rng = random.Random(4)
    base = bytes(rng.choices(b"ab\x00", k=400))
    strings, docs = [], []
    for k in range(30):
        a = rng.randint(0, 250)
        strings.append(base[a:a + rng.randint(0, 150)] + bytes(rng.choices(b"abc", k=rng.randint(0, 60))))
        docs.append(rng.randint(0, 9))
    which, at = suffixes.repeated_windows(np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings]), np.array(docs))
    first = {}
    for d, s in zip(docs, strings):
        for i in range(len(s) - WINDOW + 1):
            first[s[i:i + WINDOW]] = min(first.get(s[i:i + WINDOW], d), d)
    want = [(k, i) for k, s in enumerate(strings) for i in range(len(s) - WINDOW + 1) if first[s[i:i + WINDOW]] < docs[k]]
    assert sorted(zip(which.tolist(), at.tolist())) == want


@pytest.fixture(scope="module")
def made():
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghié東", k=rng.randint(2, 7))) for _ in range(300)]
    passages = [" ".join(rng.choices(words, k=rng.randint(8, 60))) for _ in range(12)]
    rows = []
    for k in range(160):
        parts = [" ".join(rng.choices(words, k=rng.randint(0, 50)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            parts += [p[a:a + rng.randint(20, len(p))], " ".join(rng.choices(words, k=rng.randint(0, 30)))]
        rows.append((rng.randint(-50, 400), "".join(parts)))
    rows += [(500 + k, rows[3][1]) for k in range(20)] + [(None, rows[5][1]), (None, rows[5][1] + rows[9][1]), (600, None), (601, ""), (602, "-" * 3000), (603, "-" * 2000 + "x" + "-" * 70), (604, "ab" * 700), (605, "ba" * 600)]
    return rows


def test_documents_against_definition(spark, made):
    docs = spark.createDataFrame([(d, t, "x") for d, t in made], "doc_id long, text string, block string").repartition(4)
    assert got(docs) == brute([(d, (t or "").encode()) for d, t in made])


@pytest.mark.parametrize("sizes", [{"BLOCK": 4000, "BUCKET": 2000, "PART": 10_000}, {"SPLIT": 1, "SORTED": 3000, "BUCKET": 8000}, {"PIECE": 64, "BLOCK": 3000}])
def test_small_blocks_buckets_and_shards_change_nothing(spark, made, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(suffixes, name, value)
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    assert got(docs) == brute([(d, (t or "").encode()) for d, t in made])


def test_table_against_definition(spark, documents):
    rows = [(r.doc_id, r.text.encode()) for r in documents.select("doc_id", "text").collect()]
    assert got(documents) == brute(rows)


def test_spans_and_kept_bytes(spark):
    text = "a passage that is a good deal longer than fifty bytes, with an end of its own"
    docs = spark.createDataFrame([(1, text), (2, "before " + text + " after"), (3, "short")], "doc_id long, text string")
    rows = {r.doc_id: r for r in suffixes.remove_repeats(docs).collect()}
    assert rows[1].n_spans == 0 and bytes(rows[1].kept) == text.encode() and bytes(rows[3].kept) == b"short"
    assert [(s.begin, s.end) for s in rows[2].spans] == [(7, 7 + len(text))] and bytes(rows[2].kept) == b"before  after"


def test_odd_rows(spark, odd_docs):
    rows = got(odd_docs)
    assert len(rows) == odd_docs.count()
    assert [r[2] for r in rows if r[0] == 1] == [0, 0]
    assert got(odd_docs.where("false")) == [] and [r[1] for r in got(odd_docs.where("text IS NULL"))] == [0, 0]


def test_blocks_leave_no_table_behind(spark, documents):
    before = len(spark.catalog.listTables())
    suffixes.cleaned_documents(documents.limit(5)).collect()
    assert len(spark.catalog.listTables()) == before


def texts_around(shared, rng, n):
    letters = "abcdefghijklmnopqrstuvwxyz"
    return [(k, "".join(rng.choices(letters, k=rng.randint(60, 150))) + shared[k // 2] + "".join(rng.choices(letters, k=rng.randint(60, 150)))) for k in range(2 * n)]


def wanted_bytes(docs):
    blocks = suffixes.into_blocks(docs)
    rows = suffixes.cut_out(blocks, suffixes.verdicts(suffixes.sent_keys(blocks, 2)), 2).where("shard IS NOT NULL")
    return sum(len(r.data) for r in rows.select("data").collect())


def test_strings_shorter_than_a_window_are_not_sorted(spark):
    """Texts that share a key, but not enough beside it for a window, stay out of the suffix arrays; else their share grows with the table."""
    rng = random.Random(8)
    short = ["".join(rng.choices("abcdefghij", k=30)) for _ in range(150)]
    assert wanted_bytes(spark.createDataFrame(texts_around(short, rng, 150), "doc_id long, text string").repartition(2)) == 0
    long = ["".join(rng.choices("abcdefghij", k=WINDOW)) for _ in range(150)]
    assert wanted_bytes(spark.createDataFrame(texts_around(long, rng, 150), "doc_id long, text string").repartition(2)) >= 300 * WINDOW


@pytest.mark.parametrize("split", [1, 4096])
def test_single_windows_wherever_their_key_is(spark, monkeypatch, split):
    """Two texts have exactly one window in common; its key may be anywhere in it, and be there more than once."""
    for name in ("SPLIT", "SPLIT_SHORT"):
        monkeypatch.setattr(suffixes, name, split)
    rng = random.Random(9)
    shared = ["".join(rng.choices("klmnop", k=WINDOW)) for _ in range(400)]
    shared += [("".join(rng.choices("klm", k=k)) * WINDOW)[:WINDOW] for k in range(1, 40)]
    shared += ["q" * k + "".join(rng.choices("rst", k=WINDOW - k)) for k in range(5, 45)]
    rows = texts_around(shared, rng, len(shared))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute([(d, t.encode()) for d, t in rows])
    assert got(docs) == want and sum(r[2] for r in want) >= len(shared) * WINDOW


def test_sides_of_a_group():
    """Runs of a key are wanted if one from another document has the same on a side, or if one has no single place of its key."""
    key, value, doc = np.ones(6, np.uint64), np.arange(6, dtype=np.uint64), np.array([1, 2, 2, 2, 3, 9])
    sides = np.array([[5, 7], [6, 7], [8, 1], [8, 2], [0, 5], [9, 0]], np.uint16)
    assert suffixes.judged(key, value, doc, sides).tolist() == [suffixes.WANTED] * 2 + [0] * 4
    sides[5] = 0
    assert suffixes.judged(key, value, doc, sides).tolist() == [suffixes.WANTED] * 6


def test_many_short_runs_of_a_key_stay_whole():
    """A passage in thousands of surroundings: its runs are sorted as they are, not window by window, which would be ten times the bytes."""
    n = 5000
    key, value, doc = np.ones(n, np.uint64), np.arange(n, dtype=np.uint64), np.arange(n)
    sides = np.array([[0, 3]] * n, np.uint16)
    assert set(suffixes.judged(key, value, doc, sides).tolist()) == {suffixes.WANTED}
    sides[7] = 0
    assert set(suffixes.judged(key, value, doc, sides).tolist()) == {suffixes.WINDOWS}
