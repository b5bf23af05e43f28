import random

import pytest
from test_decontamination import plain_words

from larkspur.llm import licenses


def found(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: [(s.license, s.word, s.n_words, s.containment) for s in r.spans] for r in licenses.license_scan(frame).collect()}


@pytest.mark.parametrize("name, inserted", [("MIT", 13), ("MIT", 60), ("Apache-2.0", 10), ("BSD", 4), ("GPL-3.0", 4), ("CC-BY-4.0", 1)])
def test_interrupted_templates(spark, name, inserted):
    """Words inserted in the middle, as by a copyright line or a page header."""
    own = plain_words(licenses.TEMPLATES[name])
    text = [*(["before"] * 20), *own[:len(own) // 2], *(f"page{i}" for i in range(inserted)), *own[len(own) // 2:], *(["after"] * 20)]
    runs = {tuple(own[i:i + 5]) for i in range(len(own) - 4)}
    share = len(runs & {tuple(text[i:i + 5]) for i in range(len(text) - 4)}) / len(runs)
    got = [s for s in found(spark, [" ".join(text)])[0] if s[0] == name]
    assert got == [(name, 20, len(own) + inserted, pytest.approx(share))]


def test_copies_count_one_by_one(spark):
    random.seed(1)
    for name in ("MIT", "All rights reserved"):
        own = plain_words(licenses.TEMPLATES[name])
        parts = [own, own, own[:40] + ["noise"] * 6 + own[40:], [random.choice("abc") for _ in range(7)], own]
        starts = [sum(map(len, parts[:i])) for i in range(len(parts))]
        got = [s for s in found(spark, [" ".join(w for p in parts for w in p)])[0] if s[0] == name]
        want = [(name, s, len(p)) for i, (s, p) in enumerate(zip(starts, parts)) if i != 3]
        if name != "MIT":  # nothing stands behind the first 40 words
            want[2] = (name, starts[2], len(own))
        assert [s[:3] for s in got] == want
