"""The pipeline on the smallest tables: every stage against plain Python on what the stage before it kept."""

import hashlib
from collections import Counter

import corpus_pipeline
from test_decontamination import plain_words
from test_jaccard import brute as jaccard_rows
from test_lines_and_mixing import brute as deduped_lines, number, poisson

from larkspur.llm import mixing, quality

FOLDER = "/root/testdata/sf0.001"


def clean_of(docs, items, window=13):
    """doc_ids of the documents that the contamination rule leaves, by sets of windows."""
    windows = {}
    for _, text in items:
        words = plain_words(text)
        size = min(window, len(words))
        for at in range(len(words) - size + 1 if words else 0):
            windows.setdefault(size, set()).add(tuple(words[at:at + size]))
    out = []
    for doc_id, text in docs:
        words, hit = plain_words(text), set()
        for size, known in windows.items():
            for at in range(len(words) - size + 1):
                if tuple(words[at:at + size]) in known:
                    hit |= set(range(at, at + size))
        if not hit or 20 * len(hit) < len(words):
            out.append(doc_id)
    return out


def counts_of(docs):
    """How often each (doc_id, text, source) is repeated."""
    sizes = Counter(source for _, _, source in docs)
    weights = {s: n ** mixing.POWER for s, n in sizes.items()}
    out = {}
    for doc_id, text, source in docs:
        rate = len(docs) * weights[source] / sum(weights.values()) / sizes[source]
        assert rate <= mixing.PART
        u = (number(mixing.SEED, 1, doc_id, hashlib.md5((text or "").encode()).hexdigest()) + 0.5) / 2**52
        out[doc_id] = poisson(rate, u)
    return {k: n for k, n in out.items() if n}


def test_stages_one_after_the_other(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text, r.source) for r in docs.collect()]
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        rows = [(r.doc_id, r.text, r.source) for r in after.collect()]
        if name == "quality_rules":
            verdict = quality.quality(docs, spark.read.parquet(f"{FOLDER}/labels.parquet")).collect()
            assert {x[0] for x in rows} == {r.doc_id for r in verdict if r.kept} and set(rows) <= set(before)
            assert not {x[0] for x in rows} & {r.doc_id for r in verdict if r.base_failed}
        elif name == "line_dedup":
            want = {k[0]: v for k, v in deduped_lines([x[:2] for x in before], True).items()}
            assert {x[0]: x[1] for x in rows} == {i: text for i, (text, _, n) in want.items() if not n or plain_tokens(text)}
            assert all(r.n_chars == len(r.text) for r in after.collect() if want[r.doc_id][2])
        elif name == "ngram_jaccard_join":
            classes = jaccard_rows([x[:2] for x in before])
            assert {x[0] for x in rows} == {c if c is not None else i for i, n, c, _ in classes if n} | {i for i, n, _, _ in classes if not n}
        elif name == "benchmark_decontamination":
            assert sorted(x[0] for x in rows) == sorted(clean_of([x[:2] for x in before], items))
        else:
            assert Counter(x[0] for x in rows) == counts_of(before)
        if name != "source_mix":
            assert after.columns == columns
        kept[name], docs = len(rows), after
    whole = corpus_pipeline.run(spark, FOLDER)
    assert whole.count() == kept["source_mix"] and [name for name, _ in corpus_pipeline.STAGES] == list(kept)


def plain_tokens(text):
    return any(line.strip(" \t\v\f\r") for line in text.split("\n"))
