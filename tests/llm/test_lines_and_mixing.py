import hashlib
import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from larkspur.llm import lines, mixing


def masked(line):
    return re.sub(r"[^ ]*[0-9@][^ ]*", "<*>", re.sub(r" [ \t\v\f\r]+|[\t\v\f\r][ \t\v\f\r]*", " ", line).strip(" "))


def runs_of(v, similarity=lines.SIMILARITY, depth=lines.DEPTH):
    """Places and tokens of the runs of which lines that are alike enough share one."""
    d = len(v) - math.ceil(len(v) * similarity - 1e-9)
    rest = len(v) - depth
    if d >= rest:
        return {(0, ())}
    if d == 1:
        return {(i, v[:i] + ("",) + v[i + 1:]) for i in range(depth, len(v))}
    parts = min(d + 1, rest)
    return {(p, v[depth + p * rest // parts:depth + (p + 1) * rest // parts]) for p in range(parts)}


def templates_of(variants, rank):
    """{variant: template} of a leaf, by the definition."""
    n = len(next(iter(variants)))
    least = math.ceil(n * lines.SIMILARITY - 1e-9)
    out = {v: v for v in variants}
    if n <= lines.DEPTH or least >= n:
        return out
    left = sorted(variants, key=rank)
    runs = {v: runs_of(v) for v in variants}
    while left:
        leaders = [v for i, v in enumerate(left) if not any(runs[v] & runs[u] for u in left[:i])]
        done = set(leaders)
        for v in left:
            like = [u for u in leaders if u != v and runs[u] & runs[v] and sum(x == y for x, y in zip(u, v)) >= least]
            if v not in done and like:
                out[v] = like[0]
                done.add(v)
        left = [v for v in left if v not in done]
    return out


def words_in(line):
    unspaced = sum("\u3040" <= c <= "\u30ff" or "\u4e00" <= c <= "\u9fff" or "\u0e00" <= c <= "\u0e7f" for c in line)
    return len(line.split(" ")) + unspaced // 2


def brute(docs, keep_first, mass=lines.MASS):
    """{(doc_id, text): (text, n_lines, n_dropped)} for distinct documents."""
    docs = sorted(set(docs), key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""))
    leaves = defaultdict(lambda: defaultdict(list))
    for d, (_, text) in enumerate(docs):
        for no, line in enumerate(text.split("\n") if text is not None else []):
            tokens = masked(line).split(" ")
            if masked(line):
                leaves[(len(tokens), tuple(tokens[:lines.DEPTH]))][tuple(tokens)].append((d, no))
    dropped = set()
    for variants in leaves.values():
        def rank(v):
            return -len({d for d, _ in variants[v]}), min((docs[d][0] is not None, docs[d][0] or 0, no) for d, no in variants[v])

        templates = defaultdict(list)
        for v, template in templates_of(variants, rank).items():
            templates[template] += [(place, words_in(" ".join(v))) for place in variants[v]]
        for places in templates.values():
            own, words = {d for (d, _), _ in places}, min(w for _, w in places)
            if len(own) > 1 and len(own) * words >= mass:
                ids = [docs[d][0] for d in own if docs[d][0] is not None]
                first = min(ids) if ids else None
                dropped |= {(d, no) for (d, no), _ in places if not keep_first or docs[d][0] != first}
    out = {}
    for d, doc in enumerate(docs):
        if doc[1] is None:
            out[doc] = (None, 0, 0)
            continue
        parts = doc[1].split("\n")
        kept = [x for no, x in enumerate(parts) if (d, no) not in dropped]
        out[doc] = ("\n".join(kept), len(parts), len(parts) - len(kept))
    return out


FOOTER = "Copyright by the Example Press on 12 May 2020 with all rights reserved worldwide"
LOG = "login of user alice from the office at nine o'clock in the morning sharp"


@pytest.fixture(scope="module")
def texts():
    docs = [(i, f"Own {' '.join(chr(97 + i) * k for k in range(3, 12))}\n{FOOTER.replace('12', str(i))}\n\nShort line") for i in range(12)]
    docs += [(20 + i, LOG.replace("alice", name) + f"\nthe {name} story goes on and on for a while") for i, name in enumerate(["bob", "carol", "dave", "erin"])]
    docs += [(30, "a tab\tand  spaces \r\nin this line"), (31, "a tab and spaces\nin this line"), (32, "\n\n"), (33, "x\n" + LOG)]
    return docs


@pytest.mark.parametrize("keep_first", [False, True])
def test_same_as_brute_force(spark, texts, keep_first):
    out = lines.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), keep_first)
    want = brute(texts, keep_first)
    assert {(r.doc_id): (r.text, r.n_lines, r.n_dropped) for r in out.collect()} == {k[0]: v for k, v in want.items()}


def test_variable_fields_are_generalised(spark, texts):
    out = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert [i for i in range(12) if "Copyright" in out[i]] == []  # numbers differ
    assert [i for i in range(12) if "Own " not in out[i]] == []
    assert all("login of" not in out[20 + i] for i in range(4))  # names differ
    assert all("story" in out[20 + i] for i in range(4))  # alike in too few places


def dropped(spark, rows):
    return {r.doc_id: r.n_dropped for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}


def test_a_long_line_with_a_few_changes_belongs_to_its_template(spark):
    """Six documents with one line of 60 tokens, of which 3 differ in 3 places."""
    base = [f"{a}{b}" for a in "abcdefghij" for b in "uvwxyz"]
    rows = []
    for i in range(6):
        line = list(base)
        for place in (10, 30, 50):
            line[place] = f"other{'abcdef'[i]}"
        rows.append((i, f"{'abcdef'[i] * 3} says {'abcdef'[i] * 4}\n" + " ".join(line)))
    assert dropped(spark, rows) == {i: 1 for i in range(6)}


def test_a_leaf_holds_several_templates(spark):
    """Two families with one length and the same first tokens, and a line of one document that repeats it most."""
    names = "anna bert carl dora emil frida gustav hanna ida jan karl lena".split()
    rows = [(i, f"thanks to all of our dear {name} partners for coming here today") for i, name in enumerate(names)]
    rows += [(20 + i, f"thanks to all who sent {name} a card or some flowers again") for i, name in enumerate(names[:6])]
    rows += [(50, "\n".join(["thanks to all that nobody else has ever said in this way"] * 100))]
    assert len({len(t.split("\n")[0].split()) for _, t in rows}) == 1
    assert dropped(spark, rows) == {**{i: 1 for i in range(12)}, **{20 + i: 1 for i in range(6)}, 50: 0}


def test_lines_without_blanks_count_by_their_characters(spark):
    rows = [(i, "版权所有未经许可不得转载本网站内容\n" + f"第{i}页") for i in range(5)] + [(9, "Introduction"), (10, "Introduction")]
    assert dropped(spark, rows) == {**{i: 1 for i in range(5)}, 9: 0, 10: 0}


def test_families_of_random_lines(spark):
    rng = random.Random(4)
    rows = []
    for i in range(50):
        n = rng.choice([6, 11])
        line = ["the", "same", "start", *(f"w{'abc'[rng.randrange(3)]}" for _ in range(n - 3))]
        rows.append((i, "\n".join([" ".join(line), " ".join(line[:3] + rng.choices(["wa", "wb"], k=n - 3))])))
    want = brute(rows, False)
    assert dropped(spark, rows) == {k[0]: v[2] for k, v in want.items()}


@pytest.mark.parametrize("keep_first", [False, True])
def test_odd_rows(spark, odd_docs, keep_first):
    out = lines.dedup_lines(odd_docs, keep_first)
    assert out.columns == [c for c in odd_docs.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    assert out.count() == odd_docs.count()
    want = brute([(r.doc_id, r.text) for r in odd_docs.collect()], keep_first)
    assert {(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()} == {(k[0], *v) for k, v in want.items()}
    assert lines.dedup_lines(odd_docs.limit(0)).count() == 0


def poisson(rate, u):
    k, p = 0, math.exp(-rate)
    total = p
    while total < u:
        k += 1
        p *= rate / k
        total += p
    return k


def number(*parts):
    return int(hashlib.md5("|".join(str(p) for p in parts if p is not None).encode()).hexdigest()[:13], 16)


def test_counts_invert_the_distribution(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "small").otherwise("large").alias("source"))
    weights = {"small": 3.0, "large": 1.0}
    out = mixing.mixed(docs, weights).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copy").alias("top")).collect()
    got = {r.doc_id: r.n for r in out}
    assert all(r.n == r.top for r in out)
    rates = {"small": 0.75 * 4000 / 400, "large": 0.25 * 4000 / 3600}
    for i in range(4000):
        u = (number(mixing.SEED, 1, i) + 0.5) / 2**52
        assert got.get(i, 0) == poisson(rates["small" if i % 10 == 0 else "large"], u)
    share = sum(n for i, n in got.items() if i % 10 == 0) / sum(got.values())
    assert abs(share - 0.75) < 0.03


def test_large_means_and_missing_weights(spark):
    docs = spark.createDataFrame([(i, "rare" if i < 4 else "often") for i in range(4000)], "doc_id long, source string")
    n = mixing.mixed(docs, {"rare": 1.0}).count()  # mean 1000 each, drawn in parts
    assert abs(n - 4000) < 300
    assert mixing.mixed(docs, {"other": 1.0}).count() == 0


def test_odd_rows_of_the_mix(spark, odd_docs):
    out = mixing.mixed(odd_docs, size=20.0)
    assert [c for c in out.columns if c not in ("copy", "shuffle_key")] == [c for c in odd_docs.columns if c != "copy"]
    counts = {(r.doc_id, r.source): r.n for r in out.groupBy("doc_id", "source").agg(F.count("*").alias("n")).collect()}
    assert counts[(1, "a")] % 2 == 0 and counts[(None, None)] > 0  # repeated rows repeat alike; null source is a source
    assert mixing.mixed(odd_docs.limit(0)).count() == 0


def test_order_does_not_follow_the_ids(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"))
    ids = [r.doc_id for r in mixing.mixed(docs, size=3.0).collect()]
    ups = sum(a < b for a, b in zip(ids, ids[1:])) / len(ids)
    assert 0.45 < ups < 0.55


def test_rows_without_an_id_are_spread_and_drawn_by_their_texts(spark):
    """A third of all rows may have no id, or one id; equal rows go to many places too."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.concat(F.lit("text "), F.when(F.col("id") < 2000, F.col("id")).otherwise(-1)).alias("text"))
    out = mixing.mixed(docs)
    counts = {r.text: r.n for r in out.groupBy("text").agg(F.count("*").alias("n")).collect()}
    assert 0.55 < len(counts) / 2000 < 0.72  # as many as a mean of 1 leaves
    parts = [r.n for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(parts) > 1 and max(parts) < 0.5 * sum(parts)
    same = mixing.mixed(docs.where("text = 'text -1'").unionAll(docs.select("doc_id", "source", F.concat("text", F.lit("!")))), size=3.0).where("text = 'text -1'")
    parts = [r.n for r in same.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert not parts or len(parts) > 1 and max(parts) < 0.5 * sum(parts)
