"""Word-order measures, annotators, out-of-fold labels, tournaments and open windows against plain Python."""

import math
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.sql import functions as F

from larkspur.operators import metrics as M
from larkspur.operators.folds import FEATURES, contradicted, out_of_fold, text_classifier, text_features
from larkspur.operators.overlap import bleu, common_subsequence, rouge_l, with_bleu
from larkspur.operators.reliability import reliability
from larkspur.operators.tokens import texts, token_count
from larkspur.session import work_path
from larkspur.streaming.monitor import all_windows, append_to, state_on_disk, windowed_mentions

# ---- BLEU and ROUGE-L ------------------------------------------------------------------------


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def plain_bleu(c, r, n=4):
    p = []
    for k in range(1, n + 1):
        own, ref = (Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) for w in (c, r))
        p.append(sum(min(m, ref[g]) for g, m in own.items()) / sum(own.values()) if own else 0.0)
    if min(p) == 0:
        return 0.0
    return (1.0 if len(c) >= len(r) else math.exp(1 - len(r) / len(c))) * math.exp(sum(map(math.log, p)) / n)


def test_common_subsequences():
    rng = random.Random(1)
    for _ in range(200):
        a, b = (rng.choices("abcd", k=rng.randint(0, 90)) for _ in range(2))
        assert common_subsequence(a, b) == plain_lcs(a, b)
    long = [str(i % 701) for i in range(20_000)]
    assert common_subsequence(long, long[5_000:]) == 15_000


def test_bleu_and_rouge_l(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        r = rng.choices("a b c d e f".split(), k=rng.randint(0, 30))
        c = [x for x in r if rng.random() > 0.2] + rng.choices("a b".split(), k=rng.randint(0, 3))
        rows.append((i, " ".join(c), " ".join(r)))
    rows += [(100, None, "a b c d"), (101, "a b c d", None), (102, "", ""), (103, "The cat. The CAT sat on it", "the cat sat on it")]
    df = spark.createDataFrame(rows, "id long, c string, r string")
    scores = {x.id: x for x in bleu(df, ["id"], "c", "r").collect()}
    longest = {x.id: x for x in rouge_l(df, "c", "r").collect()}
    for i, c, r in rows:
        cw, rw = (("" if t is None else t).lower().replace(".", "").split() for t in (c, r))
        assert abs(scores[i].bleu - plain_bleu(cw, rw)) < 1e-9
        assert longest[i].lcs == plain_lcs(cw, rw)
        assert abs(longest[i].lcs_f1 - (2 * longest[i].lcs / (len(cw) + len(rw)) if cw or rw else 0)) < 1e-12


# ---- annotators ------------------------------------------------------------------------------


def plain_reliability(rows, rounds, small=0.01):
    labels = sorted({a for _, _, a in rows})
    by_item = defaultdict(list)
    for item, who, a in rows:
        by_item[item].append((who, a))
    belief = {i: {x: sum(a == x for _, a in own) / len(own) for x in labels} for i, own in by_item.items()}
    for _ in range(rounds):
        mass = {x: sum(b[x] for b in belief.values()) for x in labels}
        share = {x: (mass[x] + small) / (sum(mass.values()) + small * len(labels)) for x in labels}
        cells, totals = Counter(), Counter()
        for item, who, a in rows:
            for x in labels:
                cells[who, x, a] += belief[item][x]
                totals[who, x] += belief[item][x]
        rate = {(w, x, a): (m + small) / (totals[w, x] + small * len(labels)) for (w, x, a), m in cells.items()}
        for i, own in by_item.items():
            logs = {x: math.log(share[x]) + sum(math.log(rate[w, x, a]) for w, a in own) for x in labels}
            top = max(logs.values())
            e = {x: math.exp(v - top) for x, v in logs.items()}
            belief[i] = {x: v / sum(e.values()) for x, v in e.items()}
    return belief


def answers(seed, n=400):
    rng = random.Random(seed)
    wrong = {"ann": 0.03, "ben": 0.1, "cai": 0.2, "dia": 0.3, "eve": 0.45, "fay": 0.15}
    truth = {i: rng.choice(["yes", "no", "maybe"]) for i in range(n)}
    rows = []
    for i, label in truth.items():
        for who, rate in wrong.items():
            if rng.random() < 0.8:
                rows.append((i, who, rng.choice([x for x in ("yes", "no", "maybe") if x != label]) if rng.random() < rate else label))
    return truth, wrong, rows


def test_reliability_recovers_planted_rates_and_equals_a_plain_run(spark):
    truth, wrong, rows = answers(4)
    frame = spark.createDataFrame([*rows, (None, "ann", "yes"), (5, None, "yes"), (5, "ann", None)], "item long, who string, answer string")
    found = reliability(frame, "item", "who", "answer", tolerance=1e-3)
    got = {r.who: r.accuracy for r in found.annotators.collect()}
    assert all(abs(got[who] - (1 - rate)) < 0.06 for who, rate in wrong.items())
    items = {r.item: (r.label, r.probability) for r in found.items.collect()}
    assert sum(items[i][0] == label for i, label in truth.items() if i in items) >= 0.93 * len(items)
    belief = plain_reliability(rows, found.rounds)
    assert items.keys() == belief.keys()
    assert all(abs(belief[i][label] - p) < 1e-6 and p >= max(belief[i].values()) - 1e-6 for i, (label, p) in items.items())
    rates = {(r.who, r.label): 0.0 for r in found.errors.collect()}
    for r in found.errors.collect():
        rates[r.who, r.label] += r.rate
    assert all(abs(x - 1) < 0.05 for x in rates.values())


def test_one_annotator_and_no_answers(spark):
    frame = spark.createDataFrame([(1, "a", 1), (2, "a", 0), (2, "a", 0)], "item long, who string, answer int")
    found = reliability(frame, "item", "who", "answer", tolerance=1e-2)
    assert {(r.item, r.label) for r in found.items.collect()} == {(1, 1), (2, 0)}
    assert reliability(frame.where("false"), "item", "who", "answer").items.collect() == []


# ---- labels that models contradict -----------------------------------------------------------


def test_out_of_fold_finds_planted_wrong_labels(spark):
    rng = random.Random(7)
    good, bad = "river stone garden window".split(), "cheap casino pills winner".split()
    rows, turned = [], set()
    for i in range(400):
        label = int(rng.random() < 0.6)
        text = " ".join(rng.choices((good if label else bad) + ["the", "and", "of"], k=25))
        if rng.random() < 0.08:
            turned.add(i)
        rows.append((i, text, 1 - label if i in turned else label))
    df = spark.createDataFrame([*rows, (None, "no id", 1), (9999, None, 1), (9998, "no label", None)], "doc_id long, text string, quality int")
    scored = out_of_fold(df, "doc_id", "quality", "text")
    folds = {r.fold: r.n for r in scored.groupBy("fold").agg(F.count("*").alias("n")).collect()}
    assert sum(folds.values()) == 400 and len(folds) == 5
    assert all(r.n_known == 400 - folds[r.fold] for r in scored.collect())
    found = {r.doc_id for r in contradicted(scored, "quality").collect()}
    assert len(found & turned) >= 0.9 * len(turned) and len(found - turned) <= 0.03 * 400
    assert {r.predicted for r in contradicted(scored, "quality", 0.5).where("quality = 1").collect()} == {0}


def test_out_of_fold_with_one_label(spark):
    df = spark.createDataFrame([(i, "some words", 1) for i in range(20)], "doc_id long, text string, quality int")
    scored = out_of_fold(df, "doc_id", "quality", "text")
    assert {r.p for r in scored.collect()} == {1.0} and contradicted(scored, "quality").collect() == []
    assert out_of_fold(df.where("false"), "doc_id", "quality", "text").collect() == []


def test_out_of_fold_hashes_words_once_for_all_folds(spark):
    """Models read vectors that were written before them, and give what a pipeline gives that hashes the words of each fold anew."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices("river stone garden casino pills the".split(), k=rng.randint(0, 12))), int(rng.random() < 0.5)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    scored = out_of_fold(df, "doc_id", "quality", "text", folds=2)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "features" in plan and "words" not in plan and "hashed" not in plan

    def pipeline(features, label):
        parts = ["hashed", *FEATURES]
        hashed = HashingTF(inputCol="words", outputCol="hashed", numFeatures=1 << 11, binary=True)
        return Pipeline(stages=[hashed, VectorAssembler(inputCols=parts, outputCol=features), text_classifier(features, label)])

    anew = {r.doc_id: r.p for r in out_of_fold(df, "doc_id", "quality", "text", 2, classifier=pipeline, vectors=lambda rows: rows).collect()}
    found = {r.doc_id: r.p for r in scored.collect()}
    assert len(found) == 60 and all(math.isclose(p, anew[i], abs_tol=1e-9) for i, p in found.items())


def test_word_length_counts_letters_of_words(spark):
    texts = ["ab, cde!", "", "...", "é\U0001d54f 12"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", text_features(F.col("text"))["word_length"].alias("n"))
    assert {r.text: r.n for r in df.collect()} == {"ab, cde!": 2.5, "": 0.0, "...": 0.0, "é\U0001d54f 12": 2.0}


# ---- tournaments -----------------------------------------------------------------------------


def test_strengths_converge_in_each_component(spark):
    rng = random.Random(3)
    power = {"a": 4.0, "b": 2.0, "c": 1.0, "d": 0.5, "x": 3.0, "y": 1.0}
    matches = []
    for group in ("abcd", "xy"):
        for i in group:
            for j in group:
                if i < j:
                    matches += [(i, j, 1 if rng.random() < power[i] / (power[i] + power[j]) else 2) for _ in range(40)]
    matches += [("p", "q", 1), ("p", "q", 1)]
    frame = spark.createDataFrame(matches, "competitor_1 string, competitor_2 string, preferred int")
    got = {r.competitor: r for r in M.bradley_terry(frame, tolerance=1e-12).collect()}
    wins, n = Counter(), Counter()
    for i, j, p in matches:
        wins[i if p == 1 else j] += 1
        n[i, j] += 1
        n[j, i] += 1
    r = {x: 1.0 for x in "abcdxy"}
    for _ in range(3000):
        r = {i: wins[i] / sum(n[i, j] / (r[i] + r[j]) for j in r if n[i, j]) for i in r}
    for group in ("abcd", "xy"):
        mean = sum(r[x] for x in group) / len(group)
        for x in group:
            assert got[x].component == group[0] and abs(got[x].strength - r[x] / mean) < 1e-3
            error = 1 / math.sqrt(sum(n[x, j] * r[x] * r[j] / (r[x] + r[j]) ** 2 for j in group if n[x, j]))
            assert abs(got[x].log_error - error) < 1e-3
    assert got["q"].strength == 0 and got["p"].log_error is None and got["p"].component == "p"


def test_components_of_a_long_chain(spark):
    links = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(30)] + [("z1", "z2")]
    pairs = spark.createDataFrame([p for a, b in links for p in ((a, b), (b, a))], "i string, j string")
    got = {r.i: r.component for r in M.components(pairs).collect()}
    assert {x for x in got.values()} == {"n000", "z1"} and len(got) == 33


# ---- open windows ----------------------------------------------------------------------------


def test_windows_in_many_batches(spark, tmp_path):
    """Every window is shown, reported or open, after a first run and after a second one that goes on with its counts."""
    rng = random.Random(1)
    rows = sorted((f"2024-01-01 {h:02d}:{rng.randrange(60):02d}:00", rng.choice("ab")) for h in range(10) for _ in range(12))
    frame = spark.createDataFrame(rows, "ts string, term string").withColumn("ts", F.col("ts").cast("timestamp"))
    source, folder = str(tmp_path / "in"), work_path(spark, "windows")

    def run():
        with state_on_disk(spark):
            stream = spark.readStream.schema("ts timestamp, term string").option("maxFilesPerTrigger", 1).parquet(source)
            append_to(windowed_mentions(stream, "ts", "term"), folder, availableNow=True).awaitTermination()
        return {(r.window_start, r.term): (r.n, r.final) for r in all_windows(spark, folder, "term").collect()}

    def wanted(part):
        counts = part.groupBy(F.window("ts", "15 minutes").alias("w"), "term").count().collect()
        return {(r.w.start, r.term): r["count"] for r in counts}

    first = frame.where("ts < '2024-01-01 06:10:00'")
    for h in range(0, 6):
        first.where(F.hour("ts") == h).coalesce(1).write.mode("append").parquet(source)
    first.where(F.hour("ts") == 6).coalesce(1).write.mode("append").parquet(source)
    shown = run()
    assert {k: n for k, (n, _) in shown.items()} == wanted(first)
    assert {f for _, f in shown.values()} == {True, False}
    frame.where("ts >= '2024-01-01 06:10:00'").coalesce(1).write.mode("append").parquet(source)
    assert {k: n for k, (n, _) in run().items()} == wanted(frame)
    assert "rocksdb" not in (spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") or "").lower()


# ---- tokens by a vocabulary ------------------------------------------------------------------


def test_tokens_are_those_of_another_library(spark):
    from tokenizers import Tokenizer

    from larkspur.operators.tokens import ratio_by_group

    rows = [("en", "The quick brown fox, it's 12345 <|endoftext|>!"), ("en", ""), ("de", "Straßenbahnhaltestelle über 東京 \n\n  x"), ("de", None), (None, "abc"), ("fr", "œuvre d'été " * 50)]
    plain = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    plain.encode_special_tokens = True
    found = {r.lang: r for r in ratio_by_group(spark.createDataFrame(rows, "lang string, text string"), "lang", "en", "text").collect()}
    for lang in {r[0] for r in rows}:
        texts = [t for x, t in rows if x == lang and t is not None]
        tokens, chars = sum(len(plain.encode(t, add_special_tokens=False).ids) for t in texts), sum(map(len, texts))
        assert (found[lang].texts, found[lang].tokens) == (len(texts), tokens) and abs(found[lang].tokens_per_char - tokens / chars) < 1e-12
    assert found["en"].ratio == 1.0


def test_both_measures_of_a_pair_need_no_shuffle(spark):
    rows = [(1, "a b c d e", "a b c x e"), (1, "a a a a a", "a a"), (2, None, "a"), (3, "", "")]
    df = spark.createDataFrame(rows, "id long, c string, r string")
    scored = rouge_l(with_bleu(df, "c", "r"), "c", "r")
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()
    got = {(x.id, x.c): (x.p1, x.p2, x.p3, x.p4, x.brevity, x.lcs) for x in scored.collect()}
    assert got == {(1, "a b c d e"): (0.8, 0.5, 1 / 3, 0.0, 1.0, 4), (1, "a a a a a"): (0.4, 0.25, 0.0, 0.0, 1.0, 2), (2, None): (0, 0, 0, 0, 0, 0), (3, ""): (0, 0, 0, 0, 0, 0)}


def test_only_some_texts_of_a_batch_are_strings_at_a_time(spark):
    values = ["a", None, "b c"] * 100
    lazy = texts(pa.array(values))
    assert next(lazy) == "a" and list(lazy) == values[1:] and list(texts(pa.array([], pa.string()))) == []
    found = spark.createDataFrame([(v,) for v in values], "text string").select(token_count(spark, "text").alias("n")).groupBy("n").count().collect()
    assert {r.n: r["count"] for r in found} == {None: 100, 1: 100, 2: 100}
