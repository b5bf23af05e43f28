"""Quality rules: an isolation forest on rule statistics of whole texts.

Statistics of every text are counted in Arrow batches. A forest of random splits is fitted on a bounded sample of
labelled rows (``SAMPLE`` of each kind at most); short mean path lengths mark anomalous documents. The threshold is the score
that finds most of the rejected labels while it loses at most ``LOSS`` of the accepted ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from larkspur.llm.arrays import (
    NOT_SPACE, Hashes, Texts, chunks, covered, repeated, shingles, string_batches, within, words,
)

MIN_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

#: Bounds of the labelled sample: rows of each label, and rejected rows for each accepted one while trees are grown.
SAMPLE = 4000
ODD_SHARE = 0.02
TREES = 128
LEAF_SAMPLE = 256
#: Share of accepted labels that the calibrated threshold may lose.
LOSS = 0.0005
SEED = 20

STATS = T.StructType([T.StructField(name, T.LongType()) for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])
USED = ("n_words", "word_chars", "n_symbols")
STATS_ARROW = pa.struct([(name, pa.int64()) for name in STATS.names])


def count_texts(part: Texts) -> dict[str, np.ndarray]:
    """The statistics of some whole texts."""
    data, n = part.data, part.n
    hashes = Hashes(data)
    found = words(part, NOT_SPACE, lower=False, hashes=hashes)
    counts = found.counts
    # code points in words: bytes that begin a code point
    chars = part.per_text(NOT_SPACE[data] & ((data & 0xC0) != 0x80))
    # lines: from a text's begin or a line feed to the next line feed or the text's end
    feed = np.flatnonzero(data == 0x0A)
    begin = np.sort(np.concatenate([part.starts[:-1], feed + 1]))
    text = np.searchsorted(part.starts[:-1], begin, "right") - 1
    begin_ok = begin < part.starts[text + 1]
    begin, text = begin[begin_ok], text[begin_ok]
    end = np.minimum(np.append(feed, len(data))[np.searchsorted(feed, begin)], part.starts[text + 1])
    has_word = np.searchsorted(found.begin, end) > np.searchsorted(found.begin, begin)
    begin, end, text = begin[has_word], end[has_word], text[has_word]
    later, _ = repeated(within(hashes.of(begin, end) ^ (end - begin).astype(np.uint64), text))
    # words in windows that occur twice or more in the text
    full = np.flatnonzero(found.left() >= WINDOW)
    key, owner = shingles(found, WINDOW)
    key = key[counts[owner] >= WINDOW]
    _, twice = repeated(within(key, found.text[full]))
    marks = np.concatenate([[0], np.cumsum(covered(full[twice], WINDOW, len(found.hash)))])
    return {
        "n_words": counts, "word_chars": chars, "n_symbols": part.per_text(SYMBOLS[data]),
        "n_dup_lines": np.bincount(text[later], minlength=n),
        "n_repeat_words": marks[found.first[1:]] - marks[found.first[:-1]],
    }


@F.arrow_udf(STATS)
def rule_stats(batch: pa.Array) -> pa.Array:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of every text; a null has none of each."""
    made = [count_texts(part) for part in chunks(string_batches(batch))]
    return pa.StructArray.from_arrays(
        [pa.array(np.concatenate([m[f.name] for m in made]) if made else [], pa.int64()) for f in STATS_ARROW], fields=list(STATS_ARROW))


def base_failed(stats: Column) -> Column:
    """Too few words, or too many of them in repeated windows."""
    return (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > REPEAT_PERCENT * stats["n_words"])


def features(n_words, word_chars, n_symbols) -> np.ndarray:
    """What the forest splits on, free of a text's length and on log scales: characters a word, symbols a word, symbols a
    character. Repeated words are judged by the base rule and repeated lines by line dedup: most clean texts have
    none, so a split on them would isolate the few that have one."""
    each = np.maximum(n_words, 1).astype(float)
    return np.column_stack([
        np.log(np.maximum(word_chars, 1) / each), np.log1p(1000 * n_symbols / each), np.log1p(1000 * n_symbols / np.maximum(word_chars, 1))])


def mean_depth(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of a failed search in a random binary tree of n rows."""
    n = np.asarray(n, float)
    deep = 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, deep, np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Random trees in flat arrays; ``score`` is 2 ** (-mean path / expected path), near 1 for anomalies."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, leaf_sample: int = LEAF_SAMPLE, seed: int = SEED):
        random = np.random.default_rng(seed)
        size = min(leaf_sample, len(rows))
        limit = max(1, int(np.ceil(np.log2(max(size, 2)))))
        self.expected = float(mean_depth(size)) or 1.0
        self.column, self.cut, self.left, self.depth, self.roots = [], [], [], [], []
        for _ in range(trees if len(rows) else 0):
            self.roots.append(len(self.column))
            self.grow(rows[random.choice(len(rows), size, replace=False)], limit, random)
        self.column, self.left, self.roots = (np.array(x, np.int32) for x in (self.column, self.left, self.roots))
        self.cut, self.depth = np.array(self.cut, float), np.array(self.depth, float)

    def grow(self, rows: np.ndarray, limit: int, random: np.random.Generator) -> None:
        """Nodes of one tree, breadth first; the two children of a node are neighbours."""
        waiting = [(rows, 0)]
        while waiting:
            part, depth = waiting.pop(0)
            wide = np.flatnonzero(part.max(0) > part.min(0)) if depth < limit and len(part) > 1 else []
            if not len(wide):
                self.column.append(-1), self.cut.append(0.0), self.left.append(0)
                self.depth.append(depth + float(mean_depth(len(part))))
                continue
            column = int(random.choice(wide))
            low, high = part[:, column].min(), part[:, column].max()
            cut = low + (high - low) * (random.random() or 0.5)
            below = part[:, column] <= cut
            self.left.append(len(self.column) + len(waiting) + 1)
            self.column.append(column), self.cut.append(cut), self.depth.append(0.0)
            waiting += [(part[below], depth + 1), (part[~below], depth + 1)]

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for root in self.roots:
            node = np.full(len(rows), root)
            while True:
                column = self.column[node]
                inner = column >= 0
                if not inner.any():
                    break
                right = rows[every, np.maximum(column, 0)] > self.cut[node]
                node = np.where(inner, self.left[node] + right, node)
            total += self.depth[node]
        return 2.0 ** (-total / max(1, len(self.roots)) / self.expected)


class Judge:
    """The fitted forest with its threshold. Without labelled rows of both kinds nothing is anomalous."""

    def __init__(self, good: np.ndarray, bad: np.ndarray):
        self.forest, self.threshold = None, np.inf
        if len(good) and len(bad):
            odd = bad[:max(1, int(ODD_SHARE * len(good)))]
            self.forest = IsolationForest(np.concatenate([good, odd]))
            good_scores, bad_scores = self.forest.score(good), self.forest.score(bad)
            lost = int(LOSS * len(good))
            floor = np.sort(good_scores)[::-1][lost]  # so many accepted rows may score higher
            above = bad_scores[bad_scores > floor]
            # halfway to the nearest rejected row, so that unseen accepted rows have room
            self.threshold = (floor + above.min()) / 2 if len(above) else np.inf

    def anomalous(self, rows: np.ndarray) -> np.ndarray:
        if self.forest is None or not len(rows):
            return np.zeros(len(rows), bool)
        return self.forest.score(rows) > self.threshold


def labelled(labels: DataFrame) -> DataFrame:
    """One row per document with one known quality; ids with contradicting labels are left out."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
    return known.groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high")).where("low = high").selectExpr("doc_id", "low AS quality")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Judge:
    """Fit on at most ``sample`` rows of each label: the smallest hashes of doc_id. Rows that fail the base rules
    are left to those."""
    known = labelled(labels)
    picked = known.where("quality >= 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).unionAll(
        known.where("quality < 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    stats = rows.select("doc_id", "quality", rule_stats("text").alias("s"))
    one = F.min(F.struct("s.n_words", "s.word_chars", "s.n_symbols", "s.n_repeat_words")).alias("s")  # however often an id occurs
    table = stats.groupBy("doc_id", "quality").agg(one).select("doc_id", "quality", "s.*").toPandas().sort_values("doc_id")
    table = table[(table.n_words >= MIN_WORDS) & (100 * table.n_repeat_words <= REPEAT_PERCENT * table.n_words)]
    made = features(*(table[name].to_numpy() for name in USED))
    good = table["quality"].to_numpy() >= 1
    return Judge(made[good], made[~good])


def judged(docs: DataFrame, judge: Judge, text: str = "text", column: str = "rule") -> DataFrame:
    """Add a struct: the statistics, base_failed and kept. The forest judges what passes the base rules."""

    @F.arrow_udf("boolean")
    def anomalous(*columns: pa.Array) -> pa.Array:
        return pa.array(judge.anomalous(features(*(string_batches(c).to_numpy(zero_copy_only=False) for c in columns))), pa.bool_())

    stats = F.col(column)
    each = [stats[f.name] for f in STATS_ARROW]
    failed = base_failed(stats)
    used = [stats[name] for name in USED]
    return docs.withColumn(column, rule_stats(F.col(text).cast("string"))).withColumn(
        column, F.struct(*[e.alias(f.name) for e, f in zip(each, STATS_ARROW)], failed.alias("base_failed"), (~failed & ~anomalous(*used)).alias("kept")))


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, the statistics, base_failed, kept.

    Null and empty texts have no words and fail the base rules. Repeated rows get repeated results. Labels without a
    document are not used; contradicting labels of a document are left out; without labels of both kinds only the
    base rules decide. Extra columns are not read.
    """
    judge = fit(docs, labels, sample)
    return judged(docs.select("doc_id", F.col("text").cast("string").alias("text")), judge).select("doc_id", "rule.*")


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that are kept, with all their columns as they were, whatever these are called."""
    name = "rule_"
    while any(c.lower().startswith(name) for c in docs.columns):
        name += "_"
    return judged(docs, fit(docs, labels, sample), column=name).where(F.col(name)["kept"]).drop(name)
