"""Word-order measures of a text against its reference: BLEU and ROUGE-L."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

from larkspur.functions.scalar import ratio, words

#: Pairs whose runs of words are counted at a time.
PAIRS = 1024


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a row of the table at a time: a row is one number, whose zero bits mark where
    the length grows, so that a step of addition works on all columns at once."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for word in b:
        here = row & places.get(word, 0)
        row = (row + here | row - here) & full
    return len(a) - row.bit_count()


@F.arrow_udf(IntegerType())
def subsequence_lengths(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([common_subsequence(x or [], y or []) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int32())


def rouge_l(df: DataFrame, candidate: str, reference: str) -> DataFrame:
    """Add lcs (words in the longest common subsequence), lcs_precision, lcs_recall and lcs_f1. Null texts have no words."""
    w = {c: words(F.coalesce(F.col(text), F.lit(""))) for c, text in (("_c", candidate), ("_r", reference))}
    rows = df.withColumns(w).withColumn("lcs", subsequence_lengths("_c", "_r"))
    n, c, r = F.col("lcs"), F.size("_c"), F.size("_r")
    return rows.withColumns({"lcs_precision": ratio(n, c), "lcs_recall": ratio(n, r), "lcs_f1": ratio(2 * n, c + r)}).drop("_c", "_r")


def gram_counts(a: pa.Array, b: pa.Array, n: int) -> np.ndarray:
    """For each pair of word lists a row: how many runs of 1 to ``n`` words of a are in b too (each as often as both have it), how many a
    has of each length, and the words of b. Runs get numbers, a length at a time, and are counted for all rows at once."""
    sizes = [x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for x in (a, b)]
    encoded = pa.concat_arrays([a.flatten(), b.flatten()]).dictionary_encode()
    word, n_words = encoded.indices.to_numpy().astype(np.int64), max(1, len(encoded.dictionary))
    size = np.concatenate(sizes).astype(np.int64)
    row = np.repeat(np.concatenate([np.arange(len(a)), np.arange(len(b))]), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(word))  # words from here to the end of the list
    first_of_b = int(sizes[0].sum())
    found = np.zeros((len(a), 2 * n + 1), np.int64)
    found[:, 2 * n] = sizes[1]
    run = word
    for k in range(1, n + 1):
        at = np.flatnonzero(left >= k)
        if k > 1:
            longer = np.zeros(len(word), np.int64)
            longer[at] = np.unique(run[at] * n_words + word[at + k - 1], return_inverse=True)[1]
            run = longer
        of_a = at < first_of_b
        kinds, kind = np.unique(row[at] * (len(word) + 1) + run[at], return_inverse=True)
        both = np.minimum(np.bincount(kind[of_a], minlength=len(kinds)), np.bincount(kind[~of_a], minlength=len(kinds)))
        found[:, k - 1] = np.bincount(kinds // (len(word) + 1), both, len(a))
        found[:, n + k - 1] = np.bincount(row[at[of_a]], minlength=len(a))
    return found


def with_bleu(df: DataFrame, candidate: str, reference: str, n: int = 4) -> DataFrame:
    """Add the clipped precision of every length up to ``n`` (p1, p2, ...), brevity and bleu. A pair is counted in its row; nothing is
    shuffled. Null texts have no words.

    bleu is brevity times the geometric mean of the precisions, 0 if one of them is 0. A candidate shorter than the reference
    has the brevity exp(1 - words of the reference / words of the candidate), any other 1. A candidate without
    words has 0 in all columns."""
    @F.arrow_udf(ArrayType(LongType()))
    def counted(a: pa.Array, b: pa.Array) -> pa.Array:
        found = [gram_counts(a.slice(at, PAIRS), b.slice(at, PAIRS), n) for at in range(0, len(a), PAIRS)]
        counts = np.concatenate([x.ravel() for x in found]) if found else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * (2 * n + 1), pa.int32()), pa.array(counts, pa.int64()))

    w = {c: words(F.coalesce(F.col(text), F.lit(""))) for c, text in (("_c", candidate), ("_r", reference))}
    rows = df.withColumns(w).withColumn("_n", counted("_c", "_r")).drop("_c", "_r")
    p = {f"p{k}": ratio(F.col("_n")[k - 1], F.col("_n")[n + k - 1]) for k in range(1, n + 1)}
    c1, r1 = F.col("_n")[n], F.col("_n")[2 * n]
    brevity = F.when(c1 == 0, F.lit(0.0)).when(c1 >= r1, F.lit(1.0)).otherwise(F.exp(1 - r1 / c1))
    scored = rows.withColumns({**p, "brevity": brevity}).drop("_n")
    logs = sum((F.ln(F.col(name)) for name in p), F.lit(0.0)) / n
    return scored.withColumn("bleu", F.when(F.least(*[F.col(name) for name in p]) > 0, F.col("brevity") * F.exp(logs)).otherwise(F.lit(0.0)))


def bleu(df: DataFrame, ids: list[str], candidate: str, reference: str, n: int = 4) -> DataFrame:
    """BLEU of each row: ids and the columns of :func:`with_bleu`."""
    return with_bleu(df, candidate, reference, n).select(*ids, *[f"p{k}" for k in range(1, n + 1)], "brevity", "bleu")
