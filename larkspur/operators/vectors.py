"""Nearest vectors and novelty."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from larkspur.functions.scalar import dot
from larkspur.operators.ordering import top_k
from larkspur.session import saved

#: Query vectors that travel to the tasks at a time.
SLICE = 4096
#: Corpus rows that are compared with them by one product.
PIECE = 1024


def vector_topk(corpus: DataFrame, queries: DataFrame, id_col: str, vector: str, k: int = 5, metric: str = "l2") -> DataFrame:
    """Exact k nearest corpus rows per query row: (query_id, id, distance, rank).

    The query vectors travel to the tasks in slices of about ``SLICE``, one pass over the corpus each; every
    task keeps k rows per query from each Arrow batch, and only those candidates are shuffled."""
    if metric not in ("l2", "cosine"):
        raise ValueError("metric must be 'l2' or 'cosine'")
    wanted = queries.select("query_id", F.col(vector).cast("array<double>").alias("v"))
    slices = -(-wanted.count() // SLICE)
    found = corpus.sparkSession.createDataFrame([], "query_id LONG, id LONG, distance DOUBLE")
    for i in range(slices):
        picked = wanted.where(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == i).collect()
        found = found.unionAll(nearest_candidates(corpus, picked, id_col, vector, k, metric)) if picked else found
    return top_k(found, ["query_id"], [F.col("distance"), F.col("id")], k, "rank")


def best_rows(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, cosine: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of q, id and distance of the k nearest rows of x, equal distances in order of ids.

    One product gives all distances up to rounding; those within it of the k-th are measured exactly, however many
    equal vectors there are."""
    if not len(q) or not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if cosine:
        lengths = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            rough = 1 - (q @ x.T) / lengths
        scale = np.ones((len(q), 1))
    else:
        qq, xx = (q * q).sum(1)[:, None], (x * x).sum(1)[None, :]
        rough = qq - 2 * (q @ x.T) + xx
        scale = qq + xx.max()
    last = np.partition(rough, min(k, len(x)) - 1, 1)[:, min(k, len(x)) - 1][:, None]
    row, at = np.nonzero((rough <= last + 1e-9 * scale) | np.isnan(last) | (np.isnan(rough) & (last == np.inf)))
    if cosine:
        with np.errstate(divide="ignore", invalid="ignore"):
            exact = 1.0 - (x[at] * q[row]).sum(1) / (np.linalg.norm(q, axis=1)[row] * np.linalg.norm(x, axis=1)[at])
    else:
        exact = np.sqrt(((x[at] - q[row]) ** 2).sum(1))
    order = np.lexsort((ids[at], exact, row))
    row, at, exact = row[order], at[order], exact[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], ids[at[place < k]], exact[place < k]


def nearest_candidates(corpus: DataFrame, picked: list, id_col: str, vector: str, k: int, metric: str) -> DataFrame:
    """(query_id, id, distance): the k nearest rows of every piece of an Arrow batch for each of the picked vectors."""
    ids = np.array([r["query_id"] for r in picked], dtype=np.int64)
    q = np.array([r["v"] for r in picked], dtype=np.float64)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), PIECE):
                part = batch.iloc[at:at + PIECE]
                x = np.stack(part["v"].to_numpy()).astype(np.float64)
                row, near, distance = best_rows(q, x, part["id"].to_numpy(), k, metric == "cosine")
                yield pd.DataFrame({"query_id": ids[row], "id": near, "distance": distance})

    rows = corpus.select(F.col(id_col).alias("id"), F.col(vector).alias("v")).where(F.col(vector).isNotNull())
    return rows.mapInPandas(nearest, "query_id LONG, id LONG, distance DOUBLE")


def vector_ann(
    corpus: DataFrame, queries: DataFrame, id_col: str, vector: str, k: int = 5,
    bucket_length: float | None = None, tables: int = 8, seed: int = 7,
) -> DataFrame:
    """Approximate k nearest rows by random-projection hashing: only rows that share a bucket with a
    query are compared. A bucket is, without a given length, as long as the standard deviation of the vectors on a
    random line. Queries whose buckets hold fewer than k rows are answered by the exact search."""
    def as_vector(df: DataFrame, key: str) -> DataFrame:
        return df.select(F.col(key).alias("key"), array_to_vector(F.col(vector).cast("array<double>")).alias("vec"))

    if bucket_length is None:
        variance = as_vector(corpus, id_col).agg(Summarizer.variance(F.col("vec")).alias("v")).first()["v"]
        bucket_length = float(np.sqrt(np.mean(variance.toArray()))) if variance is not None else 1.0
    lsh = BucketedRandomProjectionLSH(
        inputCol="vec", outputCol="hashes", bucketLength=bucket_length or 1.0, numHashTables=tables, seed=seed
    )
    base = as_vector(corpus, id_col)
    pairs = lsh.fit(base).approxSimilarityJoin(as_vector(queries, "query_id"), base, float("inf"), "distance").select(
        F.col("datasetA.key").alias("query_id"), F.col("datasetB.key").alias("id"), "distance"
    )
    near = saved(top_k(pairs, ["query_id"], [F.col("distance"), F.col("id")], k, "rank"), "neighbours")
    full = near.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("query_id")
    short = queries.join(full, "query_id", "left_anti")
    return near.join(full, "query_id", "left_semi").unionByName(vector_topk(corpus, short, id_col, vector, k))


def mean_similarity_to_earlier(
    df: DataFrame, group: str, order: str, vector: str, dims: int, block: Column, out: str = "similarity",
) -> DataFrame:
    """Mean cosine similarity of each row to all earlier rows of its group, null for the first.

    The mean of dot products equals the dot product with the sum of the earlier unit vectors, so a
    running vector sum replaces the comparison of all pairs. A vector of another size than ``dims`` raises."""
    right_size = F.coalesce(F.size(vector) == dims, F.lit(True))
    v = F.when(right_size, F.transform(vector, lambda x: x.cast("double"))).otherwise(F.raise_error(F.lit(f"a vector does not have {dims} entries")))
    unit = df.withColumn("_v", v).withColumn("_len", F.sqrt(dot(F.col("_v"), F.col("_v"))))
    parts = {f"_u{i}": F.try_divide(F.col("_v")[i], F.col("_len")) for i in range(dims)}
    rows = unit.withColumns({**parts, "_b": block}).drop("_v", "_len", vector)
    names = list(parts)
    sums = rows.groupBy(group, "_b").agg(F.count("*").alias("_n"), *[F.sum(c).alias(c) for c in names])
    before = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        group, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        *[F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(f"{c}o") for c in names],
    )
    inside = Window.partitionBy(group, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(offsets, [group, "_b"])
    earlier = joined.select(
        "*", (F.col("_n0") + F.coalesce(F.count("*").over(inside), F.lit(0))).alias("_earlier"),
        *[(F.col(f"{c}o") + F.coalesce(F.sum(c).over(inside), F.lit(0.0))).alias(f"{c}s") for c in names],
    )
    total = sum((F.col(c) * F.col(f"{c}s") for c in names[1:]), F.col(names[0]) * F.col(f"{names[0]}s"))
    mean = F.when(F.col("_earlier") > 0, total / F.col("_earlier"))
    return earlier.select(*[c for c in df.columns if c != vector], F.col("_earlier").alias("earlier"), mean.alias(out))
