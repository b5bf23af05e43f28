"""A kept index for nearest vectors: cells around trained centres (an inverted file).

The centres are trained on a bounded sample; every vector is assigned to its nearest centre and written below the folder of
its cell. A search looks into the cells whose centres are nearest to the query. How many it takes is measured: the number of
cells doubles until a bounded set of queries finds the wanted share of its exact neighbours.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, functions as F

from larkspur.functions.scalar import dot
from larkspur.operators.ordering import top_k
from larkspur.operators.vectors import best_rows, vector_topk
from larkspur.session import saved

#: Vectors that the centres are trained on, at most, and centres at most: 4096 of 1000 numbers are 32 MB.
SAMPLE, CELLS = 65_536, 4096
#: Vectors and queries of a cell that are compared at a time.
BLOCK, QUERIES = 4096, 1024
#: Queries on which the share of exact neighbours is measured, at most.
JUDGED = 512
NEAR = "query_id long, id long, distance double"


def prepared(rows: DataFrame, id_col: str, vector: str, metric: str, dims: int | None = None) -> DataFrame:
    """id and v (doubles); for cosine the vectors get length 1. Rows without an id, null vectors, vectors with a null or of
    another size than ``dims``, and for cosine those of length 0, have no place in an index and are left out."""
    v = F.col(vector).cast("array<double>")
    told = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    if dims is not None:
        told = told.where(F.size("v") == dims)
    if metric == "cosine":
        length = F.sqrt(dot(F.col("v"), F.col("v")))
        told = told.withColumn("_n", length).where("_n > 0").select("id", F.transform("v", lambda x: x / F.col("_n")).alias("v"))
    return told


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column as a matrix; all lists have one size."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of y, by one product."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None, :], 0)


def nearest_centres(x: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    """Numbers of the nearest centres of each row, nearest first. The product is rounded by what else is in the batch, so centres
    within that of the nearest are measured exactly: a vector and its copies have one first cell, whatever batch they come in."""
    rough = squared(x, centres)
    near = np.argsort(rough, 1, "stable")[:, :probes] if probes > 1 else rough.argmin(1)[:, None]
    scale = (x * x).sum(1) + (centres * centres).sum(1).max()
    close = rough <= rough.min(1)[:, None] + 1e-9 * scale[:, None]
    for i in np.flatnonzero(close.sum(1) > 1):
        at = np.flatnonzero(close[i])
        first = at[((centres[at] - x[i]) ** 2).sum(1).argmin()]
        near[i] = np.concatenate([[first], near[i][near[i] != first]])[:probes]
    return near


@dataclass
class VectorIndex:
    """An index kept in ``folder``: ``rows/batch=N/cell=C`` has the vectors, ``centres`` and ``about`` what they were dealt by."""

    spark: SparkSession
    folder: str
    metric: str
    centres: np.ndarray

    @staticmethod
    def build(
        corpus: DataFrame, id_col: str, vector: str, folder: str, metric: str = "l2", cells: int | None = None, sample: int = SAMPLE, seed: int = 7,
    ) -> VectorIndex:
        """Train centres, assign all vectors and write them. ``cells`` is, if not given, the root of the number of vectors. The centres
        are trained on at most about ``sample`` vectors, chosen by a hash of their id; all vectors are indexed."""
        if metric not in ("l2", "cosine"):
            raise ValueError("metric must be 'l2' or 'cosine'")
        spark = corpus.sparkSession
        first = corpus.where(F.col(vector).isNotNull()).select(F.size(vector).alias("n")).groupBy("n").count().orderBy(F.desc("count"), "n").first()
        dims = first["n"] if first else 0
        rows = prepared(corpus, id_col, vector, metric, dims)
        n = rows.count()
        cells = max(1, min(cells or int(np.sqrt(n)), CELLS, n))
        one_in = max(1, -(-n // sample))
        chosen = rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(one_in)) == 0) if one_in > 1 else rows
        if cells > 1:
            model = KMeans(k=cells, seed=seed, maxIter=10, featuresCol="x").fit(saved(chosen.select(array_to_vector("v").alias("x")), "sample"))
            centres = np.array(model.clusterCenters())
        else:
            centres = np.zeros((1, dims))
        about = [(metric, json.dumps(centres.tolist()))]
        spark.createDataFrame(about, "metric string, centres string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/about")
        index = VectorIndex(spark, folder, metric, centres)
        index._write(rows, 0)
        return index

    @staticmethod
    def load(spark: SparkSession, folder: str) -> VectorIndex:
        about = spark.read.parquet(f"{folder}/about").first()
        return VectorIndex(spark, folder, about["metric"], np.array(json.loads(about["centres"])))

    def add(self, rows: DataFrame, id_col: str, vector: str, batch: int) -> None:
        """Index more rows by the centres there are, as ``batch`` (1, 2, ...). A batch that is written again replaces itself."""
        if batch < 1:
            raise ValueError("batch 0 is what the index was built from")
        self._write(prepared(rows, id_col, vector, self.metric, self.centres.shape[1]), batch)

    def nearest_cells(self, rows: DataFrame, probes: int, keep: list[str]) -> DataFrame:
        """The columns ``keep`` and ``cells``, the numbers of the nearest centres, nearest first."""
        sent = self.spark.sparkContext.broadcast(self.centres)
        kinds = dict(rows.dtypes)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres = sent.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = matrix(batch.column("v"))
                near = np.concatenate([nearest_centres(x[at:at + BLOCK], centres, probes) for at in range(0, len(x), BLOCK)])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, near.shape[1]), pa.int32()), pa.array(near.ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], lists], [*keep, "cells"])

        return rows.mapInArrow(assign, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", cells array<int>")

    def _write(self, rows: DataFrame, batch: int) -> None:
        assigned = saved(self.nearest_cells(rows, 1, ["id", "v"]).select("id", "v", F.col("cells")[0].alias("cell")), "assigned")
        sizes = assigned.groupBy("cell").agg(F.count("*").alias("n"))  # as many rows as centres
        files = F.ceil(F.col("n") / (64 * BLOCK)).cast("int")
        dealt = assigned.join(F.broadcast(sizes.select("cell", files.alias("files"))), "cell")
        spread = dealt.withColumn("file", F.pmod(F.xxhash64("id"), F.col("files"))).repartition("cell", "file")
        spread.select("id", "v", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{self.folder}/rows/batch={batch}")

    def rows(self) -> DataFrame:
        """id, v, batch, cell."""
        return self.spark.read.schema("id long, v array<double>, batch int, cell int").parquet(f"{self.folder}/rows")

    def sizes(self) -> DataFrame:
        return self.rows().groupBy("cell").agg(F.count("*").alias("n"))

    def search(self, queries: DataFrame, id_col: str, vector: str, k: int = 5, probes: int = 1) -> DataFrame:
        """The k nearest of the vectors in the ``probes`` nearest cells: query_id, id, distance (Euclidean, or 1 - cosine), rank. A query
        whose cells have fewer than k vectors gets fewer.

        The vectors and the queries of a cell meet in blocks, of which each gives k rows a query; pairs are never listed."""
        asked = prepared(queries, id_col, vector, self.metric, self.centres.shape[1]).withColumnRenamed("id", "query_id")
        placed = self.nearest_cells(asked, min(probes, len(self.centres)), ["query_id", "v"]).select("query_id", "v", F.explode("cells").alias("cell"))
        placed = saved(placed, "asked")
        blocks = saved(self.sizes().select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")).join(
            placed.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts")), "cell"), "blocks")
        known = F.broadcast(blocks)  # as many rows as centres

        def copies(rows: DataFrame, own: str, other: str, key: str) -> DataFrame:
            """Each row in its own block, once for every block of the other side: b numbers those of the vectors, p the queries'."""
            dealt = rows.join(known, "cell").withColumn(own[0], F.pmod(F.xxhash64(key), F.col(own)).cast("int"))
            return dealt.withColumn(other[0], F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("blocks", "parts")

        left = copies(self.rows().select("id", "v", "cell"), "blocks", "parts", "id")
        right = copies(placed, "parts", "blocks", "query_id")
        cosine = self.metric == "cosine"

        def compare(vectors: pa.Table, wanted: pa.Table) -> pa.Table:
            x, ids, asked_ids = matrix(vectors["v"]), vectors["id"].to_numpy(), wanted["query_id"].to_numpy()
            row, near, distance = best_rows(matrix(wanted["v"]), x, ids, k, cosine)
            return pa.table({"query_id": asked_ids[row], "id": near, "distance": distance})

        keys = ["cell", "b", "p"]
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, NEAR)
        return top_k(found, ["query_id"], [F.col("distance"), F.col("id")], k, "rank")

    def recall(self, queries: DataFrame, id_col: str, vector: str, k: int, probes: int, judged: int = JUDGED) -> float:
        """The share of the exact neighbours that a search finds, measured on at most about ``judged`` queries (by a hash of their id)."""
        places, _, _ = self._places(queries, id_col, vector, k, judged)
        total = sum(places.values())
        return sum(n for place, n in places.items() if place <= probes) / total if total else 1.0

    def tune(self, queries: DataFrame, id_col: str, vector: str, k: int = 5, least: float = 0.9, judged: int = JUDGED, sure: float = 4.0) -> tuple[int, float]:
        """The smallest number of cells that finds at least ``least`` of the exact neighbours, and the share it finds; measured as in
        :meth:`recall`.

        Where not all queries are judged, the share of all of them differs by chance from that of the judged. Then so many cells are
        taken that the share is above ``least`` by ``sure`` standard errors of its mean over queries, or that all is found."""
        places, asked, n = self._places(queries, id_col, vector, k, judged)
        total, found = sum(places.values()), 0
        for place in sorted(places):
            found += places[place]
            share = found / total
            # neighbours of a query may all be missed together, so a query counts as one trial
            spread = sure * np.sqrt(max(share * (1 - share), 1 / n ** 2) / n) if n < asked else 0.0
            if found == total or (found >= least * total and share - spread >= least):
                return place, share
        return 1, 1.0

    def _places(self, queries: DataFrame, id_col: str, vector: str, k: int, judged: int) -> tuple[dict[int, int], int, int]:
        """How many exact neighbours are in the nearest cell of their query, in the second, and so on; all queries, and those judged. A search of some cells gives the
        nearest vectors in them, so it finds every exact neighbour that is there."""
        asked = prepared(queries, id_col, vector, self.metric, self.centres.shape[1]).withColumnRenamed("id", "query_id")
        n = asked.count()
        one_in = max(1, -(-n // judged))
        few = saved(asked.where(F.pmod(F.xxhash64("query_id", F.lit("judge")), F.lit(one_in)) == 0), "judged")
        exact = vector_topk(self.rows(), few, "id", "v", k, "l2").select("query_id", "id")  # on unit vectors the order is that of the cosine
        cells = self.nearest_cells(few, len(self.centres), ["query_id"])
        met = exact.join(self.rows().select("id", "cell"), "id").join(cells, "query_id")
        counts = met.groupBy(F.array_position("cells", F.col("cell")).cast("int").alias("place")).agg(F.count("*").alias("n"))
        return {r.place: r.n for r in counts.collect()}, n, few.count()  # as many rows as centres
