"""A kept search index: posting lists with places, in buckets of terms, for ranked and phrase search.

A segment is what one batch of texts gave. Its texts are dealt to groups by a hash of their id (``part``). ``postings`` has a row for each
term and group: ids, counts and places (ids, and the places in a text, as distances from their first; all places are one list, which the
counts cut into texts) and the words of those texts; and a row without a term that has all texts of the group, in a folder of its own
(``NO_TERM``). ``terms`` has the texts a term. Both are in folders of ``bucket``, a hash of the term. A search reads the buckets of its
terms only and works on a group at a time, so that what it finds is cut to the best before it is shuffled. Merging writes all segments as one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from larkspur.functions.scalar import words
from larkspur.operators.ordering import top_k
from larkspur.session import saved

#: Texts and letters in a group, folders of terms, groups in a file of a merged index, and queries that meet a group at a time.
BLOCK, LETTERS, BUCKETS, FILE, QUERIES = 4096, 8 << 20, 64, 64, 1024
#: Groups that a task counts and writes, if there are enough for all cores.
TASK = 8
#: The folder of the rows that have all texts of a group.
NO_TERM = -1
#: Usual constants of the ranking: how soon more occurrences stop to count, and how much long texts lose.
K1, B = 1.2, 0.75
POSTINGS = "part long, term string, n int, ids array<long>, tfs array<int>, lengths array<int>, places array<int>"
FOLDERS = {"postings": f"{POSTINGS}, segment int, bucket int", "terms": "term string, df long, segment int, bucket int"}


def flat(table: pa.Table, column: str) -> tuple[np.ndarray, pa.Array]:
    """Where each list of a column begins in all its values, one more at the end, and the values."""
    lists = table[column].combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(size)]).astype(np.int64), lists.flatten()


def from_first(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The first of some increasing numbers, and how far the others are from it, for lists one after the other that begin at ``starts``."""
    steps = values - np.repeat(values[starts], np.diff(np.append(starts, len(values))))
    steps[starts] = values[starts]
    return steps


def as_lists(values: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Lists one after the other that begin at ``starts``."""
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), pa.array(values, kind))


def absolute(steps: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The numbers that :func:`from_first` was given, for lists that begin at ``begin``, which ends with the number of all values."""
    starts = begin[:-1][np.diff(begin) > 0]
    first = np.repeat(steps[starts], np.diff(np.append(starts, len(steps))))
    values = steps + first
    values[starts] = steps[starts]
    return values


def group_postings(texts: pa.Table) -> pa.Table:
    """The rows of a group of texts (part, id, words): one without a term, then one for each word, with its texts in order of their ids."""
    begin, values = flat(texts, "words")
    part, n_words = texts["part"][0].as_py(), np.diff(begin)
    ids, row = np.unique(texts["id"].to_numpy(), return_inverse=True)
    encoded = values.dictionary_encode()
    code, doc = encoded.indices.to_numpy(), np.repeat(row, n_words)
    pos = np.arange(len(code)) - np.repeat(begin[:-1], n_words)
    order = np.lexsort((pos, doc, code))
    code, doc, pos = code[order], doc[order], pos[order]
    new_term = np.diff(code, prepend=-1) != 0
    pair = np.flatnonzero(new_term | (np.diff(doc, prepend=-1) != 0))  # where a term's places in a text begin
    term = np.flatnonzero(new_term[pair])  # where a term's texts begin
    length = np.bincount(row, n_words, len(ids)).astype(np.int64)

    def with_all(all_, own, kind):
        return as_lists(np.concatenate([all_, own]), np.concatenate([[0], len(all_) + term]), kind)

    return pa.table({
        "part": pa.array(np.full(len(term) + 1, part), pa.int64()),
        "term": pa.concat_arrays([pa.array([None], encoded.dictionary.type), encoded.dictionary.take(pa.array(code[pair][term]))]).cast(pa.string()),
        "n": pa.array(np.append(len(ids), np.diff(np.append(term, len(pair)))), pa.int32()),
        "ids": with_all(from_first(ids, np.zeros(1, np.int64)), from_first(ids[doc[pair]], pair[:0] if not len(pair) else term), pa.int64()),
        "tfs": with_all(np.zeros(0, np.int64), np.diff(np.append(pair, len(pos))), pa.int32()),
        "lengths": with_all(length, length[doc[pair]], pa.int32()),
        "places": as_lists(from_first(pos, pair), np.concatenate([[0], pair[term]]), pa.int32()),
    })


def merged_postings(postings: pa.Table) -> pa.Table:
    """One row for each term of some rows of postings, with its texts in order of their ids."""
    begin, values = flat(postings, "ids")
    (_, tfs), (_, lengths), (_, places) = (flat(postings, c) for c in ("tfs", "lengths", "places"))
    ids, tfs, lengths, places = absolute(values.to_numpy(), begin), tfs.to_numpy(), lengths.to_numpy(), places.to_numpy()
    terms = postings["term"].combine_chunks()
    terms = (terms if isinstance(terms, pa.Array) else pa.concat_arrays(terms.chunks)).dictionary_encode("encode")
    code = np.repeat(terms.indices.to_numpy(), np.diff(begin))
    order = np.lexsort((ids, code))
    ids, code, lengths = ids[order], code[order], lengths[order]
    term = np.flatnonzero(np.diff(code, prepend=-1))
    if len(tfs):  # rows without a term have no counts
        place = np.cumsum(tfs) - tfs
        tfs, place = tfs[order], place[order]
        pair = np.cumsum(tfs) - tfs
        places = places[np.repeat(place - pair, tfs) + np.arange(len(places))]
    counted = len(tfs) > 0
    none = np.zeros(len(term), np.int64)
    return pa.table({
        "part": pa.array(np.full(len(term), postings["part"][0].as_py()), pa.int64()),
        "term": terms.dictionary.take(pa.array(code[term])).cast(pa.string()),
        "n": pa.array(np.diff(np.append(term, len(ids))), pa.int32()),
        "ids": as_lists(from_first(ids, term), term, pa.int64()),
        "tfs": as_lists(tfs, term if counted else none, pa.int32()),
        "lengths": as_lists(lengths, term, pa.int32()),
        "places": as_lists(places, pair[term] if counted else none, pa.int32()),
    })


def by_query(asked: pa.Table) -> tuple[pa.Array, list[list[int]]]:
    """The queries, and the rows of each in order of terms."""
    asked_by = asked["query_id"].combine_chunks()
    asked_by = (asked_by if isinstance(asked_by, pa.Array) else pa.concat_arrays(asked_by.chunks)).dictionary_encode("encode")
    rows: list[list[int]] = [[] for _ in range(len(asked_by.dictionary))]
    terms, number = asked["term"].to_pylist(), asked_by.indices.to_numpy()
    for i in sorted(range(len(terms)), key=terms.__getitem__):
        rows[number[i]].append(i)
    return asked_by.dictionary, rows


def best_of_group(k: int, k1: float, b: float, digits: int, mean: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def best(postings: pa.Table, asked: pa.Table) -> pa.Table:
        begin, values = flat(postings, "ids")
        ids, doc = np.unique(absolute(values.to_numpy(), begin), return_inverse=True)
        tf, n_words = (flat(postings, c)[1].to_numpy().astype(np.float64) for c in ("tfs", "lengths"))
        share = tf * (k1 + 1) / (tf + k1 * (1 - b + b * n_words / mean))
        at = {term: slice(begin[i], begin[i + 1]) for i, term in enumerate(postings["term"].to_pylist())}
        names, rows = by_query(asked)
        terms, factor = asked["term"].to_pylist(), asked["times"].to_numpy() * asked["weight"].to_numpy()
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for q, own in enumerate(rows):
            met = [i for i in own if terms[i] in at]
            if not met:
                continue
            sums = np.zeros(len(ids))
            for i in met:
                sums[doc[at[terms[i]]]] += factor[i] * share[at[terms[i]]]
            here = np.flatnonzero(sums > 0)
            score = np.round(sums[here], digits)
            if len(here) > k:
                good = score >= np.partition(score, len(here) - k)[len(here) - k]
                here, score = here[good], score[good]
            order = np.lexsort((here, -score))[:k]
            found.append((np.full(len(order), q), ids[here[order]], score[order]))
        q, near, score = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": names.take(pa.array(q)), "id": near, "score": score})

    return best


def phrases_of_group(postings: pa.Table, asked: pa.Table) -> pa.Table:
    """Starts of a phrase are looked for at the places of its rarest word; the other words leave those that they follow."""
    begin, values = flat(postings, "ids")
    ids, doc = np.unique(absolute(values.to_numpy(), begin), return_inverse=True)
    size = flat(postings, "tfs")[1].to_numpy().astype(np.int64)
    place_begin = np.concatenate([[0], np.cumsum(size)])
    spot = (np.repeat(doc, size).astype(np.int64) << 32) + absolute(flat(postings, "places")[1].to_numpy().astype(np.int64), place_begin)
    at = {term: spot[place_begin[begin[i]]:place_begin[begin[i + 1]]] for i, term in enumerate(postings["term"].to_pylist())}
    names, rows = by_query(asked)
    terms, places = asked["term"].to_pylist(), asked["ats"].to_pylist()
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for q, own in enumerate(rows):
        if any(terms[i] not in at for i in own):
            continue
        wanted = sorted(((at[terms[i]], p) for i in own for p in places[i]), key=lambda x: len(x[0]))
        start, first = wanted[0]
        start = start[(start & 0xFFFFFFFF) >= first] - first
        for spots, p in wanted[1:]:
            where = np.minimum(np.searchsorted(spots, start + p), len(spots) - 1)
            start = start[spots[where] == start + p]
        if len(start):
            here, hits = np.unique(start >> 32, return_counts=True)
            found.append((np.full(len(here), q), ids[here], hits))
    q, near, hits = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    return pa.table({"query_id": names.take(pa.array(q)), "id": near, "hits": hits.astype(np.int64)})


@dataclass
class SearchIndex:
    spark: SparkSession
    folder: str
    buckets: int = BUCKETS

    def bucket(self, term: Column) -> Column:
        return F.when(term.isNull(), F.lit(NO_TERM)).otherwise(F.pmod(F.xxhash64(term), F.lit(self.buckets))).cast("int")

    def add(self, df: DataFrame, id_col: str, text: str, segment: int, block: int = BLOCK) -> None:
        """Index texts as a segment (0, 1, ...). An id belongs to one segment and one row; a segment that is written again replaces
        itself. Rows without an id are left out; texts without words have no postings.

        Texts are shuffled once, to groups of about ``block`` texts or ``LETTERS`` bytes, and counted in their group; a frequent term
        has a row in every group and not one row. What a task has counted of up to ``TASK`` groups it sorts and writes itself."""
        slim = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
        n, letters = slim.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
        groups = max(1, -(-n // block), -(-(letters or 0) // LETTERS))
        size = max(1, min(TASK, groups // (4 * self.spark.sparkContext.defaultParallelism)))
        dealt = slim.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(groups))).withColumn("task", F.floor(F.col("part") / size)).repartition("task")
        texts = dealt.select("task", "part", "id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
        self._write(texts.groupBy("task", "part").applyInArrow(group_postings, POSTINGS), self.folder, segment)

    def _write(self, rows: DataFrame, folder: str, segment: int) -> None:
        """Rows are written from where they are, in order of their folders only: one number is sorted without comparing rows."""
        rows = rows.withColumn("bucket", self.bucket(F.col("term"))).sortWithinPartitions("bucket")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings/segment={segment}")
        terms = SearchIndex(self.spark, folder, self.buckets)._read("postings").where((F.col("segment") == segment) & (F.col("bucket") != NO_TERM))
        counted = terms.groupBy("bucket", "term").agg(F.sum("n").alias("df"))
        counted.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/terms/segment={segment}")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(FOLDERS[name]).parquet(f"{self.folder}/{name}")

    def _groups(self) -> DataFrame:
        """(segment, part, n, n_words) of each group of texts."""
        n_words = F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)
        return self._read("postings").where(F.col("bucket") == NO_TERM).select("segment", "part", "n", n_words.alias("n_words"))

    def merge(self, folder: str) -> SearchIndex:
        """All segments as one in another folder: groups of texts that are small become one, and so do files of a bucket. Nothing is
        counted anew."""
        n, n_words = self._groups().agg(F.sum("n"), F.sum("n_words")).first()
        groups = max(1, -(-(n or 0) // BLOCK), -(-(n_words or 0) * 8 // LETTERS))
        part = F.pmod(F.xxhash64("segment", "part"), F.lit(groups))
        dealt = self._read("postings").withColumn("part", part).withColumn("file", F.floor(F.col("part") / FILE)).repartition("bucket", "file")
        rows = dealt.groupBy("bucket", "file", "part").applyInArrow(merged_postings, POSTINGS)
        self._write(rows, folder, 0)
        return SearchIndex(self.spark, folder, self.buckets)

    def _asked(self, queries: DataFrame) -> DataFrame:
        """(query_id, term, times, ats, bucket): the distinct words of each query, how often and where it has them."""
        each = queries.select("query_id", F.posexplode(words(F.col("query"))).alias("at", "term")).groupBy("query_id", "term").agg(F.count("*").alias("times"), F.collect_list("at").alias("ats"))
        return saved(each.withColumn("bucket", self.bucket(F.col("term"))), "asked")

    def _wanted(self, name: str, asked: DataFrame) -> DataFrame:
        """Rows of the words of the queries. The buckets are named in the plan, so that no other folder is read."""
        wanted = [r.bucket for r in asked.select("bucket").distinct().collect()]  # at most all buckets
        return self._read(name).where(F.col("bucket").isin(wanted)).join(asked.select("bucket", "term").distinct(), ["bucket", "term"])

    def _postings(self, asked: DataFrame, places: bool) -> DataFrame:
        """(segment, part, term, ids, tfs, then places or lengths) of the groups that hold a word of a query."""
        return self._wanted("postings", asked).select("segment", "part", "term", "ids", "tfs", "places" if places else "lengths")

    def _by_group(self, asked: DataFrame, places: bool, work: Callable[[pa.Table, pa.Table], pa.Table], found: str) -> DataFrame:
        """What ``work`` finds in each group of texts for about ``QUERIES`` queries at a time: the postings of a group are copied for each
        such part of the queries, the words of the queries for each group."""
        parts = max(1, -(-asked.select("query_id").distinct().count() // QUERIES))
        dealt = F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("queries")
        postings = self._postings(asked, places).join(asked.select("term", dealt).distinct(), "term")
        groups = self._groups().select("segment", "part")  # a row for thousands of texts
        copies = asked.select(*[c for c in asked.columns if c != "bucket"], dealt).crossJoin(F.broadcast(groups))
        keys, kind = ["segment", "part", "queries"], dict(asked.dtypes)["query_id"]
        return postings.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInArrow(work, f"query_id {kind}, id long, {found}")

    def ranked(self, queries: DataFrame, k: int = 10, k1: float = K1, b: float = B, digits: int = 9) -> DataFrame:
        """The k best texts of each query (query_id, query) by BM25: query_id, id, score, rank. Equal scores are in order of ids.

        Words that no text has do not count; a word that a query repeats counts as often. Each group of texts gives k rows a query."""
        asked = self._asked(queries)
        n, n_words = self._groups().agg(F.sum("n"), F.sum("n_words")).first()
        df = self._wanted("terms", asked).groupBy("term").agg(F.sum("df").alias("df"))
        weight = F.ln(1 + (F.lit(n or 0) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weighed = saved(asked.join(df.select("term", weight.alias("weight")), "term"), "weighed")
        found = self._by_group(weighed, False, best_of_group(k, k1, b, digits, n_words / n if n else 1.0), "score double")
        return top_k(found, ["query_id"], [F.desc("score"), F.col("id")], k, "rank")

    def phrases(self, queries: DataFrame) -> DataFrame:
        """Texts that hold the words of a query (query_id, query) one after the other: query_id, id, hits (how often). Queries without
        words find nothing."""
        return self._by_group(self._asked(queries), True, phrases_of_group, "hits long")
