"""Benchmark decontamination with suffix arrays over shards of the training text.

Every run of whole documents (a shard) is sorted into a word suffix array inside the task that holds it. Every suffix
of the benchmark is binary-searched in every shard, which gives its verbatim occurrences with their places; runs of
occurrences on one diagonal are put together to the longest matches. Documents are never shuffled: all that is
known of a document comes from its own shard. The benchmark is the stated query set; it goes to the tasks in blocks
of about ``block_words`` words, one pass for each block, of which only the hit documents' places are written before the
next block is read, so it may be of any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from larkspur.llm.arrays import CHUNK, Texts, Words, chunks, covered, runs, string_batches, words
from larkspur.session import saved

WINDOW = 13
BLOCK_WORDS = 2_000_000
#: A document is contaminated when at least one word in so many is hit.
ONE_IN = 20

FOUND = "n_words long, n_hit long, items array<long>, hits array<struct<word:int, n_words:int>>, matches array<struct<item_id:long, item_word:int, word:int, n_words:int>>"
FOUND_ARROW = pa.struct([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.int64())), ("hits", pa.list_(pa.struct([("word", pa.int32()), ("n_words", pa.int32())]))),
    ("matches", pa.list_(pa.struct([("item_id", pa.int64()), ("item_word", pa.int32()), ("word", pa.int32()), ("n_words", pa.int32())]))),
])


class Queries:
    """All windows of a block of benchmark items, packed for binary search.

    A window is ``window`` consecutive words of an item; an item of fewer words, but some, is one window. Equal windows
    are searched once. Words are numbered from 1; 0 stands for words the benchmark does not have.
    """

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW):
        self.window = window
        column = pa.array([text for _, text in items], pa.large_string())
        seqs: list[np.ndarray] = []
        for part in chunks(column):
            found = words(part)
            seqs += [found.hash[found.first[i]:found.first[i + 1]] for i in range(part.n)]
        self.known = np.unique(np.concatenate(seqs)) if seqs else np.zeros(0, np.uint64)
        self.bits = max(1, int(len(self.known)).bit_length())
        self.per_key = 63 // self.bits
        self.n_keys = -(-window // self.per_key)
        seen: dict[bytes, int] = {}
        rows, sizes, owner, place, which = [], [], [], [], []
        for (item, _), seq in zip(items, seqs):
            ids = np.searchsorted(self.known, seq).astype(np.int64) + 1
            for at in range(max(1, len(ids) - window + 1) if len(ids) else 0):
                part = ids[at:at + window]
                number = seen.setdefault(part.tobytes(), len(rows))
                if number == len(rows):
                    rows.append(np.pad(part, (0, window - len(part))))
                    sizes.append(len(part))
                which.append(number)
                owner.append(item)
                place.append(at)
        self.sizes = np.array(sizes, np.int64)
        self.shortest = int(self.sizes.min()) if len(sizes) else window
        table = np.array(rows, np.int64).reshape(-1, window)
        beyond = np.arange(window)[None, :] >= self.sizes[:, None]
        self.low = self.pack(table)
        self.high = self.pack(np.where(beyond, (1 << self.bits) - 1, table))
        order = np.argsort(which, kind="stable")
        self.owner, self.place = np.array(owner, np.int64)[order], np.array(place, np.int32)[order]
        self.slots = np.searchsorted(np.array(which, np.int64)[order], np.arange(len(rows) + 1))

    def pack(self, table: np.ndarray) -> list[np.ndarray]:
        """Columns of word numbers as a few sort keys, the first words in the highest bits."""
        keys = []
        for j in range(self.n_keys):
            key = np.zeros(len(table), np.int64)
            for k in range(j * self.per_key, (j + 1) * self.per_key):
                key = (key << self.bits) | (table[:, k] if k < self.window else 0)
            keys.append(key)
        return keys


class SuffixArray:
    """Suffixes of the words of a shard, sorted by their first ``window`` words; none goes on into the next document.

    Suffixes that begin with fewer benchmark words than the shortest window has are left out: no window is in them.
    """

    def __init__(self, found: Words, queries: Queries):
        spot = np.searchsorted(queries.known, found.hash)
        spot[spot == len(queries.known)] = 0
        ids = np.where(queries.known[spot] == found.hash, spot + 1, 0).astype(np.int64)
        n = len(ids)
        stop = np.minimum.accumulate(np.where(ids == 0, np.arange(n), n)[::-1])[::-1] if n else np.zeros(0, np.int64)
        left = found.left()
        self.place = np.flatnonzero(np.minimum(stop - np.arange(n), left) >= queries.shortest)
        padded = np.concatenate([ids, np.zeros(queries.window, np.int64)])
        inside = left[self.place]
        keys = []
        for j in range(queries.n_keys):
            key = np.zeros(len(self.place), np.int64)
            for k in range(j * queries.per_key, (j + 1) * queries.per_key):
                word = np.where(inside > k, padded[self.place + k], 0) if k < queries.window else 0
                key = (key << queries.bits) | word
            keys.append(key)
        order = np.lexsort(keys[::-1])
        self.place = self.place[order]
        self.keys = [key[order] for key in keys]

    def search(self, wanted: list[np.ndarray], after: bool) -> np.ndarray:
        """Binary search of many keys at once: how many suffixes lie before each (or up to it, with ``after``)."""
        low = np.zeros(len(wanted[0]), np.int64)
        high = np.full(len(wanted[0]), len(self.place), np.int64)
        while (open_ := low < high).any():
            middle = np.minimum((low + high) // 2, len(self.place) - 1)
            less, equal = np.zeros(len(low), bool), np.ones(len(low), bool)
            for own, want in zip(self.keys, wanted):
                value = own[middle]
                less |= equal & (value < want)
                equal &= value == want
            go = open_ & (less | (equal if after else False))
            low = np.where(go, middle + 1, low)
            high = np.where(open_ & ~go, middle, high)
        return low


def spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[i], begin[i] + 1, ... for count[i] steps, one after the other."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count - begin, count)


def search_shard(part: Texts, queries: Queries, matched: bool = True) -> Iterator[dict]:
    """What is known of each document of a shard: its hit stretches, the items that share a window with it and, if ``matched``, the
    longest matches, which are as many as an item's occurrences times the items that share it."""
    found = words(part)
    counts = found.counts
    hit = np.zeros(len(found.hash), bool)
    places = windows = np.zeros(0, np.int64)
    if len(queries.sizes) and len(found.hash):
        array = SuffixArray(found, queries)
        if len(array.place):
            low, high = array.search(queries.low, False), array.search(queries.high, True)
            windows = np.repeat(np.arange(len(low)), high - low)
            places = array.place[spread(low, high - low)]
            hit = covered(places, queries.sizes[windows], len(hit))
    marks = np.concatenate([[0], np.cumsum(hit)])
    n_hit = marks[found.first[1:]] - marks[found.first[:-1]]
    by_text = np.argsort(found.text[places], kind="stable")
    places, windows = places[by_text], windows[by_text]
    ends = np.searchsorted(found.text[places], np.arange(part.n + 1))
    first, last = runs(hit, found.first)
    cuts = np.searchsorted(first, found.first)
    for i in range(part.n):
        items: list[int] = []
        matches: list[dict] = []
        hits: list[dict] = []
        if n_hit[i]:
            window, place = windows[ends[i]:ends[i + 1]], places[ends[i]:ends[i + 1]] - found.first[i]
            hits = [{"word": int(a), "n_words": int(b)} for a, b in zip(first[cuts[i]:cuts[i + 1]] - found.first[i], (last - first)[cuts[i]:cuts[i + 1]])]
            met = np.unique(window)
            items = np.unique(queries.owner[spread(queries.slots[met], queries.slots[met + 1] - queries.slots[met])]).tolist()
            if matched:
                each = queries.slots[window + 1] - queries.slots[window]
                slot = spread(queries.slots[window], each)
                matches = longest(queries.owner[slot], queries.place[slot], np.repeat(place, each), np.repeat(queries.sizes[window], each))
        yield {"n_words": int(counts[i]), "n_hit": int(n_hit[i]), "items": items, "hits": hits, "matches": matches}


def longest(item: np.ndarray, start: np.ndarray, place: np.ndarray, size: np.ndarray) -> list[dict]:
    """Put windows that follow each other in item and document together to longest verbatim matches."""
    order = np.lexsort((start, place - start, item))
    item, start, place, size = item[order], start[order], place[order], size[order]
    fresh = np.ones(len(item), bool)
    fresh[1:] = (item[1:] != item[:-1]) | (place[1:] - start[1:] != place[:-1] - start[:-1]) | (start[1:] != start[:-1] + 1)
    head = np.flatnonzero(fresh)
    tail = np.concatenate([head[1:], [len(item)]]) - 1
    length = start[tail] + size[tail] - start[head]
    return [
        {"item_id": int(a), "item_word": int(b), "word": int(c), "n_words": int(d)}
        for a, b, c, d in zip(item[head], start[head], place[head], length)
    ]


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of about ``block_words`` words, each read on its own when it is asked for. Items without words are
    left out; there is one block at least."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL AND item_id IS NOT NULL")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-size // (4 * block_words)))
    for i in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) if n > 1 else items
        yield [(r.item_id, r.text) for r in part.distinct().orderBy("item_id", "text").collect()]


def search(docs: DataFrame, items: list[tuple[int, str]], window: int = WINDOW, text: str = "text", column: str = "found", matched: bool = True) -> DataFrame:
    """Add a struct: n_words, n_hit, items (sorted ids with an occurring window), hits (stretches of hit words) and, if ``matched``, the
    longest matches."""
    held: list[Queries] = []
    sent = docs.sparkSession.sparkContext.broadcast(items)

    @F.arrow_udf(FOUND)
    def look(batch: pa.Array) -> pa.Array:
        if not held:
            held.append(Queries(sent.value, window))
        rows = [row for part in chunks(string_batches(batch), 2 * CHUNK) for row in search_shard(part, held[0], matched)]
        return pa.array(rows, FOUND_ARROW)

    return docs.withColumn(column, look(F.col(text)))


def judged(n_words, n_hit):
    return (n_hit > 0) & (n_hit * ONE_IN >= n_words)


def hit_rows(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int, matched: bool) -> DataFrame:
    """key (of id and text), n_words, n_hit, items, matches of the distinct documents that a window of a benchmark of several blocks
    occurs in: each block's are written before the next is read."""
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), "text").dropDuplicates(["key"])
    keyed = saved(keyed, "texts")
    written = None
    for items in blocks(benchmark, block_words):
        found = saved(search(keyed, items, window, matched=matched).where("found.n_hit > 0").select("key", "found.*"), "hits")
        written = found if written is None else written.unionAll(found)
    whole = written.groupBy("key").agg(
        F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("matches")).alias("matches"))
    n_hit = F.aggregate(
        "hits", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda s, m: F.struct(
            F.greatest(s["end"], m["word"] + m["n_words"]).alias("end"),
            (s["n"] + F.greatest(F.lit(0), m["word"] + m["n_words"] - F.greatest(s["end"], m["word"]))).alias("n")),
        lambda s: s["n"])
    return whole.select("key", "n_words", n_hit.alias("n_hit"), "items", "matches")


def several(benchmark: DataFrame, block_words: int) -> tuple[bool, list[tuple[int, str]]]:
    """Whether the benchmark has several blocks, and the first one."""
    parts = blocks(benchmark, block_words)
    first = next(parts)
    return next(parts, None) is not None, first


def overlap(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, matched: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (sorted array), matches, contaminated.

    A word is hit when it lies inside any occurrence of a window. Null and empty texts have no words and are not
    contaminated. Repeated rows give repeated rows. Items with equal ids count as one item with the windows of all their
    texts; null item ids and null item texts are left out; an empty benchmark hits nothing. Extra columns are not read.
    Without ``matched`` the list of longest matches, which grows with the items that share a window, stays empty.
    """
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    more, items = several(benchmark, block_words)
    if not more:
        out = search(slim, items, window, matched=matched).select("doc_id", "found.n_words", "found.n_hit", "found.items", "found.matches")
    else:
        hit = hit_rows(slim, benchmark, window, block_words, matched).drop("n_words")
        counted = search(slim, [], window, matched=False).select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "found.n_words")
        out = counted.join(hit, "key", "left").select(
            "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), "matches")
    return out.withColumn("contaminated", judged(F.col("n_words"), F.col("n_hit")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents that are not contaminated, with all their columns as they were, whatever these are called.

    Hits are judged over the whole benchmark, with several blocks over the words that any of them hits.
    """
    name = "found_"
    while any(c.lower().startswith(name) for c in docs.columns):
        name += "_"
    more, items = several(benchmark, block_words)
    if not more:
        marked = search(docs, items, window, column=name, matched=False)
        return marked.where(~judged(F.col(name)["n_words"], F.col(name)["n_hit"])).drop(name)
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    bad = hit_rows(slim, benchmark, window, block_words, False).where(judged(F.col("n_words"), F.col("n_hit"))).select(F.col("key").alias(name))
    return docs.withColumn(name, F.xxhash64("doc_id", F.col("text").cast("string"))).join(bad, name, "left_anti").select(*docs.columns)
