"""Names from a dictionary in texts: a trie of words with failure links finds all of them in one pass over a text."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from larkspur.functions.scalar import words

#: Letters of names in a shard of the dictionary: what a task holds of it at a time.
SHARD = 8 << 20
#: Bytes of texts that are searched at a time; the hits of so much are held in Python.
PIECE = 1 << 20
HITS = "id {id}, text_key long, start int, n_words int, name string"


class NameTrie:
    """Names of one or more words. A node is a prefix of a name; its failure link leads to the longest proper end of it that is
    a prefix too, its output link to the longest one that is a name."""

    def __init__(self, names: Sequence[str]):
        self.words: dict[str, int] = {}
        self.steps: dict[tuple[int, int], int] = {}
        self.name: list[str | None] = [None]
        self.depth = [0]
        children: list[list[tuple[int, int]]] = [[]]
        for name in names:
            node = 0
            for word in name.split(" "):
                key = node, self.words.setdefault(word, len(self.words))
                to = self.steps.get(key)
                if to is None:
                    to = self.steps[key] = len(self.name)
                    children[node].append((key[1], to))
                    children.append([])
                    self.name.append(None)
                    self.depth.append(self.depth[node] + 1)
                node = to
            self.name[node] = name
        self.fail, self.output = [0] * len(self.name), [0] * len(self.name)
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for word, to in children[node]:
                if node:
                    self.fail[to] = self.step(self.fail[node], word)
                self.output[to] = self.fail[to] if self.name[self.fail[to]] is not None else self.output[self.fail[to]]
                queue.append(to)

    def step(self, node: int, word: int) -> int:
        while (to := self.steps.get((node, word))) is None:
            if not node:
                return 0
            node = self.fail[node]
        return to

    def find(self, text: Sequence[str]) -> list[tuple[int, int, str]]:
        """(first word, number of words, name) of all names in a list of words that lie in no longer hit, in order."""
        found, node = [], 0
        for i, word in enumerate(text):
            number = self.words.get(word)
            if number is None:
                node = 0
                continue
            node = self.step(node, number)
            at = node if self.name[node] is not None else self.output[node]
            while at:
                found.append((i + 1 - self.depth[at], self.depth[at], self.name[at]))
                at = self.output[at]
        return uncovered(found)


def uncovered(hits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The hits that lie in no other one."""
    kept, reach = [], -1
    for start, size, name in sorted(hits, key=lambda h: (h[0], -h[1])):
        if start + size > reach:
            kept.append((start, size, name))
            reach = start + size
    return kept


def normalised(names: DataFrame, name: str) -> DataFrame:
    """Distinct names as lower-cased words with single spaces; names without a word are left out."""
    return names.select(F.array_join(words(F.col(name)), " ").alias("name")).where("name <> ''").distinct()


def pieces(batch: pa.RecordBatch, text: str, size: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts of about ``size`` bytes of text; a text is not cut."""
    n_bytes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(n_bytes) // size)) + 1
    for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        if high > low:
            yield batch.slice(low, high - low)


def shards(names: DataFrame, shard: int) -> Iterator[list[str]]:
    """The dictionary in parts of about ``shard`` letters."""
    size = names.agg(F.sum(F.length("name"))).first()[0] or 0
    n = max(1, -(-size // shard))
    for i in range(n):
        part = names.where(F.pmod(F.xxhash64("name"), F.lit(n)) == i) if n > 1 else names
        yield [r.name for r in part.collect()]


def name_hits(df: DataFrame, id_col: str, text: str, names: DataFrame, name: str, shard: int = SHARD) -> DataFrame:
    """Names of the dictionary in the texts: (id, text_key, start, n_words, name), one row per hit; ``start`` counts words from 0.

    Names and texts are compared as lower-cased words. A hit that lies inside a longer one does not count; hits that only
    overlap all do. A dictionary beyond ``shard`` letters is matched in parts, one pass over the texts each, and
    the hits inside longer ones of another part are dropped afterwards. Null and empty texts have no hits; repeated rows have
    theirs each."""
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_key"), F.array_join(words(F.col(text)), " ").alias("words")).where("words <> ''")
    schema = HITS.format(id=dict(rows.dtypes)["id"])

    def hits(part: list[str]) -> DataFrame:
        held: list[NameTrie] = []
        sent = df.sparkSession.sparkContext.broadcast(part)

        def found_in(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            found = [held[0].find(x.split(" ")) for x in batch.column("words").to_pylist()]
            row = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            if not len(row):
                return
            start, size, name = zip(*[h for own in found for h in own])
            yield pa.RecordBatch.from_arrays([
                batch.column("id").take(row), batch.column("text_key").take(row), pa.array(start, pa.int32()), pa.array(size, pa.int32()), pa.array(name)],
                ["id", "text_key", "start", "n_words", "name"])

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if not held:
                held.append(NameTrie(sent.value))
            for batch in batches:
                for piece in pieces(batch, "words", PIECE):
                    yield from found_in(piece)

        return rows.mapInArrow(look, schema)

    parts = [hits(part) for part in shards(normalised(names, name), shard)]
    if len(parts) == 1:
        return parts[0]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionAll(part)
    # a text's hits are no more than its words times the longest name
    end = F.col("start") + F.col("n_words")
    earlier = Window.partitionBy("id", "text_key").orderBy("start", F.desc("n_words")).rowsBetween(Window.unboundedPreceding, -1)
    spans = whole.groupBy("id", "text_key", "start", "n_words", "name").agg(F.count("*").alias("times"))
    reach = F.coalesce(F.max(end).over(earlier), F.lit(-1))
    kept = spans.withColumn("reach", reach).where(end > F.col("reach"))
    return kept.select("id", "text_key", "start", "n_words", "name", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("time")).drop("time")


def name_mentions(hits: DataFrame) -> DataFrame:
    """Per name: n_words, mentions, and the texts that mention it."""
    by_text = hits.groupBy("name", "n_words", "id").agg(F.count("*").alias("n"))
    return by_text.groupBy("name", "n_words").agg(F.sum("n").alias("mentions"), F.count("*").alias("texts"))
