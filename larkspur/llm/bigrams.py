"""Language-model scoring by cross-entropy difference of two word bigram models.

The models have the same form, one of the target texts and one of all texts, and share one vocabulary: every word of the
corpus. The counts of all words, of all words as the one before, and of all pairs of words are exact and grow with the
corpus; no part of a model is ever in one place. Texts are put into blocks of about ``BLOCK`` bytes, in a table that is bucketed by
block, so that they are not shuffled later. A block sends its distinct keys (62 bits of the hash of a word or pair) in order,
packed by ranges of the keys, with their counts; a bucket, one range of keys, adds up the counts of all blocks and answers each
with the totals of its own keys, in order, so an answer needs no keys. Numbers travel byte by byte, lowest bytes
first: most totals are small, so the others are zeros. A task holds one block or one bucket at a time.

A text's score is its mean loss per word under the target model less that under the background model; the lower, the more like
the target. A text that is counted is scored with its own counts in the models, so labelled texts are favoured by what only
they have; ``score_others`` scores texts that are not counted.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from larkspur.llm.arrays import STEP, Texts, chunks, mix, string_batches, words
from larkspur.llm.jaccard import by_run
from larkspur.session import saved, work_path

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK = 4 << 20
#: Bytes of text for each bucket of keys. Nearly every word of a text is a key of a pair.
BUCKET = 4 << 20
#: Bytes of text for a partition of the table of blocks.
PART = 16 << 20
#: Weight of the unigram estimate in a bigram estimate, in words.
BACKOFF = 64.0
#: Target ids up to this many are broadcast (8 bytes each); beyond it texts and ids are joined by a shuffle.
BROADCAST_IDS = 8_000_000
NAMES = ("target", "background")
#: Stands before the first word of a text.
START = np.uint64(0)
#: The lowest two bits of a key.
WORD, HEAD, PAIR = (np.uint64(k) for k in range(3))


# Blocks

MARKS = ("target", "background", "wanted")
BLOCKS_ARROW = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), *((c, pa.list_(pa.int32())) for c in MARKS), ("data", pa.binary())])


def into_blocks(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``rows`` (doc_id, text, how often a word of the text counts in the target and in the background model, and whether a score
    is wanted) in blocks of whole texts, written to the shared folder and bucketed by block."""
    rows = rows.select("doc_id", "text", *[F.col(c).cast("int").alias(c) for c in MARKS])
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in chunks(string_batches(batch.column("text")), block):
                own = [pa.ListArray.from_arrays([0, part.n], batch.column(c).slice(part.first, part.n)) for c in ("doc_id", *MARKS)]
                sizes = pa.array([np.diff(part.starts)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([number]), own[0], sizes, *own[1:], pa.array([part.data.tobytes()], pa.binary())], schema=BLOCKS_ARROW)
                number += 1

    name = f"larkspur_lm_{uuid.uuid4().hex}"
    columns = "block long, ids array<long>, sizes array<long>, " + ", ".join(f"{c} array<int>" for c in MARKS) + ", data binary"
    parts = max(1, min(-(-size // PART), 50_000))
    writer = rows.mapInArrow(pack, columns).write.bucketBy(parts, "block").option("compression", "zstd")
    writer.option("path", work_path(rows.sparkSession, "lm-blocks")).saveAsTable(name)
    blocks = rows.sparkSession.table(name)
    rows.sparkSession.sql(f"DROP TABLE {name}")  # the name only: the files are outside the warehouse and stay
    return blocks


@dataclass
class Block:
    number: int
    ids: pa.Array
    texts: Texts
    marks: dict[str, np.ndarray]


def blocks_of(batch: pa.RecordBatch) -> Iterator[tuple[int, Block]]:
    for i in range(batch.num_rows):
        starts = np.concatenate([[0], np.cumsum(batch.column("sizes")[i].values.to_numpy())]).astype(np.int64)
        texts = Texts(0, np.frombuffer(batch.column("data")[i].as_buffer(), np.uint8), starts)
        yield i, Block(batch.column("block")[i].as_py(), batch.column("ids")[i].values, texts, {c: batch.column(c)[i].values.to_numpy() for c in MARKS})


# Keys

@dataclass
class Bigrams:
    """Distinct words, words before, and pairs of some texts as keys in order with their counts; for each word of the texts its
    text and the places of the three among the keys."""

    key: np.ndarray
    counts: list[np.ndarray]
    text: np.ndarray
    word: np.ndarray
    head: np.ndarray
    pair: np.ndarray


def key_of(value: np.ndarray, kind: np.uint64) -> np.ndarray:
    return value & ~np.uint64(3) | kind


def distinct(value: np.ndarray, kind: np.uint64, weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Keys in order, the place of each value among them, and their sums of each weight."""
    key, place = np.unique(key_of(value, kind), return_inverse=True)
    return key, place.astype(np.int32), [np.bincount(place, w, len(key)).astype(np.int64) for w in weights]


def bigrams(block: Block) -> Bigrams:
    """Arrays go as soon as they are used and places are 32 bits wide: a task holds these beside the texts."""
    found = words(block.texts)
    text, own = found.text.astype(np.int32), found.hash
    del found
    weights = [block.marks[c][text] for c in NAMES]
    before = np.concatenate([[START], own[:-1]])[:len(own)]
    before[1:][text[1:] != text[:-1]] = START
    pair = distinct(mix(before * STEP + own), PAIR, weights)
    head = distinct(before, HEAD, weights)
    del before
    word = distinct(own, WORD, weights)
    del own, weights
    key = np.concatenate([word[0], head[0], pair[0]])
    order = np.argsort(key)
    rank = np.empty(len(key), np.int32)
    rank[order] = np.arange(len(key), dtype=np.int32)
    counts = [np.concatenate(c)[order] for c in zip(word[2], head[2], pair[2])]
    ends = len(word[0]), len(word[0]) + len(head[0])
    return Bigrams(key[order], counts, text, rank[:ends[0]][word[1]], rank[ends[0]:ends[1]][head[1]], rank[ends[1]:][pair[1]])


def packed(numbers: np.ndarray) -> bytes:
    """First all lowest bytes, then the next ones, as far as any is not 0."""
    wide = numbers.astype(np.int64).view(np.uint8).reshape(-1, 8)
    width = 8
    while width > 1 and not wide[:, width - 1].any():
        width -= 1
    return bytes([width]) + wide[:, :width].T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    wide = np.zeros(((len(data) - 1) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1).T
    return wide.view(np.int64).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return packed(np.diff(keys, prepend=np.uint64(0)).view(np.int64))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data).view(np.uint64), dtype=np.uint64)


def spans_of(key: np.ndarray, n_buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, begin, end) of the ranges that some sorted keys fall into."""
    bucket = ((key >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(key)] if len(key) else [0]
    return [(int(bucket[a]), a, b) for a, b in zip(cuts[:-1], cuts[1:])]


SENT = "bucket long, block long, wanted boolean, keys binary, target binary, background binary"
ANSWERS = "bucket long, block long, target binary, background binary, sizes array<long>"


def sent_keys(blocks: DataFrame, n_buckets: int) -> DataFrame:
    """What each block sends to each bucket: its distinct keys in order and their counts."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, block in blocks_of(batch):
                found = bigrams(block)
                wanted = bool(block.marks["wanted"].any())
                spans = spans_of(found.key, n_buckets)
                if spans:
                    yield pa.RecordBatch.from_arrays([
                        pa.array([s[0] for s in spans]), pa.array([block.number] * len(spans)), pa.array([wanted] * len(spans)),
                        pa.array([packed_keys(found.key[a:b]) for _, a, b in spans], pa.binary()),
                        *(pa.array([packed(c[a:b]) for _, a, b in spans], pa.binary()) for c in found.counts)], ["bucket", "block", "wanted", "keys", *NAMES])

    return blocks.mapInArrow(send, SENT)


def sizes(key: np.ndarray, totals: list[np.ndarray]) -> list[int]:
    """Distinct background words and pairs, and the numbers of target and background words."""
    kind = key & np.uint64(3)
    return [int(((kind == k) & (totals[1] > 0)).sum()) for k in (WORD, PAIR)] + [int(t[kind == WORD].sum()) for t in totals]


def answers(sent: DataFrame) -> DataFrame:
    """For each block and bucket the totals of the block's keys in order, and one row a bucket, without a block, that has its sizes."""
    schema = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), *((c, pa.binary()) for c in NAMES), ("sizes", pa.list_(pa.int64()))])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_run(batches, ["bucket"]):
            lists = [unpacked_keys(x) for x in rows["keys"].to_pylist()]
            ends = np.cumsum([len(x) for x in lists])
            some, group = np.unique(np.concatenate(lists), return_inverse=True)
            group = group.astype(np.int32)
            totals = []
            for c in NAMES:
                counts = np.concatenate([unpacked(x) for x in rows[c].to_pylist()])
                totals.append(np.bincount(group, counts, len(some)).astype(np.int64))
                del counts
            bucket = rows["bucket"][0].as_py()
            told = [(bucket, block, *(packed(t[group[e - len(x):e]]) for t in totals), None) for block, wanted, x, e in zip(rows["block"].to_pylist(), rows["wanted"].to_pylist(), lists, ends) if wanted]
            del lists, group
            told.append((bucket, None, None, None, sizes(some, totals)))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*told), schema)], schema=schema)

    return saved(sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(answer, ANSWERS), "lm-answers")


def summed(replies: DataFrame) -> list[int]:
    """The sizes of all buckets added up."""
    each = [F.sum(F.col("sizes")[i]) for i in range(4)]
    return [x or 0 for x in replies.where("block IS NULL").agg(*each).first()]


# Scores

SCORES = "doc_id long, n_words long, target_loss double, background_loss double"


def weighted_scores(rows: DataFrame, block: int, bucket: int) -> DataFrame:
    """Scores of the wanted ``rows`` under the models of all of them; see :func:`into_blocks`.

    P(word | before) = (pair + BACKOFF * P(word)) / (head + BACKOFF) and P(word) = (count + 1) / (total + words + 1): one
    more word stands for all unknown ones.
    """
    blocks = into_blocks(rows, block)
    size = blocks.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    n_buckets = max(1, -(-size // bucket))
    replies = answers(sent_keys(blocks, n_buckets))
    n_words, _, *totals = summed(replies)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, block in blocks_of(batch):
                wanted = np.flatnonzero(block.marks["wanted"])
                if not len(wanted):
                    continue
                found = bigrams(block)
                places = {b: slice(x, y) for b, x, y in spans_of(found.key, n_buckets)}
                n = np.bincount(found.text, minlength=block.texts.n)
                told = batch.column("answers")[i]
                means = []
                for name, total in zip(NAMES, totals):
                    counts = np.zeros(len(found.key), np.int64)
                    for reply in told if told.is_valid else []:
                        counts[places[reply["bucket"].as_py()]] = unpacked(reply[name].as_py())
                    single = (counts[found.word] + 1.0) / (total + n_words + 1.0)
                    losses = -np.log((counts[found.pair] + BACKOFF * single) / (counts[found.head] + BACKOFF))
                    means.append((np.bincount(found.text, losses, block.texts.n) / np.maximum(n, 1))[wanted])
                none = n[wanted] == 0
                yield pa.RecordBatch.from_arrays([block.ids.take(pa.array(wanted)), pa.array(n[wanted]), *(pa.array(x, mask=none) for x in means)], ["doc_id", "n_words", "target_loss", "background_loss"])

    told = replies.where("block IS NOT NULL").groupBy("block").agg(F.collect_list(F.struct("bucket", *NAMES)).alias("answers"))
    return blocks.join(told, "block", "left").mapInArrow(look, SCORES).withColumn("score", F.col("target_loss") - F.col("background_loss"))


def slim(docs: DataFrame) -> DataFrame:
    """doc_id and text; a null text has no words, as the empty one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def corpus_rows(docs: DataFrame, target: DataFrame, wanted: bool) -> DataFrame:
    """The documents as rows that count: all of them in the background, those with a doc_id of ``target`` in the target."""
    ids = saved(target.select(F.col("doc_id").alias("target_id")).where("target_id IS NOT NULL").distinct(), "lm-target")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    rows = slim(docs).join(ids, F.col("doc_id") == F.col("target_id"), "left")
    return rows.select("doc_id", "text", F.isnotnull("target_id").cast("int").alias("target"), F.lit(1).alias("background"), F.lit(wanted).alias("wanted"))


def target_ids(labels: DataFrame) -> DataFrame:
    """Documents labelled as good and never as bad."""
    return labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("low")).where("low >= 1").select("doc_id")


def cross_entropy_difference(docs: DataFrame, labels: DataFrame, block: int = BLOCK, bucket: int = BUCKET) -> DataFrame:
    """One row per document: doc_id, n_words, target_loss, background_loss, score.

    Texts without words, null texts among them, have 0 words and null losses and score. Repeated rows are counted as often
    as they occur and get equal results. Without target texts the target model is even over the vocabulary. Extra
    columns are not read. Words and pairs are told apart by 62 bits of their hash.
    """
    return weighted_scores(corpus_rows(docs, target_ids(labels), True), block, bucket)


def score_others(docs: DataFrame, corpus: DataFrame, target: DataFrame, block: int = BLOCK, bucket: int = BUCKET) -> DataFrame:
    """Scores of documents that are not counted, in the same form, under the models of ``corpus`` and of its documents with
    the doc_ids of ``target``."""
    others = slim(docs).select("doc_id", "text", F.lit(0).alias("target"), F.lit(0).alias("background"), F.lit(True).alias("wanted"))
    return weighted_scores(corpus_rows(corpus, target, False).unionAll(others), block, bucket)
