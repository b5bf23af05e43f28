"""Alignment of the tokens that two tokenizers make of the same texts.

Both make tokens of the same bytes, so a token is known by the offset at which it ends. The two sorted arrays of ends are
compared at the current shift of their indexes: a probe looks at 1, 2, 4, ... ends at once and jumps over all that agree, so
stretches of one token to one cost few steps. Where a probe fails, the irregular group is resolved on the spot by
going on in the side that lags, until both end at one offset; that gives the new shift. A chunk of texts is cut into lanes
of equal length which take these steps together.

How many documents hold a pair of linked ids is counted over the corpus. The pairs are bounded by the two
vocabularies, not by the corpus; they are looked up in slices of at most ``SLICE`` pairs, one pass over the documents' pairs each.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from larkspur.llm.arrays import string_batches
from larkspur.session import saved

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
#: Tokens of a lane, and bytes of a chunk of whole texts.
LANE, CHUNK = 128, 1 << 20
#: Pairs of ids that are sent to all tasks at once: 17 bytes each, so 36 MB.
SLICE = 1 << 21
#: How texts are cut into words before the merges of the byte-level vocabulary: a fixed value of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBPE:
    """A byte-level vocabulary (the text of its json file). A merge of two tokens has the rank of the token it gives."""

    def __init__(self, raw: bytes):
        import tiktoken

        model = json.loads(raw)
        special = {x["id"] for x in model.get("added_tokens", [])}
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items() if i not in special}
        self.size = max(ranks.values()) + 1
        self.bytes = [b""] * self.size
        for token, i in ranks.items():
            self.bytes[i] = token
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.encoding.encode_ordinary(" " + x) for x in texts]


class PieceBPE:
    """A piece model (the bytes of its file), which puts a space before the text by itself."""

    def __init__(self, raw: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.size = self.model.get_piece_size()
        self.bytes = [
            bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()
            for i, piece in enumerate(map(self.model.id_to_piece, range(self.size)))]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Pair:
    """Both tokenizers, with tables of the bytes and the decimals of their ids."""

    def __init__(self, a: bytes, b: bytes):
        self.a, self.b = ByteBPE(a), PieceBPE(b)
        self.len_a, self.len_b = (np.array([len(x) for x in side.bytes], np.int64) for side in (self.a, self.b))
        self.code = np.uint32 if self.a.size * self.b.size <= 1 << 32 else np.int64
        self.words = [b"%d%s" % (i, end) for side, ends in ((self.a, (b",", b"|")), (self.b, (b",", b";"))) for end in ends for i in range(side.size)]


@lru_cache(1)
def loaded(a: bytes, b: bytes) -> Pair:
    return Pair(a, b)


def spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[i], begin[i] + 1, ... for count[i] steps, one after the other."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count - begin, count)


def common_ends(a: np.ndarray, b: np.ndarray, lane: int = LANE) -> np.ndarray:
    """For each end of the increasing ``a`` the place of the equal end in the increasing ``b``, or -1."""
    out = np.full(len(a), -1, np.int64)
    if not len(a) or not len(b):
        return out
    i = np.arange(0, len(a), lane)
    stop = np.minimum(i + lane, len(a))
    j = np.searchsorted(b, a[i])
    step = np.ones(len(i), np.int64)

    def still(*columns: np.ndarray) -> list[np.ndarray]:
        open_ = (columns[0] < columns[1]) & (columns[2] < len(b))
        return [c[open_] for c in columns]

    i, stop, j, step = still(i, stop, j, step)
    while len(i):
        wide = np.minimum(np.minimum(step, stop - i), len(b) - j)
        at = spread(i, wide)
        head = np.cumsum(wide) - wide
        differ = a[at] != b[at + np.repeat(j - i, wide)]
        first = np.minimum.reduceat(np.where(differ, at - np.repeat(i, wide), lane), head)
        run = np.minimum(first, wide)
        agreed = spread(i, run)
        out[agreed] = agreed + np.repeat(j - i, run)
        i, j, step = i + run, j + run, np.where(run == wide, 2 * step, 1)
        failed = run < wide
        lag = np.flatnonzero(failed)
        while len(lag):  # irregular groups: go on in the side that lags until both end together
            x, y = a[i[lag]], b[j[lag]]
            i[lag] += x < y
            j[lag] += x > y
            lag = lag[x != y]
            lag = lag[(i[lag] < stop[lag]) & (j[lag] < len(b))]
        i, stop, j, step = still(i, stop, j, step)
    return out


def encoded(column: pa.Array, pair: Pair) -> Iterator[tuple[np.ndarray, list[list[int]], list[list[int]]]]:
    """Chunks of whole texts: which texts have tokens, and their ids by either tokenizer. A text that is null, empty, or whose
    tokens do not give its bytes, has none."""
    raw = column.cast(pa.large_binary())
    sizes = raw.fill_null(b"").cast(pa.large_binary())
    lengths = np.diff(np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset:sizes.offset + len(sizes) + 1])
    ends = np.cumsum(lengths)
    at = 0
    while at < len(raw):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
        some = np.flatnonzero(lengths[at:to])
        data = [raw[at + int(k)].as_py() for k in some]
        texts = [x.decode("utf-8", "replace") for x in data]
        a, b = pair.a.encode(texts), pair.b.encode(texts)
        good = [
            k for k, x in enumerate(data)
            if b"".join(map(pair.a.bytes.__getitem__, a[k])) == b" " + x and b"".join(map(pair.b.bytes.__getitem__, b[k])) == b" " + x]
        yield (to - at, some[good]), [a[k] for k in good], [b[k] for k in good]
        at = to


def align_chunk(a_ids: list[list[int]], b_ids: list[list[int]], pair: Pair, spell: bool) -> dict[str, list]:
    """What is known of each text of a chunk that has tokens."""
    n = len(a_ids)
    n_a, n_b = np.array([len(x) for x in a_ids], np.int64), np.array([len(x) for x in b_ids], np.int64)
    a, b = (np.concatenate([np.array(x, np.int64) for x in ids]) if n else np.zeros(0, np.int64) for ids in (a_ids, b_ids))
    end_a, end_b = np.cumsum(pair.len_a[a]), np.cumsum(pair.len_b[b])
    to = common_ends(end_a, end_b)
    both_a = to >= 0
    both_b = np.zeros(len(b), bool)
    both_b[to[both_a]] = True
    first_a, first_b = np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_b)])
    text_a = np.repeat(np.arange(n), n_a)
    n_groups = np.bincount(text_a[both_a], minlength=n)

    # Every stretch between two neighbouring ends of either side is one link.
    cuts = np.sort(np.concatenate([end_a, end_b[~both_b]]), kind="stable")
    link_a, link_b = np.searchsorted(end_a, cuts), np.searchsorted(end_b, cuts)
    key = np.sort(text_a[link_a] << 44 | a[link_a] * pair.b.size + b[link_b])
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    heads = np.flatnonzero(fresh)
    times = np.diff(np.concatenate([heads, [len(key)]])).astype(np.uint32)
    codes = (key[heads] & ((1 << 44) - 1)).astype(pair.code)
    cut = np.searchsorted(key[heads] >> 44, np.arange(n + 1))

    # The tokens of a group stand together: those of A, then those of B.
    group_a, group_b = np.cumsum(both_a) - both_a, np.cumsum(both_b) - both_b
    ends_a, ends_b = np.flatnonzero(both_a) + 1, np.flatnonzero(both_b) + 1
    words = np.empty(len(a) + len(b), np.int64)
    words[np.arange(len(a)) + np.concatenate([[0], ends_b])[group_a]] = a + both_a * pair.a.size
    words[np.arange(len(b)) + ends_a[group_b]] = 2 * pair.a.size + b + both_b * pair.b.size
    both = first_a + first_b
    out: dict[str, list] = {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_a + n_b - n_groups, "sha": [], "codes": [], "times": [], "groups": []}
    for k in range(n):
        told = b"".join(map(pair.words.__getitem__, words[both[k]:both[k + 1]].tolist()))[:-1]
        out["sha"].append(hashlib.sha256(told).hexdigest())
        out["codes"].append(codes[cut[k]:cut[k + 1]].tobytes())
        out["times"].append(times[cut[k]:cut[k + 1]].tobytes())
        out["groups"].append(told.decode() if spell else None)
    return out


ALIGNED = "doc_id long, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, codes binary, times binary"
ALIGNED_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("row", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
    ("groups_sha256", pa.string()), ("groups", pa.string()), ("codes", pa.binary()), ("times", pa.binary())])


def aligned(docs: DataFrame, a: bytes, b: bytes, spell: bool = False) -> DataFrame:
    """One row per document: counts, the groups (spelled out with ``spell``) and, packed, the distinct pairs of linked ids (A's id
    times the size of B's vocabulary plus B's id) with how often they are linked."""
    sent = docs.sparkSession.sparkContext.broadcast((a, b))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = loaded(*sent.value)
        for batch in batches:
            ids, rows, at = batch.column("doc_id"), batch.column("row"), 0
            for (size, good), a_ids, b_ids in encoded(string_batches(batch.column("text")), pair):
                found = align_chunk(a_ids, b_ids, pair, spell)
                numbers = [np.zeros(size, np.int64) for _ in range(4)]
                for column, name in zip(numbers, ("n_a", "n_b", "n_groups", "n_links")):
                    column[good] = found[name]
                texts: list[list] = [[""] * size, [""] * size, [b""] * size, [b""] * size]
                for column, name in zip(texts, ("sha", "groups", "codes", "times")):
                    for k, value in zip(good.tolist(), found[name]):
                        column[k] = value
                yield pa.RecordBatch.from_arrays([
                    ids.slice(at, size), rows.slice(at, size), *map(pa.array, numbers),
                    pa.array(texts[0]), pa.array(texts[1], pa.string()), pa.array(texts[2], pa.binary()), pa.array(texts[3], pa.binary())], schema=ALIGNED_ARROW)
                at += size

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, ALIGNED)


def unpack(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a column of packed arrays one after the other, and the row of each."""
    column = string_batches(column).cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]].view(kind)
    return data, np.repeat(np.arange(len(column)), np.diff(offsets) // np.dtype(kind).itemsize)


def pair_counts(rows: DataFrame, b_size: int, kind: type) -> DataFrame:
    """One row per linked pair of ids: code, a, b, n (documents that hold it linked), best (none of A's pairs has more)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, n = np.unique(unpack(batch.column("codes"), kind)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(n)], ["code", "n"])

    counts = rows.select("codes").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    told = counts.select("code", F.expr(f"code div {b_size}").alias("a"), F.pmod("code", F.lit(b_size)).alias("b"), "n")
    return told.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a")))


def slices(pairs: DataFrame, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The pairs in ranges of codes with at most about ``limit`` pairs each: codes, counts, best."""
    total = pairs.count()
    bounds = pairs.approxQuantile("code", [k * limit / total for k in range(1, -(-total // limit))], 0.01) if total > limit else []
    for low, high in zip([None, *bounds], [*bounds, None]):
        part = pairs if low is None else pairs.where(F.col("code") > low)
        part = part if high is None else part.where(F.col("code") <= high)
        table = part.select("code", "n", "best").toArrow().sort_by("code")
        yield tuple(table[c].to_numpy() for c in ("code", "n", "best"))


def scored(rows: DataFrame, known: tuple[np.ndarray, np.ndarray, np.ndarray], kind: type, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with n_best and count_sum by the pairs of one slice."""
    sent = rows.sparkSession.sparkContext.broadcast(known)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, n, best = sent.value
        for batch in batches:
            own, row = unpack(batch.column("codes"), kind)
            times = unpack(batch.column("times"), np.uint32)[0]
            at = np.minimum(np.searchsorted(code, own.astype(np.int64)), len(code) - 1)
            links = np.where(code[at] == own, times, 0).astype(np.int64)
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            sums = [np.concatenate([[0], np.cumsum(links * value[at])]) for value in (best, n)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *[pa.array(x[ends[1:]] - x[ends[:-1]]) for x in sums]], [*keep, "n_best", "count_sum"])

    kinds = dict(rows.dtypes)
    return rows.select(*keep, "codes", "times").mapInArrow(look, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", n_best long, count_sum long")


def files(a: str = BYTE_BPE, b: str = PIECE_BPE) -> tuple[bytes, bytes]:
    """The two vocabulary files; the driver reads them and sends them along (about 2 MB)."""
    with open(a, "rb") as x, open(b, "rb") as y:
        return x.read(), y.read()


def align(docs: DataFrame, a: str = BYTE_BPE, b: str = PIECE_BPE, spell: bool = False, limit: int = SLICE) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, with ``spell`` groups) and the linked
    pairs of the corpus (code, a, b, n, best).

    Null and empty texts, and texts that either tokenizer does not give back byte for byte, have no tokens: zeros and an empty string. A
    repeated row counts as a document of its own in the counts and gets equal results. A null doc_id is kept. Very
    long texts are aligned whole. An empty table gives no rows. Extra columns are not read. ``a`` and ``b`` are paths on the driver.
    """
    spark: SparkSession = docs.sparkSession
    raw = files(a, b)
    rows = saved(aligned(docs, *raw, spell), "aligned")
    pair = loaded(*raw)
    pairs = saved(pair_counts(rows, pair.b.size, pair.code), "pairs")
    keep = [c for c in rows.columns if c not in ("codes", "times", "row") and (spell or c != "groups")]
    if pairs.isEmpty():
        return rows.select(*keep, F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum")), pairs
    if pairs.count() <= limit:
        return scored(rows, next(slices(pairs, limit)), pair.code, keep), pairs
    sums = [saved(scored(rows, known, pair.code, ["row"]), "scores") for known in slices(pairs, limit)]
    total = reduce(DataFrame.unionAll, sums).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return rows.select("row", *keep).join(total, "row").drop("row"), pairs


def aligned_documents(docs: DataFrame) -> DataFrame:
    """The documents of :func:`align` in the order of columns of the query."""
    found, _ = align(docs)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
