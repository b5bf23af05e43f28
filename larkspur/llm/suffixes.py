"""Removal of repeated byte strings with suffix arrays made by induced sorting, shard by shard.

A string of ``WINDOW`` bytes is dealt by its content: the least hash of the ``GRAM``-byte strings in it is its key. Neighbouring
windows mostly share a key, so a text is a row of runs of windows, about one run for 16 bytes. Only keys that documents share
matter, which is found out from the runs' hashes alone: blocks of texts send (key, hash of the run's bytes, least doc_id) to
buckets of keys and get back a verdict. Equal runs collapse to that of the smallest doc_id. The more text there is, the
more often a ``GRAM``-byte string is in documents that share no window, so runs are compared by two more hashes: a window has
at least ``SIDE`` bytes before or behind the string of its key, so different runs that share one have the string with the
``SIDE`` bytes before it, or with those behind it, in common. The bytes of the runs of which this holds go to the key's
shard, which sorts all their suffixes and finds every window that another run has as well:

* suffixes are classified as S (smaller than the next) or L, the leftmost S of each stretch (LMS) begins a substring;
* the LMS substrings are sorted by inducing, named, and the string of names is sorted recursively;
* from the sorted LMS suffixes the order of all others is induced, bucket by bucket, in one pass for L and one for S;
* common prefixes are computed in text order (permuted): only where the preceding bytes differ is anything compared, all
  others are one less than the one before.

Texts stay in a table of blocks that is bucketed by block, so they are not shuffled when answers come back.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from larkspur.llm.arrays import STEP, Hashes, Texts, chunks, covered, mix, runs, string_batches
from larkspur.llm.jaccard import by_run
from larkspur.session import saved, work_path

WINDOW, GRAM = 50, 20
#: Every window has as many bytes before the string of its key, or behind it.
SIDE = (WINDOW - GRAM) // 2
#: Bytes of text in a block, for a bucket of keys and for a partition of the table of blocks.
BLOCK, BUCKET, PART = 2 << 20, 16 << 20, 16 << 20
#: A key with more different wanted runs than this deals out their windows one by one, by their own content. Runs
#: that begin with one occurrence of their key's string have 80 bytes at most; a key without others may have more of them.
SPLIT, SPLIT_SHORT = 4096, 65536
#: Bytes whose suffixes are sorted together, few enough for a processor's cache.
SORTED = 512 << 10
#: Windows whose hashes are computed together; these arrays fit into a processor's cache.
PIECE = 1 << 17
#: Alphabets up to this size are sorted by inducing; larger ones have mostly different names and are sorted by doubling.
ALPHABET = 4096
#: Bits for a place in a block.
ROW = 40
LAST = np.iinfo(np.int64).max


# Suffix arrays

def s_types(text: np.ndarray) -> np.ndarray:
    """Marks of the suffixes that are smaller than the next one; the empty suffix is the smallest."""
    n = len(text)
    out = np.zeros(n, bool)
    if n > 1:
        differ = np.flatnonzero(text[1:] != text[:-1])
        nxt = np.searchsorted(differ, np.arange(n))
        inside = nxt < len(differ)
        at = differ[nxt[inside]]
        out[inside] = text[at] < text[at + 1]
    return out


def chained(base: np.ndarray, run_start: np.ndarray) -> np.ndarray:
    """The entries of a bucket and those that they induce in it, one round after the other: a suffix induces its neighbour to the
    left as long as that begins with the same letter."""
    back = base - run_start[base]
    if not back.any():
        return base
    count = back + 1
    rounds = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return (np.repeat(base, count) - rounds)[np.argsort(rounds, kind="stable")]


def induced(text: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """Order of all suffixes from the LMS suffixes in order (or, for unsorted ones, the order by LMS substrings)."""
    n = len(text)
    counts = np.bincount(text, minlength=size)
    end = np.cumsum(counts)
    start = end - counts
    new = np.ones(n, bool)
    new[1:] = text[1:] != text[:-1]
    run_start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    order = np.full(n, -1, np.int64)

    def put(suffix: np.ndarray, at: np.ndarray, sign: int) -> None:
        letter = text[suffix]
        by = np.argsort(letter, kind="stable")
        letter, each = letter[by], np.bincount(letter, minlength=size)
        place = np.arange(len(by)) - (np.cumsum(each) - each)[letter]
        order[at[letter] + place if sign > 0 else at[letter] - 1 - place] = suffix[by]
        at += sign * each

    def neighbours(entries: np.ndarray) -> np.ndarray:
        left = entries[(entries > 0) & (entries == run_start[entries])] - 1
        return left

    first_lms = end - np.bincount(text[lms], minlength=size)
    put(lms, first_lms.copy(), 1)
    some = np.flatnonzero(counts)
    head = start.copy()
    put(np.array([n - 1]), head, 1)
    for c in some.tolist():
        entries = chained(order[start[c]:head[c]], run_start)
        head[c] = start[c] + len(entries)
        order[start[c]:head[c]] = entries
        left = neighbours(entries)
        put(left[text[left] > c], head, 1)
        put(neighbours(order[first_lms[c]:end[c]]), head, 1)
    tail = end.copy()
    for c in some[::-1].tolist():
        entries = chained(order[tail[c]:end[c]][::-1], run_start)
        tail[c] = end[c] - len(entries)
        order[tail[c]:end[c]] = entries[::-1]
        for part in (entries, order[start[c]:head[c]][::-1]):
            left = neighbours(part)
            put(left[text[left] < c], tail, -1)
    return order


def doubled(names: np.ndarray) -> np.ndarray:
    """Order of all suffixes of a string of dense names, by the names of pairs of names."""
    rank, width = names.astype(np.int64), 1
    while True:
        second = np.zeros(len(rank), np.int64)
        second[:max(len(rank) - width, 0)] = rank[width:] + 1
        key = rank * (len(rank) + 1) + second
        order = np.argsort(key, kind="stable")
        fresh = np.zeros(len(rank), np.int64)
        fresh[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty(len(rank), np.int64)
        rank[order] = np.cumsum(fresh)
        if not len(rank) or rank[order[-1]] == len(rank) - 1:
            return order
        width *= 2


def suffix_array(text: np.ndarray, size: int) -> np.ndarray:
    """Suffixes of a string of letters below ``size`` in order; a suffix that begins another one stands before it."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    if size > max(257, min(ALPHABET, n // 256)):
        return doubled(text)
    small = s_types(text)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = small[1:] & ~small[:-1]
    lms = np.flatnonzero(is_lms)
    if len(lms) < 2:
        return induced(text, lms, size)
    order = induced(text, lms, size)
    order = order[is_lms[order]]
    stop = np.empty(n, np.int64)
    stop[lms] = np.append(lms[1:] + 1, n)
    length, value = stop[order] - order, Hashes(text).of(order, stop[order])
    fresh = np.ones(len(order), bool)
    fresh[1:] = (length[1:] != length[:-1]) | (value[1:] != value[:-1])
    fresh |= order == lms[-1]
    fresh[1:] |= order[:-1] == lms[-1]
    name = np.cumsum(fresh) - 1
    if name[-1] < len(lms) - 1:
        names = np.empty(n, np.int64)
        names[order] = name
        order = lms[suffix_array(names[lms], int(name[-1]) + 1)]
    return induced(text, order, size)


def common_prefixes(text: np.ndarray, data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place how many bytes its suffix has in common with the one before it in the order (permuted: in text order)."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    place = np.arange(n)
    free = np.ones(n, bool)
    free[1:] = (before[1:] <= 0) | (text[:-1] != text[before[1:] - 1])
    words = np.ndarray((n,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).tobytes(), 0, (1,)).copy()
    x = np.flatnonzero(free & (before >= 0))
    y, known = before[x], np.zeros(n, np.int64)
    at = np.zeros(len(x), np.int64)
    while len(x):
        differ = words[x + at] ^ words[y + at]
        same = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3
        at += np.where(differ == 0, 8, same)
        room = n - np.maximum(x, y)
        done = (differ != 0) | (at >= room)
        known[x[done]] = np.minimum(at, room)[done]
        x, y, at = x[~done], y[~done], at[~done]
    last = np.maximum.accumulate(np.where(free, place, 0))
    return np.maximum(known[last] - (place - last), 0)


def spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[i], begin[i] + 1, ... for count[i] steps, one after the other."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count - begin, count)


def repeated_windows(data: np.ndarray, length: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strings one after the other, each of a document. Number and offset of every window that a string of a document with
    a smaller doc_id has too."""
    begin = np.cumsum(length + 1) - length - 1
    text = np.zeros(int((length + 1).sum()), np.uint16)
    inside = spread(begin, length)
    text[inside] = data.astype(np.uint16) + 1
    raw = np.zeros(len(text), np.uint8)
    raw[inside] = data
    owner = np.repeat(np.arange(len(length)), length + 1)
    left = begin[owner] + length[owner] - np.arange(len(text))
    order = suffix_array(text, 257)
    common = np.minimum(common_prefixes(text, raw, order), left)[order]
    common[1:] = np.minimum(common[1:], left[order[:-1]])
    head = np.flatnonzero(common < WINDOW)
    own = doc[owner[order]]
    least = np.repeat(np.minimum.reduceat(own, head), np.diff(np.append(head, len(order)))) if len(order) else own
    hit = np.sort(order[(own > least) & (left[order] >= WINDOW)])
    return owner[hit], hit - begin[owner[hit]]


# Runs of windows

class Runs:
    """Runs of windows with one key in some texts: key, hash of the bytes, begin, end (of the bytes), number of the text, and
    sides: hashes of the key's string with the bytes before it and with those behind it, 0 where a run has not as many. Both
    are 0 where not all windows of a run begin with the same occurrence of the string: such a run may share a window with any other."""

    def __init__(self, part: Texts):
        data, starts = part.data, part.starts
        found: list[tuple[np.ndarray, ...]] = []
        bits = np.uint64((PIECE + WINDOW).bit_length())
        for at in range(0, len(data) - WINDOW + 1, PIECE):
            to = min(at + PIECE, len(data) - WINDOW + 1)
            hashes = Hashes(data[at:to + WINDOW - 1])
            least = mix((hashes.sums[GRAM:] - hashes.sums[:-GRAM]) * hashes.down[:to - at + WINDOW - GRAM])
            least = (least >> bits << bits) | np.arange(len(least), dtype=np.uint64)  # the first of equal strings is the least
            have, all_ = 1, WINDOW - GRAM + 1
            while have < all_:
                step = min(have, all_ - have)
                least = np.minimum(least[:-step], least[step:])
                have += step
            some = slice(np.searchsorted(starts, at, "right") - 1, np.searchsorted(starts, to))
            low, high = np.clip(starts[:-1][some], at, to) - at, np.clip(starts[1:][some] - WINDOW + 1, at, to) - at
            inside = covered(low[low < high], (high - low)[low < high], to - at)
            key, gram = least >> bits, least & ((np.uint64(1) << bits) - np.uint64(1))
            same = np.zeros(to - at + 1, bool)
            same[1:-1] = (key[1:] == key[:-1]) & inside[1:] & inside[:-1]
            head, last = np.flatnonzero(inside & ~same[:-1]), np.flatnonzero(inside & ~same[1:])
            if not len(head):
                continue
            begin, end = head, last + WINDOW
            first, one = gram[head].astype(np.int64), gram[head] == gram[last]
            sides = np.zeros((len(head), 2), np.uint16)
            for k, (low, high) in enumerate(((first - SIDE, first + GRAM), (first, first + GRAM + SIDE))):
                some = np.flatnonzero(one & (low >= begin) & (high <= end))
                sides[some, k] = np.maximum(hashes.of(low[some], high[some]) >> np.uint64(48), np.uint64(1))
            found.append((mix(key[head] ^ STEP), hashes.of(begin, end), begin + at, end + at, sides))
        empty = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.uint16)
        self.key, self.hash, self.begin, self.end, self.sides = map(np.concatenate, zip(*found)) if found else empty
        self.text = np.searchsorted(starts, self.begin, "right") - 1


class Distinct:
    """The different runs of a block in order of buckets: key, hash, least doc_id, sides; ``number`` is which of them each run is."""

    def __init__(self, found: Runs, doc: np.ndarray, bits: int):
        both = mix(found.key * STEP + found.hash)
        if bits:
            both = (found.key >> np.uint64(64 - bits) << np.uint64(64 - bits)) | (both >> np.uint64(bits))
        order = np.argsort(both)
        fresh = np.ones(len(order), bool)
        fresh[1:] = both[order][1:] != both[order][:-1]
        head = np.flatnonzero(fresh)
        doc = np.minimum.reduceat(doc[found.text][order], head) if len(head) else np.zeros(0, np.int64)
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.cumsum(fresh) - 1
        self.key, self.hash, self.sides = found.key[order[head]], found.hash[order[head]], found.sides[order[head]]
        self.doc, self.bucket = doc, top(self.key, bits)

    def buckets(self) -> tuple[np.ndarray, np.ndarray]:
        """The buckets, and where each begins (one entry more)."""
        cuts = bounds(self.bucket)
        return self.bucket[cuts[:-1]], cuts


def bounds(sorted_: np.ndarray) -> np.ndarray:
    """Where the values of a sorted array begin, and its length."""
    if not len(sorted_):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_[1:] != sorted_[:-1]) + 1, [len(sorted_)]])


def pieces(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The rows of an array from each cut to the next, as bytes."""
    offsets = np.asarray(cuts, np.int64) * (values.nbytes // max(1, len(values)))
    return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)]).cast(pa.binary())


def top(key: np.ndarray, bits: int) -> np.ndarray:
    """The first ``bits`` bits."""
    return (key >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)


def packed_key(key: np.ndarray, bits: int) -> np.ndarray:
    """The 40 bits after the first ``bits``, as rows of 5 bytes."""
    return np.ascontiguousarray(((key << np.uint64(bits)) >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5])


def unpacked_key(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return wide.view(np.uint64)[:, 0]


# Blocks of texts

BLOCKS_ARROW = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("data", pa.binary())])


def into_blocks(docs: DataFrame) -> DataFrame:
    """The documents in a table of blocks of whole texts, bucketed by block. A null text has no bytes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column("doc_id")
            for part in chunks(string_batches(batch.column("text")), BLOCK):
                own = pa.ListArray.from_arrays([0, part.n], ids.slice(part.first, part.n))
                sizes = pa.array([np.diff(part.starts)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([block]), own, sizes, pa.array([part.data.tobytes()], pa.binary())], schema=BLOCKS_ARROW)
                block += 1

    name = f"larkspur_blocks_{uuid.uuid4().hex}"
    packed = rows.mapInArrow(pack, "block long, ids array<long>, sizes array<long>, data binary")
    parts = max(1, min(-(-size // PART), 50_000))
    packed.write.bucketBy(parts, "block").option("path", work_path(docs.sparkSession, "blocks")).option("compression", "zstd").saveAsTable(name)
    blocks = docs.sparkSession.table(name)
    docs.sparkSession.sql(f"DROP TABLE {name}")  # the name only: the files are outside the warehouse and stay
    return blocks


def block_of(batch: pa.RecordBatch, i: int) -> tuple[Texts, pa.Array, np.ndarray]:
    """A block's texts, doc_ids, and doc_ids with the largest number in place of nulls."""
    ids = batch.column("ids")[i].values
    starts = np.concatenate([[0], np.cumsum(batch.column("sizes")[i].values.to_numpy())]).astype(np.int64)
    data = np.frombuffer(batch.column("data")[i].as_buffer(), np.uint8)
    return Texts(0, data, starts), ids, ids.fill_null(LAST).to_numpy()


def with_answers(blocks: DataFrame, answers: DataFrame, columns: list[str]) -> DataFrame:
    """The blocks with arrays of what was answered; the blocks are not shuffled."""
    told = answers.groupBy("block").agg(F.collect_list(F.struct(*columns)).alias("answers"))
    return blocks.join(told, "block", "left")


# Keys, verdicts, shards

KEYS_ARROW = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("key", pa.binary()), ("hash", pa.binary()), ("doc", pa.binary()), ("sides", pa.binary())])
VERDICT_ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("verdict", pa.binary())])
#: A run occurs in a document with a smaller doc_id; its bytes are wanted; they are wanted window by window.
WHOLE, WANTED, WINDOWS = 1, 2, 4


def sent_keys(blocks: DataFrame, bits: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, _, doc = block_of(batch, i)
                own = Distinct(Runs(part), doc, bits)
                bucket, cuts = own.buckets()
                if len(bucket):
                    block = np.full(len(bucket), batch.column("block")[i].as_py(), np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(bucket), pa.array(block), *(pieces(x, cuts) for x in (packed_key(own.key, bits), own.hash, own.doc, own.sides))], schema=KEYS_ARROW)

    return blocks.mapInArrow(work, "bucket long, block long, key binary, hash binary, doc binary, sides binary")


def beside(group: np.ndarray, sides: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Marks of the different runs that have a side in common with one of their group from another document."""
    out = np.zeros(len(group), bool)
    for k in (0, 1):
        some = np.flatnonzero(sides[:, k])
        if len(some):
            own = (group[some] << 16) | sides[some, k]
            order = np.argsort(own)
            some, cuts = some[order], bounds(own[order])
            differ = np.maximum.reduceat(least[some], cuts[:-1]) > np.minimum.reduceat(least[some], cuts[:-1])
            out[some] |= np.repeat(differ, np.diff(cuts))
    return out


def judged(key: np.ndarray, value: np.ndarray, doc: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """A verdict for each run of a bucket."""
    order = np.lexsort((value, key))
    key, value, doc = key[order], value[order], doc[order]
    new_key = np.ones(len(key), bool)
    new_key[1:] = key[1:] != key[:-1]
    new_run = new_key.copy()
    new_run[1:] |= value[1:] != value[:-1]
    runs_at = np.flatnonzero(new_run)
    least, group = np.minimum.reduceat(doc, runs_at), (np.cumsum(new_key) - 1)[runs_at]
    cuts = bounds(group)
    differ = np.repeat(np.maximum.reduceat(least, cuts[:-1]) > np.minimum.reduceat(least, cuts[:-1]), np.diff(cuts))
    wanted, at = np.zeros(len(runs_at), bool), np.flatnonzero(differ)
    side = sides[order[runs_at]]
    long = np.logical_or.reduceat(~side.any(1), cuts[:-1])[group]  # such a run may share a window with any other
    wanted[at] = long[at] | beside(group[at], side[at], least[at])
    many = np.bincount(group[wanted], minlength=len(cuts) - 1)[group] > np.where(long, SPLIT, SPLIT_SHORT)
    run = np.cumsum(new_run) - 1
    verdict = np.empty(len(key), np.uint8)
    verdict[order] = np.where(doc > least[run], WHOLE, np.where(wanted, np.where(many, WINDOWS, WANTED), 0)[run])
    return verdict


def verdicts(keys: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_run(batches, ["bucket"]):
            raw = {c: table[c].to_pylist() for c in ("key", "hash", "doc", "sides")}
            found = judged(unpacked_key(b"".join(raw["key"])), np.frombuffer(b"".join(raw["hash"]), np.uint64), np.frombuffer(b"".join(raw["doc"]), np.int64),
                           np.frombuffer(b"".join(raw["sides"]), np.uint16).reshape(-1, 2))
            ends = np.cumsum([len(x) // 8 for x in raw["hash"]])
            parts = [x.tobytes() for x in np.split(found, ends[:-1])]
            rows = [i for i, x in enumerate(parts) if any(x)]
            if rows:
                yield pa.RecordBatch.from_arrays([table["block"].take(rows).combine_chunks(), table["bucket"].take(rows).combine_chunks(), pa.array([parts[i] for i in rows], pa.binary())], schema=VERDICT_ARROW)

    return keys.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(work, "block long, bucket long, verdict binary")


CUT = "block long, shard long, begins binary, ends binary, sub binary, docs binary, data binary"
CUT_ARROW = pa.schema([("block", pa.int64()), ("shard", pa.int64()), *[(c, pa.binary()) for c in ("begins", "ends", "sub", "docs", "data")]])


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of some ranges, as ranges that neither overlap nor touch."""
    if not len(begin):
        return begin, end
    order = np.argsort(begin, kind="stable")
    begin, upto = begin[order], np.maximum.accumulate(end[order])
    fresh = np.ones(len(begin), bool)
    fresh[1:] = begin[1:] > upto[:-1]
    head = np.flatnonzero(fresh)
    return begin[head], upto[np.append(head[1:], len(begin)) - 1]


def cut_out(blocks: DataFrame, answers: DataFrame, bits: int) -> DataFrame:
    """For each block a row without a shard: the ranges that are known to be repeated; and rows for shards: the wanted runs."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, (part, _, doc) = batch.column("block")[i].as_py(), block_of(batch, i)
                found = Runs(part)
                own = Distinct(found, doc, bits)
                verdict, (bucket, cuts) = np.zeros(len(own.key), np.uint8), own.buckets()
                begin_of = dict(zip(bucket.tolist(), cuts.tolist()))
                for told in batch.column("answers")[i].as_py() or []:
                    verdict[begin_of[told["bucket"]]:][:len(told["verdict"])] = np.frombuffer(told["verdict"], np.uint8)
                verdict, least, docs = verdict[own.number], own.doc[own.number], doc[found.text]
                whole = (verdict == WHOLE) | (docs > least)
                begin, end = merged(found.begin[whole], found.end[whole])
                if len(begin):
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind.type) for x, kind in zip(([block], [None], [begin.tobytes()], [end.tobytes()], [None], [None], [None]), CUT_ARROW)], schema=CUT_ARROW)
                wanted, single = ~whole & (verdict == WANTED), ~whole & (verdict == WINDOWS)
                begin, end, key, docs_ = (x[wanted] for x in (found.begin, found.end, found.key, docs))
                if single.any():
                    each = found.end[single] - found.begin[single] - WINDOW + 1
                    at = spread(found.begin[single], each)
                    low, high = int(at.min()), int(at.max()) + WINDOW
                    begin, end = np.append(begin, at), np.append(end, at + WINDOW)
                    key = np.append(key, mix(Hashes(part.data[low:high]).of(at - low, at - low + WINDOW)))
                    docs_ = np.append(docs_, np.repeat(docs[single], each))
                shard = top(key, bits)
                sub = top(key << np.uint64(bits), 8).astype(np.uint8)
                by = np.argsort(shard, kind="stable")
                begin, end, sub, docs_, shard = begin[by], end[by], sub[by], docs_[by], shard[by]
                cuts = bounds(shard)
                if len(shard):
                    data, ends = part.data[spread(begin, end - begin)], np.concatenate([[0], np.cumsum(end - begin)])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(cuts) - 1, block, np.int64)), pa.array(shard[cuts[:-1]]), *(pieces(x, cuts) for x in (begin, end, sub, docs_)), pieces(data, ends[cuts])], schema=CUT_ARROW)

    return with_answers(blocks, answers, ["bucket", "verdict"]).mapInArrow(work, CUT)


def numbers(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def shards(cut: DataFrame) -> DataFrame:
    """block, begins, ends: ranges of windows that the suffix arrays of the shards find in a document with a smaller doc_id."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_run(batches, ["shard"]):
            begin, end, docs = (numbers(table[c], np.int64) for c in ("begins", "ends", "docs"))
            sub, data = numbers(table["sub"], np.uint8), numbers(table["data"], np.uint8)
            length = end - begin
            row = np.repeat(np.arange(table.num_rows), [len(x) for x in table["sub"].to_pylist()])
            offset = np.cumsum(length) - length
            parts = max(1, min(256, -(-len(data) // SORTED)))
            part = sub.astype(np.int64) * parts >> 8
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for k in range(parts):
                pick = np.flatnonzero(part == k)
                if len(pick):
                    which, at = repeated_windows(data[spread(offset[pick], length[pick])], length[pick], docs[pick])
                    found.append((row[pick][which], begin[pick][which] + at))
            rows, at = map(np.concatenate, zip(*found))
            if len(rows):
                x, y = merged((rows << ROW) + at, (rows << ROW) + at + WINDOW)
                cuts = bounds(x >> ROW)
                own = x[cuts[:-1]] >> ROW
                inside = (1 << ROW) - 1
                yield pa.RecordBatch.from_arrays([table["block"].take(pa.array(own)).combine_chunks(), pieces(x & inside, cuts), pieces(y & inside, cuts)], ["block", "begins", "ends"])

    wanted = cut.where("shard IS NOT NULL").repartition("shard").sortWithinPartitions("shard")
    return wanted.mapInArrow(work, "block long, begins binary, ends binary")


CLEANED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin:long,end:long>>, kept binary"
SPAN = pa.struct([("begin", pa.int64()), ("end", pa.int64())])


def cleaned(blocks: DataFrame, ranges: DataFrame, full: bool) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, ids, _ = block_of(batch, i)
                told = batch.column("answers")[i].as_py() or []
                begin, end = (np.frombuffer(b"".join(x[c] for x in told), np.int64) for c in ("begins", "ends"))
                gone = covered(begin, end - begin, len(part.data)) if len(begin) else np.zeros(len(part.data), bool)
                first, last = runs(gone, part.starts)
                cut = np.searchsorted(first, part.starts)
                n_removed = part.per_text(gone)
                left = part.data[~gone].tobytes()
                sizes = np.diff(part.starts)
                ends = np.concatenate([[0], np.cumsum(sizes - n_removed)]).tolist()
                kept = [left[a:b] for a, b in zip(ends[:-1], ends[1:])]
                first, last = first - np.repeat(part.starts[:-1], np.diff(cut)), last - np.repeat(part.starts[:-1], np.diff(cut))
                spans = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays([pa.array(first), pa.array(last)], fields=list(SPAN)))
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(sizes), pa.array(n_removed), pa.array(np.diff(cut)), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), spans,
                    pa.array(kept if full else [None] * part.n, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    return with_answers(blocks, ranges, ["begins", "ends"]).mapInArrow(work, CLEANED)


def remove_repeats(docs: DataFrame, full: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed ranges of bytes) and, with ``full``, kept
    (the remaining bytes).

    A byte goes if it is covered by a string of 50 bytes that also starts in a document with a smaller doc_id; this is judged on
    the texts as they came. Rows with one doc_id, and rows without any, do not count against each other; a null doc_id counts as
    the largest. Null and empty texts have no bytes, shorter ones than 50 stay. Texts are worked on whole, however long. Runs are
    told apart by 64 bits of a hash, windows of different runs by their bytes. An empty table gives no rows. Extra columns
    are not read.
    """
    spark = docs.sparkSession
    blocks = into_blocks(docs)
    size = blocks.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    bits = max(0, (-(-size // BUCKET) - 1).bit_length())
    answers = saved(verdicts(sent_keys(blocks, bits)), "verdicts")
    cut = saved(cut_out(blocks, answers, bits), "cut")
    ranges = cut.where("shard IS NULL").select("block", "begins", "ends").unionAll(shards(cut))
    return cleaned(blocks, saved(ranges, "ranges"), full)


def cleaned_documents(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs, full=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
