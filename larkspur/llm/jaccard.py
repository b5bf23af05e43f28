"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of shingles of five words. Equal sets are one class and go on as one. MinHash bands bring similar sets into
buckets. Inside a bucket, cut into blocks of bounded size, pairs are compared a few MinHash values at a time; a pair is
dropped as soon as the posterior probability that its similarity reaches the threshold falls below a tolerance. What is
left ties sets to components of candidates (never as a list of all pairs: a block gives a spanning forest). All pairs of
a component are then verified exactly, again in blocks, which give counts of links and a forest of true links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from larkspur.llm.arrays import Texts, chunks, distinct_pairs, mix, shingles, string_batches, words
from larkspur.session import work_path

SHINGLE = 5
THRESHOLD = 0.8
#: 24 bands of 4 values: a pair at similarity 0.8 shares no band with probability 3e-6.
BANDS, ROWS = 24, 4
K = BANDS * ROWS
#: MinHash values compared at a time, and the posterior probability below which a pair is dropped.
STEP, TOLERANCE = 16, 1e-4
#: Sets in a block: a task holds two blocks.
BLOCK = 256
SEEDS = np.random.default_rng(7).integers(1, 1 << 32, K, np.uint64).astype(np.uint32) | np.uint32(1)


def signatures(value: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """K MinHash values of each text's shingles; texts without shingles get the largest value."""
    out = np.full((n, K), np.uint32(0xFFFFFFFF))
    counts = np.bincount(text, minlength=n)
    heads = np.concatenate([[0], np.cumsum(counts)])
    some = np.flatnonzero(counts)
    low = (value & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    high = (value >> np.uint64(32)).astype(np.uint32)
    at = 0
    while at < len(some):  # whole texts, about 64k shingles at a time: these stay in the processor's cache
        to = max(at + 1, int(np.searchsorted(heads[some], heads[some[at]] + 65536)))
        part = slice(heads[some[at]], heads[some[min(to, len(some)) - 1] + 1])
        cut = heads[some[at:to]] - part.start
        a, b = low[part], high[part]
        for k in range(K):
            h = a * SEEDS[k] + b
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x85EBCA6B) ^ SEEDS[k] & np.uint32(0xFFFFFFFE)
            h ^= h >> np.uint32(13)
            out[some[at:to], k] = np.minimum.reduceat(h, cut)
        at = to
    return out


def posterior_floor(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For each number of compared values, the fewest matches with P(similarity >= threshold | matches) >= tolerance.

    The prior is uniform, so the posterior is Beta(matches + 1, misses + 1); its tail is summed on a fine grid.
    """
    grid = (np.arange(20000) + 0.5) / 20000
    floor = {}
    for n in range(STEP, K + 1, STEP):
        for matches in range(n + 1):
            log = matches * np.log(grid) + (n - matches) * np.log1p(-grid)
            density = np.exp(log - log.max())
            if density[grid >= threshold].sum() / density.sum() >= tolerance:
                floor[n] = matches
                break
    return floor


def surviving(a: np.ndarray, b: np.ndarray, same: bool, floor: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two blocks of signatures that outlive the pruning; with ``same`` each pair once."""
    left, right = np.nonzero(np.triu(np.ones((len(a), len(b)), bool), 1) if same else np.ones((len(a), len(b)), bool))
    matches = np.zeros(len(left), np.int32)
    for n, least in floor.items():
        matches += (a[left, n - STEP:n] == b[right, n - STEP:n]).sum(1, dtype=np.int32)
        stay = matches >= least
        left, right, matches = left[stay], right[stay], matches[stay]
    return left, right


def forest(left: np.ndarray, right: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs: at most n - 1 of them, joining what all of them join."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for a, b in zip(left.tolist(), right.tolist()):
        ra, rb = find(a), find(b)
        if ra != rb:
            root[max(ra, rb)] = min(ra, rb)
            kept.append((a, b))
            if len(kept) == n - 1:
                break
    return kept


def set_hashes(part: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted by text and value."""
    return distinct_pairs(*shingles(words(part), SHINGLE))


@F.arrow_udf(T.StructType([T.StructField("key", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("sig", T.BinaryType())]))
def sketch(batch: pa.Array) -> pa.Array:
    """Key of a text's shingle set, the set's size and its signature; nulls for a text without words."""
    keys, sizes, sigs = [], [], []
    for part in chunks(string_batches(batch)):
        value, text = set_hashes(part)
        size = np.bincount(text, minlength=part.n)
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(value), dtype=np.uint64)])
        heads = np.concatenate([[0], np.cumsum(size)])
        key = mix(total[heads[1:]] - total[heads[:-1]] + size.astype(np.uint64)).view(np.int64)
        none = size == 0
        keys.append(pa.array(key, mask=none))
        sizes.append(pa.array(size.astype(np.int32), mask=none))
        sigs += [row.tobytes() if some else None for row, some in zip(signatures(value, text, part.n), ~none)]
    columns = [pa.concat_arrays(keys) if keys else pa.array([], pa.int64()), pa.concat_arrays(sizes) if sizes else pa.array([], pa.int32()), pa.array(sigs, pa.binary())]
    return pa.StructArray.from_arrays(columns, ["key", "size", "sig"])


@F.arrow_udf(T.ArrayType(T.LongType()))
def band_keys(batch: pa.Array) -> pa.Array:
    """Bucket number of a signature in each band."""
    column = string_batches(batch)
    if not len(column):
        return pa.array([], pa.list_(pa.int64()))
    sig = np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.zeros(sig.shape[:2], np.uint64) + np.arange(BANDS, dtype=np.uint64)[None, :]
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r])
    return pa.ListArray.from_arrays(pa.array(np.arange(0, key.size + 1, BANDS), pa.int32()), pa.array(key.view(np.int64).ravel()))


@F.arrow_udf(T.ArrayType(T.BinaryType()))
def shingle_sets(batch: pa.Array) -> pa.Array:
    """The distinct shingles of each text, as one binary in an array (empty for a text without words)."""
    out: list[list[bytes]] = []
    for part in chunks(string_batches(batch)):
        value, text = set_hashes(part)
        heads = np.searchsorted(text, np.arange(part.n + 1))
        out += [[value[a:b].tobytes()] if b > a else [] for a, b in zip(heads[:-1], heads[1:])]
    return pa.array(out, pa.list_(pa.binary()))


def paired_blocks(members: DataFrame, group: str, sizes: DataFrame) -> DataFrame:
    """Rows of every group dealt to pairs of blocks: (group, i, j) with i <= j gets the blocks i and j.

    A group of one block has the pair (0, 0). ``members`` has the group, ``rep`` and payload; ``sizes`` has group and n.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = members.join(sizes, group).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep", F.lit(11)), F.col("blocks")).cast("int"))
    return dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "*", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).drop("other", "blocks", "n")


def by_run(frames: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows with equal keys from batches sorted by them; only one group is held at a time."""
    rest: pa.Table | None = None
    for frame in frames:
        if not frame.num_rows:
            continue
        table = pa.Table.from_batches([frame])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        change = np.zeros(table.num_rows, bool)
        for key in keys:
            column = table[key].to_numpy()
            change[1:] |= column[1:] != column[:-1]
        cuts = [0, *np.flatnonzero(change).tolist()]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield table.slice(a, b - a)
        rest = table.slice(cuts[-1])
    if rest is not None and rest.num_rows:
        yield rest


def two_sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Row numbers of the two blocks of a pair; for a block with itself both are all rows."""
    i, j = table["i"][0].as_py(), table["j"][0].as_py()
    if i == j:
        every = np.arange(table.num_rows)
        return every, every, True
    block = table["block"].to_numpy()
    return np.flatnonzero(block == i), np.flatnonzero(block == j), False


EDGE = "a long, b long"
EDGE_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def candidate_edges(dealt: DataFrame) -> DataFrame:
    """Spanning forests of the pairs that outlive the pruning in each pair of blocks of a bucket."""
    floor = posterior_floor()

    def prune(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_run(frames, ["bucket", "i", "j"]):
            rep = table["rep"].to_numpy()
            sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint32).reshape(-1, K)
            left, right, same = two_sides(table)
            x, y = surviving(sig[left], sig[right], same, floor)
            pairs = forest(left[x], right[y], len(rep))
            if pairs:
                yield pa.RecordBatch.from_pydict({"a": rep[[p[0] for p in pairs]], "b": rep[[p[1] for p in pairs]]}, EDGE_ARROW)

    columns = ["bucket", "i", "j", "block", "rep", "sig"]
    return dealt.select(*columns).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(prune, EDGE)


def intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all pairs of two lists of sets, through the shingles that both sides have."""
    def stacked(rows):
        return np.concatenate([sets[r] for r in rows]), np.repeat(np.arange(len(rows)), [len(sets[r]) for r in rows])

    (va, ta), (vb, tb) = stacked(left), stacked(right)
    common = np.intersect1d(va, vb)
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(common):
        return out
    sa, sb = np.searchsorted(common, va), np.searchsorted(common, vb)
    oka, okb = common[np.minimum(sa, len(common) - 1)] == va, common[np.minimum(sb, len(common) - 1)] == vb
    sa, ta, sb, tb = sa[oka], ta[oka], sb[okb], tb[okb]
    for at in range(0, len(common), 4096):  # a bounded slice of shingles at a time
        a, b = (sa >= at) & (sa < at + 4096), (sb >= at) & (sb < at + 4096)
        width = min(4096, len(common) - at)
        x, y = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        x[ta[a], sa[a] - at] = 1
        y[tb[b], sb[b] - at] = 1
        out += x @ y.T
    return out


def true_links(dealt: DataFrame, threshold: float) -> DataFrame:
    """For each pair of blocks of a component: the links of each set to others, and a spanning forest of the links.

    Rows (a, b, links): b is null for a count, links is 0 for an edge.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def verify(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_run(frames, ["component", "i", "j"]):
            rep = table["rep"].to_numpy()
            copies = table["copies"].to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
            size = np.array([len(x) for x in sets], np.float64)
            left, right, same = two_sides(table)
            both = intersections(sets, left, right)
            linked = both >= threshold * (size[left][:, None] + size[right][None, :] - both) - 1e-9
            if same:
                np.fill_diagonal(linked, False)
            links = np.zeros(len(rep), np.int64)
            np.add.at(links, left, linked @ copies[right])
            if not same:
                np.add.at(links, right, linked.T @ copies[left])
            x, y = np.nonzero(np.triu(linked, 1) if same else linked)
            pairs = forest(left[x], right[y], len(rep))
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_pydict({
                "a": np.concatenate([rep[some], rep[[p[0] for p in pairs]]]) if len(some) else rep[:0],
                "b": [None] * len(some) + [int(rep[p[1]]) for p in pairs],
                "links": np.concatenate([links[some], np.zeros(len(pairs), np.int64)]),
            }, schema)

    columns = ["component", "i", "j", "block", "rep", "copies", "shingles"]
    return dealt.select(*columns).repartition("component", "i", "j").sortWithinPartitions("component", "i", "j").mapInArrow(verify, "a long, b long, links long")


def saved(frame: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later steps do not depend on lost executors."""
    path = work_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(rep, component) for all ends of edges; the component is the smallest rep in it.

    Each round ties every node's larger neighbours to its smallest one, then every node and its smaller neighbours to the
    smallest of these, until nothing changes; a few rounds more than the logarithm of the longest path. The smallest
    neighbours are written out, so that both sides of a join are plain tables and a hub's rows can be split.
    """
    now = saved(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    last = None
    while True:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = saved(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")), "low")
        large = now.join(low, "a").select(F.col("b").alias("x"), F.col("low").alias("y")).distinct()
        large = saved(large, "large")
        low = saved(large.groupBy("x").agg(F.min("y").alias("low")), "low")
        small = large.join(low, "x").where("y <> low").select(F.col("low").alias("a"), F.col("y").alias("b"))
        now = saved(small.unionAll(low.select(F.col("low").alias("a"), F.col("x").alias("b"))).distinct(), "edges")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == last:
            return now.select(F.col("b").alias("rep"), F.col("a").alias("component")).unionAll(
                now.select(F.col("a").alias("rep"), F.col("a").alias("component")).distinct())
        last = mark


def row_keys(text) -> list:
    """Two hashes that tell rows apart by doc_id and text; rows repeated in both are one document."""
    return [F.xxhash64("doc_id", text).alias("k1"), F.xxhash64(F.lit(1), "doc_id", text).alias("k2")]


def similarity_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, k1, k2, n_shingles, component, class_id, n_links.

    n_links counts the other rows whose shingle sets have a Jaccard similarity of ``threshold`` or more, copies included;
    a class is what links tie together, class_id its smallest doc_id. A text of fewer than five words, but some, is one
    shingle. Null texts and texts without words are linked to nothing (component is null) and are their own class.
    Repeated rows are copies of each other. Sets are told apart by 64 bits of their hash. The threshold may be 0.8 or more.
    """
    rows = saved(docs.select("doc_id", *row_keys("text"), sketch("text").alias("s")).select("doc_id", "k1", "k2", "s.*"), "sketches")
    sets = saved(rows.where("key IS NOT NULL").groupBy(F.col("key").alias("rep")).agg(
        F.count("*").alias("copies"), F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "k1", "k2")).alias("one"),
    ).select("rep", "copies", "one.doc_id", "one.k1", "one.k2"), "sets")

    # the signature of one row of each set; buckets with two sets or more
    signed = saved(rows.select("k1", "k2", "sig").join(sets, ["k1", "k2"]).select("rep", "sig").dropDuplicates(["rep"]), "signatures")
    members = saved(signed.select("rep", F.explode(band_keys("sig")).alias("bucket")), "bands")
    sizes = saved(members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    shared = saved(members.join(sizes, "bucket", "left_semi"), "members")
    candidates = candidate_edges(paired_blocks(shared.join(signed, "rep"), "bucket", sizes))
    found = saved(components(candidates), "candidates")

    # exact check of all pairs of a component, on the shingles of one text of each set
    count = saved(found.groupBy("component").agg(F.count("*").alias("n")), "sizes")
    wanted = found.join(sets, "rep").select("rep", "component", "copies", "k1", "k2")
    payload = docs.select(*row_keys("text"), "text").join(wanted, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    payload = payload.select("rep", "component", "copies", F.explode(shingle_sets("text")).alias("shingles"))
    checked = saved(true_links(paired_blocks(payload, "component", count), threshold), "links")
    links = checked.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    tied = components(checked.where("b IS NOT NULL").select("a", "b"))

    classed = saved(sets.join(links, "rep", "left").join(tied, "rep", "left").select(
        "rep", "doc_id", F.coalesce("component", "rep").alias("component"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "linked")
    first = saved(classed.groupBy("component").agg(F.min("doc_id").alias("class_id")), "first")
    classed = saved(classed.join(first, "component").select(F.col("rep").alias("key"), "component", "class_id", "n_links"), "classes")
    out = rows.select("doc_id", "k1", "k2", "key", "size").join(classed, "key", "left")
    return out.select(
        "doc_id", "k1", "k2", F.coalesce("size", F.lit(0)).alias("n_shingles"), "component",
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id, n_links. See ``similarity_classes``; extra columns are not read."""
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return similarity_classes(slim, threshold).select("doc_id", "n_shingles", "class_id", "n_links")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, the one with the smallest doc_id, with all its columns, whatever these are called.

    Texts without words are no copies of each other and stay; rows repeated in doc_id and text are one document.
    """
    classes = similarity_classes(docs.select("doc_id", F.col("text").cast("string").alias("text")), threshold)
    ours = [fresh(docs, "k1"), fresh(docs, "k2")]
    chosen = classes.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "k1", "k2")).alias("one"))
    wanted = chosen.select("one.k1", "one.k2").unionAll(classes.where("component IS NULL").select("k1", "k2").distinct()).toDF(*ours)
    keyed = docs.select("*", *[k.alias(name) for k, name in zip(row_keys(F.col("text").cast("string")), ours)])
    return keyed.join(wanted, ours).dropDuplicates(ours).select(*[F.col(f"`{c}`") for c in docs.columns])


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name
