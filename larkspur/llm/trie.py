"""Prefix trie of conversations by ROLLUP over positional turn-id columns.

A conversation is cut into blocks of ``WIDTH`` turns, one row each, with a column for every place in the block. ROLLUP over these
columns aggregates the prefixes of all lengths at once; grouping_id tells how long a prefix is. A long conversation
goes on in further rows, which are keyed by the node at which its block before ended, so all blocks take part in the same
ROLLUP. A second ROLLUP over the nodes sums up subtrees; what lies in later blocks is handed up along the block ends by pointer
doubling, in as many rounds as the logarithm of the number of blocks.

A turn is known by 120 bits of the SHA-256 of role and text, a node by its depth and 128 bits over the places and ids
of its turns (their exclusive or, so that block ends need no pass from block to block).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from larkspur.llm.arrays import string_batches
from larkspur.operators.ordering import range_block, running_sum, with_hot_block
from larkspur.session import saved

#: Turns in a block.
WIDTH = 8
#: Blocks whose running keys are computed together, and conv_ids (as a power of two) whose decimals are joined together.
CHUNK, ID_BITS = 1024, 12
#: A rebuilt conversation takes at most so many turns from the first of its group, less one.
HEADS = 9
GROUP = 5
NODE = ["depth", "n1", "n2"]
EMPTY = hashlib.sha256(b"").hexdigest()


@dataclass
class Trie:
    """``nodes`` (depth, n1, n2, parent_n1, parent_n2, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, hi, lo: the id of
    the last turn), ``ends`` (depth, n1, n2, conv_id: where each conversation ends) and ``turns`` (conv_id, pos, hi, lo, role, text)."""

    nodes: DataFrame
    ends: DataFrame
    turns: DataFrame

    def texts(self) -> DataFrame:
        """The nodes with the role and text of their last turn."""
        known = self.turns.groupBy("hi", "lo").agg(F.min(F.struct("role", "text")).alias("turn"))
        return self.nodes.join(known, ["hi", "lo"], "left").select(*self.nodes.columns, "turn.role", "turn.text")


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, hi, lo, n_bytes. Null role and text are empty; rows without a conv_id are left out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    told = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).where("conv_id IS NOT NULL")
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    half = [F.conv(F.substring(digest, at, 15), 16, 10).cast("long") for at in (1, 16)]
    return told.withColumns({"hi": half[0], "lo": half[1], "n_bytes": F.octet_length("text").cast("long")})


def placed(turns: DataFrame) -> DataFrame:
    """The turns with ``pos``, from 0, in order of turn (null first), equal ones in order of their ids."""
    block = F.when(F.col("turn").isNull(), F.lit(-1)).otherwise(range_block(turns, "turn"))
    marked = with_hot_block(turns, ["conv_id"], block, "part")
    order = [F.col("turn").asc_nulls_first(), F.col("hi"), F.col("lo")]
    return running_sum(marked, ["conv_id"], order, F.lit(1), "pos", F.col("part"), inclusive=False).drop("part", "turn")


def rebuilt(ranked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What becomes of each conversation (conv_id, length), and the turns of the rebuilt ones (conv_id, length, pos, hi, lo, n_bytes).

    Conversation c takes the first h turns of c - c % 5, then its own after the first h, with h = crc32(c as text) % 9."""
    sizes = ranked.groupBy("conv_id").agg(F.count("*").alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    own = sizes.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("there"))
    taken = F.least("h", F.coalesce("there", F.lit(0)))
    known = own.join(bases, "base", "left").select(
        "conv_id", "h", "base", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    known = saved(known, "trie-lengths")
    slim = ranked.select("conv_id", "pos", "hi", "lo", "n_bytes")
    columns = ["conv_id", "length", "pos", "hi", "lo", "n_bytes"]
    first = slim.where(F.col("pos") < HEADS - 1).withColumnRenamed("conv_id", "base")
    heads = first.join(known, "base").where("pos < h").select(*columns)
    tails = slim.join(known, "conv_id").where("pos >= h").withColumn("pos", F.col("taken") + F.col("pos") - F.col("h")).select(*columns)
    return known.select("conv_id", "length"), heads.unionAll(tails)


def path_key(number: int, pos: Column, hi: Column, lo: Column) -> Column:
    return F.xxhash64(F.lit(number), pos.cast("long"), hi, lo)


def in_blocks(lengths: DataFrame, turns: DataFrame) -> DataFrame:
    """A row for each block of a conversation: conv_id, length, block, a1, a2 (key of the node before it), z1, z2 (key of the node
    at its end), t0, t1, ... (id and bytes of its turns, null past the end). A conversation without turns has one block."""
    empty = lengths.where("length = 0").select("conv_id", "length", *[F.lit(None).cast("long").alias(c) for c in ("pos", "hi", "lo", "n_bytes")])
    rows = turns.unionAll(empty).withColumn("block", F.coalesce(F.expr(f"pos div {WIDTH}"), F.lit(0)).cast("long"))
    keys = [F.coalesce(F.bit_xor(F.when(F.col("pos").isNotNull(), path_key(k, F.col("pos"), F.col("hi"), F.col("lo")))), F.lit(0)).alias(f"x{k}") for k in (1, 2)]
    at = [[F.max(F.when(F.col("pos") % WIDTH == j, F.col(c))).alias(f"{c}{j}") for c in ("hi", "lo", "n_bytes")] for j in range(WIDTH)]
    packed = rows.groupBy("conv_id", "length", "block").agg(*keys, *[c for own in at for c in own])
    slots = [F.when(F.col(f"hi{j}").isNotNull(), F.struct(F.col(f"hi{j}").alias("hi"), F.col(f"lo{j}").alias("lo"), F.col(f"n_bytes{j}").alias("n_bytes"))).alias(f"t{j}") for j in range(WIDTH)]
    packed = saved(packed.select("conv_id", "length", "block", "x1", "x2", *slots), "trie-packed")

    zero = F.lit(0).cast("long")
    short = packed.where(F.col("length") <= WIDTH).withColumns({"a1": zero, "a2": zero})
    long = packed.where(F.col("length") > WIDTH).withColumn("chunk", F.expr(f"block div {CHUNK}"))
    chunks = long.groupBy("conv_id", "chunk").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))

    def before(keys: list[str], order: str, k: int) -> Column:
        window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.bit_xor(f"x{k}").over(window), zero)

    offsets = chunks.select("conv_id", "chunk", *[before(["conv_id"], "chunk", k).alias(f"o{k}") for k in (1, 2)])
    inner = long.withColumns({f"i{k}": before(["conv_id", "chunk"], "block", k) for k in (1, 2)})
    carried = inner.join(offsets, ["conv_id", "chunk"]).withColumns({f"a{k}": F.col(f"i{k}").bitwiseXOR(F.col(f"o{k}")) for k in (1, 2)})
    columns = ["conv_id", "length", "block", "a1", "a2", "x1", "x2", *[f"t{j}" for j in range(WIDTH)]]
    both = short.select(*columns).unionAll(carried.select(*columns))
    return both.withColumns({f"z{k}": F.col(f"a{k}").bitwiseXOR(F.col(f"x{k}")) for k in (1, 2)}).drop("x1", "x2")


PATH = ", ".join(f"t{j}" for j in range(WIDTH))
FILLED = " + ".join(f"CAST(t{j} IS NOT NULL AS INT)" for j in range(WIDTH))
LEVEL = f"{WIDTH} - bit_count(grouping_id())"


def rolled_up(rows: DataFrame, aggregates: str) -> DataFrame:
    """A row for each prefix of each block: block, a1, a2, t0, ..., level and the aggregates. Prefixes that a block does not have are
    left out, and the empty prefix of later blocks, which is the node where the block before ended."""
    found = rows.sparkSession.sql(
        f"SELECT block, a1, a2, {PATH}, {LEVEL} AS level, {aggregates} FROM {{rows}} GROUP BY block, a1, a2, ROLLUP({PATH})", rows=rows)
    return found.where(f"level = {FILLED} AND (level > 0 OR block = 0)")


def with_keys(nodes: DataFrame) -> DataFrame:
    """Add depth, the last turn, the node's key n1, n2 and its parent's."""
    depth = F.col("block") * WIDTH + F.col("level")
    last = F.coalesce(*[F.col(f"t{j}") for j in reversed(range(WIDTH))])
    out = nodes.withColumns({"depth": depth, "last": last})
    for k in (1, 2):
        own = F.col(f"a{k}")
        for j in range(WIDTH):
            slot = F.col(f"t{j}")
            own = own.bitwiseXOR(F.when(slot.isNull(), F.lit(0)).otherwise(path_key(k, F.col("block") * WIDTH + j, slot["hi"], slot["lo"])))
        end = F.when(F.col("last").isNull(), F.lit(0)).otherwise(path_key(k, F.col("depth") - 1, F.col("last")["hi"], F.col("last")["lo"]))
        out = out.withColumn(f"n{k}", own).withColumn(f"parent_n{k}", F.col(f"n{k}").bitwiseXOR(end))
    return out


def handed_up(nodes: DataFrame) -> DataFrame:
    """For each block end at which conversations go on: block, a1, a2, t0, ... of that node, the sums over the later blocks
    below it (leaf, cost) and the number of its children (kids)."""
    later = nodes.where("block > 0").groupBy(F.col("block").alias("b"), F.col("a1").alias("k1"), F.col("a2").alias("k2")).agg(
        F.sum("leaf").alias("leaf"), F.sum("cost").alias("cost"), F.sum(F.expr("CAST(level = 1 AS LONG)")).alias("kids"))
    ends = nodes.where((F.col("level") == WIDTH) & (F.col("longest") > F.col("depth")))
    up = ends.select((F.col("block") + 1).alias("b"), F.col("n1").alias("k1"), F.col("n2").alias("k2"), F.col("a1").alias("p1"), F.col("a2").alias("p2"), F.col("block").alias("pb"))
    sums = saved(later.join(up, ["b", "k1", "k2"]), "trie-sums")
    while not (open_ := sums.where("pb > 0")).isEmpty():
        below = open_.groupBy("pb", "p1", "p2").agg(F.sum("leaf").alias("more_leaf"), F.sum("cost").alias("more_cost"))
        below = below.select(F.col("pb").alias("b"), F.col("p1").alias("k1"), F.col("p2").alias("k2"), "more_leaf", "more_cost")
        above = sums.select(F.col("b").alias("pb"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("pb").alias("qb"), F.col("p1").alias("q1"), F.col("p2").alias("q2"))
        grown = sums.join(below, ["b", "k1", "k2"], "left").join(above, ["pb", "p1", "p2"], "left")
        sums = saved(grown.select(
            "b", "k1", "k2", (F.col("leaf") + F.coalesce("more_leaf", F.lit(0))).alias("leaf"), (F.col("cost") + F.coalesce("more_cost", F.lit(0))).alias("cost"), "kids",
            F.coalesce("qb", F.lit(0)).alias("pb"), F.col("q1").alias("p1"), F.col("q2").alias("p2")), "trie-sums")
    slim = ends.select("block", "a1", "a2", *[f"t{j}" for j in range(WIDTH)], "conv_id", "n_convs", (F.col("block") + 1).alias("b"), F.col("n1").alias("k1"), F.col("n2").alias("k2"))
    return slim.join(sums.select("b", "k1", "k2", "leaf", "cost", "kids"), ["b", "k1", "k2"])


def prefix_trie(conversations: DataFrame) -> Trie:
    """The trie of the rebuilt conversations.

    Turns are in order of ``turn``, null first, equal ones in order of the hash of role and text; null roles and texts are
    empty. Rows without a conv_id belong to no conversation. Repeated rows are turns of their own. A conversation of which no
    turn is left is a member of the root. An empty table has no nodes. Extra columns are not read.
    """
    named = placed(turn_rows(conversations))
    ranked = saved(named.drop("role", "text"), "trie-turns")
    lengths, turns = rebuilt(ranked)
    blocks = saved(in_blocks(lengths, turns), "trie-blocks")
    ends = blocks.where(F.col("length") <= (F.col("block") + 1) * WIDTH).select(
        F.col("length").alias("depth"), F.col("z1").alias("n1"), F.col("z2").alias("n2"), "conv_id")

    first = with_keys(rolled_up(blocks, "count(*) AS n_convs, min(conv_id) AS conv_id, max(length) AS longest"))
    cost = (F.col("n_convs") - 1) * F.coalesce(F.col("last")["n_bytes"], F.lit(0))
    first = saved(first.withColumns({"leaf": F.expr("CAST(longest = depth AS LONG)"), "cost": cost}), "trie-first")

    columns = ["block", "a1", "a2", *[f"t{j}" for j in range(WIDTH)], "conv_id", "n_convs", "leaf", "cost"]
    none = F.lit(0).cast("long")
    own = first.select(*columns, "level", none.alias("kids"))
    rows = own.unionAll(handed_up(first).select(*columns, F.lit(-1).alias("level"), "kids"))
    counts = ", ".join(f"sum(CAST(level = {j} AS LONG)) AS c{j}" for j in range(1, WIDTH + 1))
    sums = rolled_up(
        rows.withColumnRenamed("level", "own_level"),
        "min(conv_id) AS conv_id, max(n_convs) AS n_convs, sum(leaf) AS n_leaves, sum(cost) AS saved_tokens, sum(kids) AS kids, " + counts.replace("level", "own_level"))
    children = F.when(F.col("level") == WIDTH, F.col("kids"))
    for j in range(WIDTH):
        children = children.when(F.col("level") == j, F.col(f"c{j + 1}"))
    nodes = with_keys(sums).select(
        *NODE, "parent_n1", "parent_n2", "conv_id", "n_convs", children.alias("n_children"), "n_leaves", "saved_tokens", F.col("last")["hi"].alias("hi"), F.col("last")["lo"].alias("lo"))
    nodes = saved(nodes, "trie-nodes")

    inner = nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("n1").alias("parent_n1"), F.col("n2").alias("parent_n2"), F.col("conv_id").alias("parent_conv_id"))
    root = inner.where("depth = 1").select("parent_conv_id").scalar() if not nodes.where("depth = 1").isEmpty() else F.lit(None).cast("long")
    deep = nodes.where("depth > 1").join(inner.where("depth > 1"), ["depth", "parent_n1", "parent_n2"])
    top = nodes.where("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, root))
    whole = top.unionByName(deep)
    return Trie(whole, ends, named)


def end_hashes(ends: DataFrame) -> DataFrame:
    """depth, n1, n2 and the SHA-256 of the conv_ids that end there, ascending and joined by commas.

    Tasks join the decimals of up to 4096 neighbouring ids; the hash then runs over these pieces in order and holds one at a time, so a
    node at which a third of all conversations ends is no burden."""
    piece = F.shiftright("conv_id", ID_BITS).alias("piece")
    pieces = ends.groupBy(*NODE, piece).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done: list[tuple] = []
            names = [batch.column(c).to_pylist() for c in NODE]
            ids = string_batches(batch.column("ids"))
            for i, now in enumerate(zip(*names)):
                if now != key:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = now, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids[i].as_py().encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], [*NODE, "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, state.hexdigest())], [*NODE, "ends_sha256"])

    dealt = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "piece")
    return dealt.select(*NODE, "ids").mapInArrow(run, "depth long, n1 long, n2 long, ends_sha256 string")


def node_rows(conversations: DataFrame) -> DataFrame:
    """One row per node with the hash of the conversations that end there."""
    trie = prefix_trie(conversations)
    told = trie.nodes.join(end_hashes(trie.ends), NODE, "left")
    return told.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
