"""Ranks of the nodes of a link network."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from larkspur.session import saved

#: Links of one node that are worked on together; a hub with more is cut into slices.
HUB = 100_000
#: Rounds between two written states.
ROUNDS = 4


def page_rank(
    edges: DataFrame, src: str = "src", dst: str = "dst", weight: str | None = None, damping: float = 0.85, tolerance: float = 1e-9,
    max_rounds: int = 1000, hub: int = HUB, rounds: int = ROUNDS,
) -> DataFrame:
    """PageRank: one row per node that a link leaves or reaches: node, rank. The ranks add up to 1.

    Repeated links count as often as they occur, or with the sum of their weights; links without an end, and weights that are not
    positive, are left out. What nodes without links hold goes to all nodes alike. That share only scales the ranks, so a
    round is y = 1 + damping * (what links bring) and the ranks are y over its sum; no round needs a total of the one
    before. The state is written every ``rounds`` rounds, until the ranks differ by no more than ``tolerance`` in all from
    those of the state before; that they do not after ``max_rounds`` raises. The links of a hub are cut into slices of
    ``hub`` links, what reaches a node is summed up before the shuffle."""
    if not 0 <= damping < 1:
        raise ValueError("damping must be at least 0 and below 1")
    value = F.col(weight).cast("double") if weight else F.lit(1.0)
    named = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"), value.alias("w")).where("src IS NOT NULL AND dst IS NOT NULL AND w > 0")
    links = saved(named.groupBy("src", "dst").agg(F.sum("w").alias("w")), "links")
    outs = saved(links.groupBy("src").agg(F.sum("w").alias("total"), F.ceil(F.count("*") / hub).cast("int").alias("slices")), "outs")
    share = F.col("w") / F.col("total")
    slice_ = F.pmod(F.xxhash64("dst"), F.col("slices")).cast("int")
    flow = saved(links.join(outs, "src").select("src", slice_.alias("slice"), "dst", share.alias("share")), "flow")
    ends = links.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    nodes = saved(ends.join(outs.select(F.col("src").alias("node"), "slices"), "node", "left"), "nodes")

    # where no node is without links, y adds up to this for each node from the start
    state = saved(nodes.select("node", "slices", F.lit(1.0 / (1.0 - damping)).alias("y")), "ranks")
    for _ in range(-(-max_rounds // rounds)):
        before = state
        for _ in range(rounds):
            sent = state.where("slices > 0").select(F.col("node").alias("src"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "y")
            brought = flow.join(sent, ["src", "slice"]).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("y") * F.col("share")).alias("brought"))
            state = nodes.join(brought, "node", "left").select("node", "slices", (F.lit(1.0) + F.lit(damping) * F.coalesce("brought", F.lit(0.0))).alias("y"))
        state = saved(state, "ranks")
        sums = [frame.agg(F.sum("y")).first()[0] or 1.0 for frame in (state, before)]
        both = state.join(before.select("node", F.col("y").alias("old")), "node")
        change = both.agg(F.sum(F.abs(F.col("y") / sums[0] - F.col("old") / sums[1]))).first()[0] or 0.0
        if change <= tolerance:
            return state.select("node", (F.col("y") / sums[0]).alias("rank"))
    raise RuntimeError(f"the ranks still change by {change} after {max_rounds} rounds")
