"""PageRank against a plain iteration."""

import random

import pytest

from larkspur.operators.graph import page_rank


def plain(edges, damping=0.85, rounds=300):
    """Ranks by the usual form, with the mass of nodes without links handed to all."""
    weight = {}
    for a, b, w in edges:
        if a is not None and b is not None and w is not None and w > 0:
            weight[a, b] = weight.get((a, b), 0) + w
    nodes = {x for pair in weight for x in pair}
    total = {}
    for (a, _), w in weight.items():
        total[a] = total.get(a, 0) + w
    rank = {x: 1 / len(nodes) for x in nodes}
    for _ in range(rounds):
        lost = sum(r for x, r in rank.items() if x not in total)
        fresh = {x: (1 - damping + damping * lost) / len(nodes) for x in nodes}
        for (a, b), w in weight.items():
            fresh[b] += damping * rank[a] * w / total[a]
        rank = fresh
    return rank


def got(spark, edges, **options):
    frame = spark.createDataFrame(edges, "src string, dst string, w double")
    return {r.node: r["rank"] for r in page_rank(frame, weight="w", **options).collect()}


HAND_MADE = [("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 1.0), ("c", "b", 1.0), ("d", "c", 1.0), ("d", "c", 1.0), ("d", "e", 1.0), ("e", "e", 1.0), ("a", "sink", 1.0), ("f", "f", None), (None, "a", 1.0), ("a", None, 1.0), ("a", "d", -1.0)]


def test_hand_made_graph(spark):
    ranks = got(spark, HAND_MADE, tolerance=1e-7, rounds=12)
    want = plain(HAND_MADE)
    assert ranks.keys() == want.keys() and "f" not in ranks
    assert all(abs(ranks[x] - want[x]) < 1e-6 for x in want) and abs(sum(ranks.values()) - 1) < 1e-12


def test_hubs_and_random_links(spark):
    rng = random.Random(5)
    edges = [("hub", f"n{i}", 1.0) for i in range(60)] + [(f"n{i}", "hub", 2.0) for i in range(0, 60, 2)]
    edges += [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}", rng.choice([0.5, 1.0, 3.0])) for _ in range(150)]
    ranks, want = got(spark, edges, tolerance=1e-7, hub=3, rounds=12), plain(edges)
    assert all(abs(ranks[x] - want[x]) < 1e-6 for x in want)


def test_no_links_no_ranks_and_too_few_rounds(spark):
    assert got(spark, []) == {}
    with pytest.raises(RuntimeError):
        got(spark, HAND_MADE, tolerance=1e-15, max_rounds=4)
    with pytest.raises(ValueError):
        got(spark, HAND_MADE, damping=1.0)
