"""The prefix trie against a plain walk over all prefixes."""

import hashlib
import random
import zlib

import pytest

from larkspur.llm import trie


def brute(rows):
    """conv_id, turn, role, text: nodes by the definition."""
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn, role or "", text or ""))
    own = {}
    for conv, found in turns.items():
        def key(x):
            return hashlib.sha256(f"{len(x[1])}:{x[1]}{x[2]}".encode()).hexdigest()[:30]
        own[conv] = [x[1:] for x in sorted(found, key=lambda x: (x[0] is not None, x[0] or 0, key(x)))]
    built = {}
    for conv in own:
        h = zlib.crc32(str(conv).encode()) % 9
        base = conv - (abs(conv) % 5) * (1 if conv >= 0 else -1)
        built[conv] = own.get(base, [])[:h] + own[conv][h:]
    members = {}
    for conv, path in built.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(conv)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    out = []

    def walk(node):
        leaves, cost = (0, 0) if children.get(node) else (1, 0)
        cost += (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        for child in children.get(node, []):
            more = walk(child)
            leaves, cost = leaves + more[0], cost + more[1]
        ends = sorted(c for c in members[node] if len(built[c]) == len(node))
        out.append((
            min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(children.get(node, [])), leaves, cost,
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
        return leaves, cost

    if members:
        walk(())
    return sorted(out, key=str)


def got(frame):
    return sorted((tuple(r) for r in trie.node_rows(frame).collect()), key=str)


SCHEMA = "conv_id long, turn long, role string, text string"


def conversations(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        like = rng.random() < 0.4
        for t in range(rng.randint(1, longest)):
            text = f"shared {t}" if like else rng.choice(["yes", "no", "why é", "", None, f"own {c}"])
            rows.append((c * rng.choice([1, 1, 3]), rng.choice([t, t, t, None]), rng.choice(["user", "assistant", None]) if not like else "user", text))
    return rows


@pytest.mark.parametrize("seed,n,longest", [(1, 40, 6), (2, 30, 30), (3, 12, 90)])
def test_nodes_are_those_of_the_definition(spark, seed, n, longest):
    rows = conversations(seed, n, longest)
    rows += [(None, 1, "user", "nobody's"), (-3, 1, "user", "below zero"), (-5, 1, None, None)]
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute(rows)


def test_long_copies_share_their_blocks(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 60, 5) for t in range(70 if c % 2 else 83)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_chunks_change_nothing(spark, monkeypatch):
    rows = conversations(9, 8, 120)
    monkeypatch.setattr(trie, "CHUNK", 2)
    monkeypatch.setattr(trie, "ID_BITS", 1)
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_repeated_rows_extra_columns_and_empty_tables(spark):
    rows = [(1, 0, "user", "a")] * 3 + [(1, 0, "user", "b"), (2, None, None, None), (5, 1, "user", "a")]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "0 AS depth", "1 AS t0", "2 AS pos", "3 AS block", "4 AS `h i`")
    assert got(frame) == brute(rows)
    assert got(frame.where("false")) == [] and got(frame.where("conv_id = 77")) == []


def test_texts_of_the_nodes(spark):
    rows = [(5, 0, "user", "hello"), (5, 1, "assistant", "hi"), (10, 0, "user", "hello")]
    found = trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).texts().collect()
    assert {(r.depth, r.role, r.text) for r in found} <= {(0, None, None), (1, "user", "hello"), (2, "assistant", "hi"), (1, "assistant", "hi")}
    assert len(found) == len(brute(rows))
