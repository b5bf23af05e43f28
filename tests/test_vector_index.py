"""The kept vector index: recall, exactness with all cells, later batches, odd rows."""

import numpy as np
import pytest

from larkspur.operators.vector_index import VectorIndex, nearest_centres
from larkspur.operators.vectors import best_rows, vector_topk


def vectors(n=600, dims=8, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 3, (12, dims))
    return centres[rng.integers(0, 12, n)] + rng.normal(0, 1, (n, dims))


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


def brute(x, q, k, cosine=False):
    d = 1 - (q @ x.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(x, axis=1)[None] if cosine else np.sqrt(((q[:, None] - x[None]) ** 2).sum(2))
    return [[(int(j), float(row[j])) for j in np.lexsort((np.arange(len(x)), np.round(row, 12)))[:k]] for row in d]


def rows(found):
    out = {}
    for r in found.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.id, r.distance))
    return out


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_all_cells_give_the_exact_neighbours(spark, tmp_path, metric):
    x = vectors()
    table = frame(spark, x)
    index = VectorIndex.build(table, "vec_id", "embedding", str(tmp_path / "index"), metric, cells=10)
    found = rows(index.search(table.where("vec_id < 40"), "vec_id", "embedding", 5, probes=10))
    for i, want in enumerate(brute(x, x[:40], 5, metric == "cosine")):
        assert [a for a, _ in found[i]] == [a for a, _ in want]
        assert np.allclose([d for _, d in found[i]], [d for _, d in want], atol=1e-9)


def test_few_cells_reach_the_recall_that_was_asked_for(spark, tmp_path):
    x = vectors(1500)
    table = frame(spark, x)
    index = VectorIndex.build(table, "vec_id", "embedding", str(tmp_path / "index"))
    queries = table.where("vec_id % 20 = 0")
    probes, share = index.tune(queries, "vec_id", "embedding", 5, 0.9)
    assert share >= 0.9 and probes < len(index.centres)
    found = rows(index.search(queries, "vec_id", "embedding", 5, probes))
    wanted = brute(x, x[::20], 5)
    hit = sum(len({a for a, _ in want} & {a for a, _ in found[20 * i]}) for i, want in enumerate(wanted))
    assert hit >= 0.9 * 5 * len(wanted)
    assert index.recall(queries, "vec_id", "embedding", 5, len(index.centres)) == 1.0
    assert probes == 1 or index.recall(queries, "vec_id", "embedding", 5, probes - 1) < 0.9
    assert abs(hit / (5 * len(wanted)) - share) < 1e-9


def test_later_rows_are_found_without_a_rebuild(spark, tmp_path):
    x = vectors(300)
    folder = str(tmp_path / "index")
    index = VectorIndex.build(frame(spark, x), "vec_id", "embedding", folder, cells=6)
    for _ in range(2):  # a batch that is written again replaces itself
        index.add(frame(spark, x[:5] + 1e-6, first=1000), "vec_id", "embedding", 1)
    again = VectorIndex.load(spark, folder)
    assert np.array_equal(again.centres, index.centres) and again.rows().count() == 305
    found = rows(again.search(frame(spark, x[:5]), "vec_id", "embedding", 2, probes=6))
    assert [{a for a, _ in found[i]} for i in range(5)] == [{i, 1000 + i} for i in range(5)]
    with pytest.raises(ValueError):
        index.add(frame(spark, x), "vec_id", "embedding", 0)


def test_a_cell_in_many_blocks(spark, tmp_path, monkeypatch):
    """A hot vector: a third of all rows are equal; ties are in order of ids."""
    monkeypatch.setattr("larkspur.operators.vector_index.BLOCK", 37)
    monkeypatch.setattr("larkspur.operators.vector_index.QUERIES", 5)
    x = vectors(240)
    x[::3] = x[0]
    table = frame(spark, x)
    index = VectorIndex.build(table, "vec_id", "embedding", str(tmp_path / "index"), cells=4)
    found = rows(index.search(table.where("vec_id < 30"), "vec_id", "embedding", 4, probes=4))
    assert [[a for a, _ in found[i]] for i in range(30)] == [[a for a, _ in want] for want in brute(x, x[:30], 4)]
    exact = rows(vector_topk(table, table.where("vec_id < 30").withColumnRenamed("vec_id", "query_id"), "vec_id", "embedding", 4))
    assert [[a for a, _ in exact[i]] for i in range(30)] == [[a for a, _ in want] for want in brute(x, x[:30], 4)]


def test_rows_without_a_place(spark, tmp_path):
    data = [(1, [1.0, 0.0]), (2, None), (None, [1.0, 1.0]), (3, [1.0, None]), (4, [1.0]), (5, [0.0, 1.0]), (6, [float("nan"), 1.0])]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    index = VectorIndex.build(table, "vec_id", "embedding", str(tmp_path / "a"))
    assert sorted(r.id for r in index.rows().collect()) == [1, 5]
    assert sorted(r.query_id for r in index.search(table, "vec_id", "embedding", 3, 2).collect()) == [1, 1, 5, 5]
    empty = VectorIndex.build(table.where("false"), "vec_id", "embedding", str(tmp_path / "b"))
    assert empty.search(table, "vec_id", "embedding", 3).collect() == []
    with pytest.raises(ValueError):
        VectorIndex.build(table, "vec_id", "embedding", str(tmp_path / "c"), metric="dot")


def test_best_rows_with_ties():
    x = np.array([[0.0, 0.0]] * 50 + [[1.0, 0.0]])
    row, ids, distance = best_rows(np.array([[0.0, 0.0], [5.0, 0.0]]), x, np.arange(51)[::-1].copy(), 3, False)
    assert row.tolist() == [0, 0, 0, 1, 1, 1] and ids.tolist() == [1, 2, 3, 0, 1, 2] and distance[:4].tolist() == [0, 0, 0, 4]


def test_a_share_of_few_queries_is_reached_by_all(spark, tmp_path):
    """Where only some queries are judged, so many cells are taken that all queries together find what is asked for."""
    x = vectors(1500)
    table = frame(spark, x)
    index = VectorIndex.build(table, "vec_id", "embedding", str(tmp_path / "index"))
    queries = table.where("vec_id % 3 = 0")
    least = 0.9
    few, _ = index.tune(queries, "vec_id", "embedding", 5, least, judged=60, sure=0.0)
    probes, share = index.tune(queries, "vec_id", "embedding", 5, least, judged=60)
    assert probes > few and share > least
    assert index.recall(queries, "vec_id", "embedding", 5, probes) >= least


def test_a_vector_between_two_centres_has_one_first_cell():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (40, 64))
    centres[20:] = centres[:20]  # every centre twice: rounding alone decides
    x = rng.normal(0, 1, (300, 64))
    alone = np.concatenate([nearest_centres(v[None], centres, 3)[:, :1] for v in x])
    assert (nearest_centres(x, centres, 1) == alone).all() and (nearest_centres(x, centres, 3)[:, :1] == alone).all()
    assert (alone < 20).all() and all(len(set(row)) == 3 for row in nearest_centres(x, centres, 3).tolist())
