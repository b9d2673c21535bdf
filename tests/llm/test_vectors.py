import math

import numpy as np

from fusemill.llm import graph


def vectors(n, seed=0, clusters=40):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(clusters, graph.DIMENSIONS))
    x = centre[rng.integers(0, clusters, n)] + 0.3 * rng.normal(size=(n, graph.DIMENSIONS))
    return (x * rng.uniform(0.1, 9, (n, 1))).astype(np.float32)


def brute(ids, x, k):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = np.round(u @ u.T, 10)
    out = set()
    for i in range(len(ids)):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[i, j], ids[j]))[:k]
        out |= {(ids[i], ids[j]) for j in order}
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, rep int, near string").repartition(3)


def test_recall_over_several_cells(spark, monkeypatch):
    monkeypatch.setattr(graph, "CELL", 150)
    monkeypatch.setattr(graph, "SHARD", 400)
    monkeypatch.setattr(graph, "QUERY_CHUNK", 500)
    x = vectors(900)
    got = graph.nearest_vectors(frame(spark, [(i * 3, v.tolist(), 1, "n") for i, v in enumerate(x)]), "vec_id", "embedding", 5)
    pairs = {(r.id, r.near) for r in got.collect()}
    want = brute([i * 3 for i in range(900)], x, 5)
    assert len(pairs) == len(want) and len(pairs & want) / len(want) >= 0.95


def test_divided_cells(spark, monkeypatch):
    monkeypatch.setattr(graph, "CELL", 100)
    monkeypatch.setattr(graph, "SHARD", 250)
    monkeypatch.setattr(graph, "MOST_CELLS", 2)
    monkeypatch.setattr(graph, "QUERY_CHUNK", 150)
    x = vectors(800, 8)
    got = graph.nearest_vectors(frame(spark, [(i, v.tolist(), 1, "n") for i, v in enumerate(x)]), "vec_id", "embedding", 4)
    pairs = {(r.id, r.near) for r in got.collect()}
    want = brute(list(range(800)), x, 4)
    assert len(pairs) == len(want) and len(pairs & want) / len(want) >= 0.9


def test_more_neighbours_than_the_least_beam(spark):
    x, k = vectors(400, 5), 2 * graph.BEAM + 4
    got = graph.nearest_vectors(frame(spark, [(i, v.tolist(), 1, "n") for i, v in enumerate(x)]), "vec_id", "embedding", k)
    pairs = {(r.id, r.near) for r in got.collect()}
    want = brute(list(range(400)), x, k)
    assert len(pairs) == len(want) and len(pairs & want) / len(want) >= 0.95


def test_copies_unusable_rows_and_few_vectors(spark):
    x = vectors(6, 3)
    rows = [(i, v.tolist(), 1, "n") for i, v in enumerate(x)] + [(10 + i, x[0].tolist(), 1, "n") for i in range(9)]
    bad = [(50, None), (51, []), (52, [0.0] * 96), (53, [math.nan] * 96), (54, [1.0] * 95), (55, [math.inf] * 96), (None, x[1].tolist())]
    got = graph.nearest_vectors(frame(spark, rows + [(i, v, 1, "n") for i, v in bad] + rows[:2]), "vec_id", "embedding", 3).collect()
    ids, m = [r[0] for r in rows], np.array([r[1] for r in rows], np.float32)
    assert {(r.id, r.near) for r in got} == brute(ids, m, 3)
    assert sorted(r["rank"] for r in got if r.id == 10) == [1, 2, 3]
    two = graph.nearest_vectors(frame(spark, rows[:2]), "vec_id", "embedding", 3).collect()
    assert {(r.id, r.near) for r in two} == {(0, 1), (1, 0)}


def test_empty(spark):
    assert graph.nearest_vectors(frame(spark, []), "vec_id", "embedding", 3).count() == 0


def test_pruning_keeps_diverse_edges():
    x = graph.unit(np.array([[1, 0], [0.99, 0.05], [0.98, 0.06], [-1, 0.1], [0, 1]], np.float32))
    edges = graph.robust_prune(np.concatenate([x, np.zeros((1, 2), np.float32)]), np.array([0]), np.array([[1, 2, 3, 4, -1]], np.int32), 4, 1.2)
    assert edges[0, 0] == 1 and 2 not in edges[0] and 4 in edges[0]
