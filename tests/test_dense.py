import math

import numpy as np
import pytest

from fusemill.operators import ann, dense, hybrid

V = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [0.5, 3.0]), (4, None)]
SCHEMA = "doc_id bigint, vector array<float>"


def table(spark, rows=V):
    return spark.createDataFrame(rows, SCHEMA)


def queries(spark, rows):
    return spark.createDataFrame(rows, "qid bigint, vector array<float>")


@pytest.mark.parametrize("metric", dense.METRICS)
def test_exact_search_matches_brute_force(spark, metric):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(60)]
    q = rows[:7]
    got = [tuple(r) for r in dense.knn_exact(queries(spark, q), table(spark, rows), 4, metric).select("qid", "rank", "doc_id").collect()]
    x = np.array([v for _, v in rows], np.float32).astype(float)
    for i in range(7):
        d2 = ((x - x[i]) ** 2).sum(1)
        score = {"dot": x @ x[i], "opposite": -d2, "reciprocal": 1 / (1e-6 + d2)}[metric]
        want = sorted(range(60), key=lambda j: (-round(score[j], 6), j))[:4]
        assert [d for qq, _, d in sorted(got) if qq == i] == want


def test_ties_nulls_and_short_tables(spark):
    got = dense.knn_exact(queries(spark, [(9, [1.0, 0.0]), (10, None)]), table(spark), 10).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [0, 1, 3, 2]
    assert dense.knn_exact(queries(spark, []), table(spark), 3).count() == 0
    assert dense.knn_exact(queries(spark, [(1, [1.0, 0.0])]), table(spark, []), 3).count() == 0
    with pytest.raises(ValueError):
        dense.knn_exact(queries(spark, []), table(spark), 3, "cosine")


def test_query_blocks_give_the_same(spark, monkeypatch):
    q = queries(spark, [(i, [float(i), 1.0]) for i in range(9)])
    one = sorted(map(tuple, dense.knn_exact(q, table(spark), 2).collect()))
    monkeypatch.setattr(dense, "QUERY_BLOCK", 2)
    assert sorted(map(tuple, dense.knn_exact(q, table(spark), 2).collect())) == one


@pytest.mark.parametrize("metric", dense.METRICS)
def test_streamed_rows_give_the_same(spark, monkeypatch, metric):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(40)] + [(40, None)]
    one = sorted(map(tuple, dense.knn_exact(queries(spark, rows), table(spark, rows[:15]), 3, metric).collect()))
    for block in (4, 1000):
        monkeypatch.setattr(dense, "QUERY_BLOCK", block)
        assert sorted(map(tuple, dense.nearest_of(queries(spark, rows), table(spark, rows[:15]), 3, metric).collect())) == one
    assert dense.nearest_of(queries(spark, rows), table(spark, []), 3, metric).count() == 0


def test_augmentation_keeps_the_order(spark):
    rows = [(i, [float(i % 3), float(i)]) for i in range(8)]
    docs = {r.doc_id: np.array(r.augmented) for r in dense.mips_to_l2(table(spark, rows), "document").collect()}
    q = dense.mips_to_l2(queries(spark, [(1, [1.0, -2.0])]), "query").first().augmented
    assert q[0] == 0
    by_l2 = sorted(docs, key=lambda i: (round(float(((docs[i] - np.array(q)) ** 2).sum()), 6), i))
    by_dot = sorted(docs, key=lambda i: (-round(rows[i][1][0] - 2 * rows[i][1][1], 6), i))
    assert by_l2 == by_dot
    with pytest.raises(ValueError):
        dense.mips_to_l2(table(spark), "corpus")


def test_pooled_vectors(spark):
    t = spark.createDataFrame([(1, 0, 1, [1.0, 2.0]), (1, 1, 1, [3.0, 4.0]), (1, 2, 0, [9.0, 9.0])], "doc_id bigint, pos int, mask int, vector array<float>")
    got = {h: dense.pooled_vectors(t, h).first().vector for h in ("cls", "mean", "eos")}
    assert got == {"cls": [1.0, 2.0], "mean": [2.0, 3.0], "eos": [3.0, 4.0]}


CLUSTERS = [(1, 10), (1, 11), (2, 11), (3, 12)]
PROBED = [(7, 1, 1, 0.9), (7, 2, 2, 0.5), (7, 3, 99, 0.1)]


def test_candidates_collapse_and_last_cluster_wins(spark):
    clusters = spark.createDataFrame(CLUSTERS, "cluster_id bigint, doc_id bigint")
    probed = spark.createDataFrame(PROBED, "qid bigint, probe_rank bigint, cluster_id bigint, cluster_score double")
    assert sorted(r.doc_id for r in ann.candidates(probed, clusters).collect()) == [10, 11]
    assert {r.doc_id: r.score for r in ann.cluster_scored(probed, clusters).collect()} == {10: 0.9, 11: 0.5}


def test_probing_all_clusters_is_exact(spark):
    rng = np.random.default_rng(5)
    e = table(spark, [(i, [float(x) for x in rng.normal(size=6)]) for i in range(80)])
    q = e.limit(6).withColumnRenamed("doc_id", "qid")
    head = ann.heads(e)
    found = ann.search_ann(q, e, head, ann.assign(e, head, 3), 8, 5)
    assert sorted(map(tuple, found.select("qid", "doc_id").collect())) == sorted(map(tuple, dense.knn_exact(q, e, 5).select("qid", "doc_id").collect()))


def test_fusion(spark):
    schema = "qid bigint, doc_id bigint, score double"
    s, d = spark.createDataFrame([(1, 1, 2.0), (1, 2, 1.0)], schema), spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.7)], schema)
    assert [tuple(r) for r in hybrid.fuse(s, d, 1, 10).collect()] == [(1, 2, 6.0)]
    assert {r.doc_id: r.score for r in hybrid.fuse(s, d, 1, 10, "full_outer").collect()} == {1: 2.0, 2: 6.0, 3: 7.0}
    grid = spark.createDataFrame([(1.0, 0.0), (0.0, 1.0)], "sparse_weight double, dense_weight double")
    assert hybrid.weight_grid(s, d, grid, 3).count() == 2
    assert math.isclose(hybrid.fuse(s.limit(0), d).count(), 0)


def test_kmeans_search_reaches_the_required_recall(spark):
    from fusemill.plans import catalog

    folder = "/root/testdata/sf0.1"
    exact = dense.knn_exact(catalog._emb_queries(spark, folder), catalog._emb(spark, folder), catalog.K).select("qid", "doc_id")
    found = catalog.QUERIES["ann_kmeans_search"](spark, folder).select("qid", "doc_id")
    assert exact.intersect(found).count() / exact.count() >= 0.9
