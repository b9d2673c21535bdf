"""Searches whose work follows the documents and the distinct queries, not their product."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from fusemill.functions.text import terms
from fusemill.operators import index, shards, sparse
from fusemill.operators.ranking import top_k

DATA = "/root/testdata/sf0.001"
#: Finding by finding.
SEARCHES = ["bm25_topk_atire", "bm25_topk_lucene", "metrics_ranked_denominator", "bm25_stored", "bm25_topk_bm25l", "bm25_topk_robertson", "sharded_topk", "sink_stage_times", "bm25_pinned_average", "metrics_qrels_denominator", "bm25_threshold", "bm25_topk_bm25plus"]


@pytest.mark.parametrize("name", SEARCHES)
def test_no_score_is_made_for_every_pair(spark, monkeypatch, name):
    def pairs(*_, **__):
        raise AssertionError("all pairs of queries and documents")

    monkeypatch.setattr(sparse, "match", pairs)
    assert __spark_entry__.queries()[name](spark, DATA).columns


def _texts(n: int, seed: int) -> list[tuple[int, str]]:
    r = random.Random(seed)
    return [(i, " ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 6)))) for i in r.sample(range(10 * n), n)]


@pytest.mark.parametrize(("k", "threshold", "size"), [(1, 0.0, 50), (3, 0.4, 200), (10, 0.0, 1_000_000), (500, 0.0, 50)])
def test_shards_give_the_same_rows_as_all_pairs(spark, monkeypatch, k, threshold, size):
    monkeypatch.setattr(shards, "SHARD_POSTINGS", size)
    monkeypatch.setattr(shards, "_STRIDE", 4)
    tok = index.tokens(spark.createDataFrame(_texts(300, 1), "doc_id bigint, text string"), "doc_id", terms(F.col("text")))
    q = sparse.text_queries(spark.createDataFrame([*_texts(40, 2), (-1, "zzz"), (-2, "zzz a"), (-3, "a")], "qid bigint, text string"), "qid", terms(F.col("text")))
    rows = lambda df: sorted((r.qid, r["rank"], r.doc_id, round(r.score, 6)) for r in df.collect())
    for method in ("lucene", "bm25+"):
        post = index.postings(tok, index.term_frequencies(tok), method)
        want = rows(top_k(sparse.above(sparse.match(q, post), threshold), ["qid"], "score", "doc_id", k))
        assert rows(sparse.search(q, post, k, threshold)) == want
        assert rows(sparse.search(q, index.wanted_postings(tok, q, method), k, threshold)) == want


def test_negative_weights_repeats_and_empty_sides(spark):
    post = spark.createDataFrame([("a", 1, 2.0), ("b", 1, -1.5), ("a", 2, 1.0), ("a", 2, 0.25), ("b", 3, -1.0)], "term string, doc_id bigint, weight double")
    q = spark.createDataFrame([(1, "a", 1.0), (1, "b", 1.0), (2, "b", -2.0), (3, "b", 1.0)], "qid bigint, term string, weight double")
    rows = lambda df: sorted((r.qid, r["rank"], r.doc_id, r.score) for r in df.collect())
    assert rows(sparse.search(q, post, 5)) == [(1, 1, 2, 1.25), (1, 2, 1, 0.5), (2, 1, 1, 3.0), (2, 2, 3, 2.0)]
    assert rows(sparse.search(q, post, 5, threshold=-2.0)) == [(1, 1, 2, 1.25), (1, 2, 1, 0.5), (1, 3, 3, -1.0), (2, 1, 1, 3.0), (2, 2, 3, 2.0), (3, 1, 3, -1.0), (3, 2, 1, -1.5)]
    assert rows(sparse.search(q.limit(0), post, 5)) == rows(sparse.search(q, post.limit(0), 5)) == []
