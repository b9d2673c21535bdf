import math
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fusemill.functions import scoring
from fusemill.functions.text import terms
from fusemill.operators import index, sampling, sparse

DOCS = [(1, "red fox red"), (2, "blue fox"), (3, ""), (4, "red red red red"), (5, "green blue fox sky")]
QUERY = [(1, "red fox"), (2, "missing"), (3, "fox fox sky")]


def build(spark, docs=DOCS, method="lucene"):
    tok = index.tokens(spark.createDataFrame(docs, "doc_id bigint, text string"), "doc_id", terms(F.col("text")))
    tf = index.term_frequencies(tok)
    return tok, tf, index.postings(tok, tf, method)


def weight(method, tf, df, dl, n, avg, k1=1.2, b=0.75, delta=0.5):
    idf = {
        "robertson": math.log(max(1, (n - df + 0.5) / (df + 0.5))),
        "lucene": math.log(1 + (n - df + 0.5) / (df + 0.5)),
        "atire": math.log(n / df),
        "bm25l": math.log((n + 1) / (df + 0.5)),
        "bm25+": math.log((n + 1) / df),
    }[method]
    norm = 1 - b + b * dl / avg
    if method in ("robertson", "lucene"):
        return idf * tf / (k1 * norm + tf)
    if method == "bm25l":
        return idf * (k1 + 1) * (tf / norm + delta) / (k1 + tf / norm + delta)
    return idf * (tf * (k1 + 1) / (tf + k1 * norm) + (delta if method == "bm25+" else 0))


@pytest.mark.parametrize("method", list(scoring.IDF))
def test_every_variant_against_hand_computation(spark, method):
    words = {d: t.split() for d, t in DOCS}
    df = Counter(t for w in words.values() for t in set(w))
    avg = sum(map(len, words.values())) / len(words)
    want = {(t, d): weight(method, n, df[t], len(w), len(words), avg) for d, w in words.items() for t, n in Counter(w).items()}
    got = {(r.term, r.doc_id): r.weight for r in build(spark, method=method)[2].collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        build(spark, method="bm26")


def test_search_ties_threshold_and_missing_terms(spark):
    _, _, post = build(spark, [(1, "a b"), (2, "a b"), (3, "c")])
    q = sparse.text_queries(spark.createDataFrame([(1, "a"), (2, "zzz"), (3, None)], "qid bigint, text string"), "qid", terms(F.col("text")))
    got = [(r.qid, r["rank"], r.doc_id) for r in sparse.search(q, post, 5).orderBy("qid", "rank").collect()]
    assert got == [(1, 1, 1), (1, 2, 2)]
    best = sparse.search(q, post, 5).first().score
    assert sparse.search(q, post, 5, threshold=best).count() == 0


def test_sharded_equals_global(spark):
    _, _, post = build(spark)
    q = sparse.text_queries(spark.createDataFrame(QUERY, "qid bigint, text string"), "qid", terms(F.col("text")))
    whole = sorted(map(tuple, sparse.search(q, post, 2).select("qid", "rank", "doc_id", "score").collect()))
    parts = [sparse.search(q, sampling.shard(post, "doc_id", 3, i), 2) for i in range(3)]
    assert sorted(map(tuple, sparse.merged_top_k(parts, 2).select("qid", "rank", "doc_id", "score").collect())) == whole


def test_pruning_statistics_and_merge(spark):
    tok, tf, post = build(spark)
    stats = index.corpus_stats(tok)
    assert stats.first().n_docs == 5
    assert index.stop_terms(post, stats, 1.0).count() == 0
    assert {r.term for r in index.stop_terms(post, stats, 0.5).collect()} == {"fox"}
    assert index.without_terms(post, index.stop_terms(post, stats, 0.5)).filter("term = 'fox'").count() == 0
    assert index.merged(post.filter("doc_id < 3"), post.filter("doc_id >= 3")).count() == post.count()
    ids = {r.term: r.term_id for r in index.term_ids(tf).collect()}
    assert ids == {t: i for i, t in enumerate(sorted(ids))}
    packed = {r.term: [(p.doc_id) for p in r.postings] for r in index.packed(post).collect()}
    assert packed["fox"] == [1, 2, 5]


def test_empty_corpus(spark):
    tok, tf, post = build(spark, [])
    assert post.count() == 0 and tf.count() == 0
    q = sparse.text_queries(spark.createDataFrame(QUERY, "qid bigint, text string"), "qid", terms(F.col("text")))
    assert sparse.search(q, post, 3).count() == 0


def test_weighted_queries_default_weight(spark):
    df = spark.createDataFrame([(1, [5, 6], [2.0, None]), (2, [5], None), (3, [], [])], "id bigint, t array<bigint>, w array<double>")
    got = {(r.qid, r.term): r.weight for r in sparse.weighted_queries(df, "id", "t", "w").collect()}
    assert got == {(1, 5): 2.0, (1, 6): 1.0, (2, 5): 1.0}


def test_pooling_and_budget(spark):
    logits = spark.createDataFrame([(1, 0, "a", 1.0), (1, 1, "a", -3.0), (1, 2, "b", 2.0), (2, 0, "c", 0.0)], "doc_id bigint, pos int, term string, logit double")
    val = {h: {(r.doc_id, r.term): round(r.weight, 9) for r in sparse.pooled(logits, h).collect()} for h in ("sum", "max", "mean")}
    assert val["sum"][1, "a"] == val["max"][1, "a"] == round(math.log(2), 9) and val["mean"][1, "b"] == round(math.log(3) / 3, 9)
    kept = sparse.term_budget(sparse.pooled(logits, "max"), "doc_id", 1).collect()
    assert [(r.doc_id, r.term) for r in kept] == [(1, "b")]
    with pytest.raises(ValueError):
        sparse.pooled(logits, "median")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=6), min_size=1, max_size=6))
def test_index_score_equals_brute_force(spark, docs):
    _, _, post = build(spark, [(i, " ".join(d)) for i, d in enumerate(docs)])
    q = sparse.text_queries(spark.createDataFrame([(1, "a b b")], "qid bigint, text string"), "qid", terms(F.col("text")))
    got = {r.doc_id: r.score for r in sparse.match(q, post).collect()}
    df = Counter(t for d in docs for t in set(d))
    avg = sum(map(len, docs)) / len(docs)
    for i, d in enumerate(docs):
        c = Counter(d)
        want = sum(w * weight("lucene", c[t], df[t], len(d), len(docs), avg) for t, w in (("a", 1), ("b", 2)) if c[t])
        assert abs(got.get(i, 0) - want) < 1e-5
