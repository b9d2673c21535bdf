import math

import pytest

from fusemill.functions import scoring
from fusemill.operators import metrics, sampling

RANKING = [(1, 1, 100), (1, 2, 101), *[(2, i, 200 + i) for i in range(1, 12)], (3, 1, 300), (4, 1, 400)]
QRELS = [(1, 100), (2, 211), (3, 999), (5, 500), (1, 100)]


def make(spark):
    return spark.createDataFrame(RANKING, "qid bigint, rank bigint, doc_id bigint"), spark.createDataFrame(QRELS, "qid bigint, doc_id bigint")


def test_both_denominators(spark):
    ranking, qrels = make(spark)
    a = metrics.evaluate(ranking, qrels, "ranked").first()
    assert (a.n_queries, a.mrr_10, a.success_1, a.success_10, a.success_20, a.success_all) == (4, 0.25, 0.25, 0.25, 0.5, 0.5)
    b = metrics.evaluate(ranking, qrels, "judged").first()
    assert (b.n_queries, b.mrr_10, b.success_20) == (4, 0.25, 0.5)
    for r in (a, b):
        values = [r.success_1, r.success_5, r.success_10, r.success_20, r.success_100, r.success_all]
        assert values == sorted(values) and r.mrr_10 <= r.success_10


def test_no_overlap_and_bad_arguments(spark):
    ranking, qrels = make(spark)
    with pytest.raises(ValueError):
        metrics.evaluate(ranking.filter("qid = 4"), qrels, check=True)
    with pytest.raises(ValueError):
        metrics.evaluate(ranking, qrels, "all")
    assert metrics.evaluate(ranking.limit(0), qrels).first().n_queries == 0


def test_losses(spark):
    rows = [(1, 1, 2.0, 1.0, True), (1, 2, 1.0, 1.0, False), (2, 1, 0.0, 3.0, False), (2, 2, 1.0, 0.0, True)]
    df = spark.createDataFrame(rows, "qid bigint, doc_id bigint, score double, student double, positive boolean")
    lse = lambda xs: math.log(sum(math.exp(x) for x in xs))
    assert abs(metrics.info_nce(df).first().loss - ((lse([2, 1]) - 2) + (lse([0, 1]) - 1)) / 2) < 1e-6
    got = metrics.distillation(df.withColumnRenamed("score", "teacher")).first()
    kl = ce = 0
    for t, s in (([2, 1], [1, 1]), ([0, 1], [3, 0])):
        for x, y in zip(t, s):
            p = math.exp(x - lse(t))
            kl += p * ((x - lse(t)) - (y - lse(s))) / 2
            ce -= p * (y - lse(s)) / 2
    assert abs(got.kl - kl) < 1e-6 and abs(got.ce - ce) < 1e-6
    w = spark.createDataFrame([("a", 1.0), ("a", -1.0), ("b", 2.0)], "term string, weight double")
    assert metrics.flops(w, spark.createDataFrame([(2,)], "n_docs bigint")).first().flops == 2.0


def test_schedule_and_saturation(spark):
    df = spark.createDataFrame([(0, -1.0), (50, 0.0), (100, 1.0), (500, 3.0)], "t bigint, x double")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(scoring.quadratic_schedule(F.col("t"), 0.4, 100)).collect()] == [0, 0.1, 0.4, 0.4]
    assert [round(r[0], 6) for r in df.select(scoring.saturated(F.col("x"))).collect()] == [0, 0, round(math.log(2), 6), round(math.log(4), 6)]


def test_sampling(spark):
    ids = spark.createDataFrame([(i,) for i in range(100)] + [(None,), (5,)], "doc_id bigint")
    judged = spark.createDataFrame([(3,), (3,), (None,), (777,)], "doc_id bigint")
    one = {r[0] for r in sampling.sample_ids(ids, "doc_id", 0.25).collect()}
    assert len(one) == 25 and one == {r[0] for r in sampling.sample_ids(ids.repartition(7), "doc_id", 0.25).collect()}
    assert {r[0] for r in sampling.sample_corpus(ids, judged, "doc_id", 0.25).collect()} == one | {3, 777}
    shards = [{r[0] for r in sampling.shard(ids, "doc_id", 3, i).collect()} for i in range(3)]
    assert set.union(*shards) == set(range(100)) and not shards[0] & shards[1]
    negatives = spark.createDataFrame([(1, [5, 6, 7]), (2, []), (3, [1])], "qid bigint, negatives array<bigint>")
    assert sorted(r.qid for r in sampling.negatives(negatives, 2).collect()) == [1, 1, 3]
