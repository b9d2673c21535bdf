"""Ranking metrics with both denominators, and losses that are aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fusemill.runtime import written

CUTOFFS = (1, 5, 10, 20, 100)
MRR_DEPTH = 10


def first_relevant(ranking: DataFrame, qrels: DataFrame) -> DataFrame:
    """(qid, first): rank of the first judged document of every query that has one in its ranking."""
    hits = ranking.join(qrels.select("qid", "doc_id").distinct(), ["qid", "doc_id"])
    return hits.groupBy("qid").agg(F.min("rank").alias("first"))


def evaluate(ranking: DataFrame, qrels: DataFrame, denominator: str = "ranked", cutoffs: tuple[int, ...] = CUTOFFS, check: bool = False) -> DataFrame:
    """One row: mrr_10, success_<k> and success_all, n_queries.

    ``denominator='ranked'`` averages over ranked queries, judged or not; ``'judged'`` over judged queries, ranked or
    not. success@k is 1 when the first judged document has a rank of at most k. With ``check`` a ranking that shares
    no query with the judgments is an error. An empty denominator gives nulls and 0 queries.
    """
    if denominator not in ("ranked", "judged"):
        raise ValueError("denominator is 'ranked' or 'judged'")
    ranking = written(ranking.select("qid", "rank", "doc_id"), "ranking")  # read twice below
    base = (ranking if denominator == "ranked" else qrels).select("qid").filter("qid is not null").distinct()
    if check and ranking.select("qid").join(qrels.select("qid"), "qid", "left_semi").isEmpty():
        raise ValueError("no ranked query is judged")
    each = base.join(first_relevant(ranking, qrels), "qid", "left")
    success = [F.round(F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)), 6).alias(f"success_{k}") for k in cutoffs]
    mrr = F.round(F.avg(F.when(F.col("first") <= MRR_DEPTH, F.lit(1.0) / F.col("first")).otherwise(0.0)), 6).alias("mrr_10")
    return each.agg(mrr, *success, F.round(F.avg(F.when(F.col("first").isNotNull(), 1.0).otherwise(0.0)), 6).alias("success_all"), F.count("*").alias("n_queries"))


#: Width of the score ranges that are added up apart, so that no exponential leaves the range of doubles.
_RANGE = 500.0


def soft_sums(scores: DataFrame, group: str, score: str, values: list[str] | None = None) -> DataFrame:
    """(group, lse, mean_<value>...): log-sum-exp of the scores, and the means of ``values`` under their softmax.

    One pass, combined map-side per group and range of scores; a group's few ranges are then put together from its greatest on.
    """
    values = values or []
    b = F.floor(F.col(score) / _RANGE)
    e = F.exp(F.col(score) - b * _RANGE)
    sums = [F.sum(e).alias("s"), *[F.sum(e * F.col(v)).alias(f"v{i}") for i, v in enumerate(values)]]
    ranges = scores.groupBy(group, b.alias("b")).agg(*sums)
    each = ranges.groupBy(group).agg(F.max("b").alias("m"), F.collect_list(F.struct("b", "s", *[f"v{i}" for i in range(len(values))])).alias("r"))
    total = lambda name: F.aggregate("r", F.lit(0.0), lambda acc, x: acc + x[name] * F.exp((x["b"] - F.col("m")) * _RANGE))
    return each.select(group, (F.col("m") * _RANGE + F.log(total("s"))).alias("lse"), *[(total(f"v{i}") / total("s")).alias(f"mean_{v}") for i, v in enumerate(values)])


def log_sum_exp(scores: DataFrame, group: str, score: str) -> DataFrame:
    """(group, lse)."""
    return soft_sums(scores, group, score)


def info_nce(scores: DataFrame, temperature: float = 1.0) -> DataFrame:
    """One row (loss): mean over queries of log-sum-exp minus the positive's score; scores (qid, doc_id, score, positive boolean)."""
    scaled = scores.withColumn("s", F.col("score") / F.lit(temperature))
    good = scaled.filter("positive").groupBy("qid").agg(F.max("s").alias("good"))
    return log_sum_exp(scaled, "qid", "s").join(good, "qid").agg(F.round(F.avg(F.col("lse") - F.col("good")), 6).alias("loss"))


def distillation(scores: DataFrame) -> DataFrame:
    """One row (kl, ce) of (qid, doc_id, teacher, student): mean over queries of KL(teacher || student) and of cross entropy.

    Both follow from sums per query: the means of the scores under the teacher and the two log-sum-exps.
    """
    t = soft_sums(scores, "qid", "teacher", ["teacher", "student"]).withColumnRenamed("lse", "lt")
    s = log_sum_exp(scores, "qid", "student").withColumnRenamed("lse", "ls")
    ce = F.col("ls") - F.col("mean_student")
    per = t.join(s, "qid").select((F.col("mean_teacher") - F.col("lt") + ce).alias("kl"), ce.alias("ce"))
    return per.agg(F.round(F.avg("kl"), 6).alias("kl"), F.round(F.avg("ce"), 6).alias("ce"))


def mutual_regularisation(scores: DataFrame, sparse_to_dense: float = 1.0, dense_to_sparse: float = 1.0) -> DataFrame:
    """One row (d2s, s2d, both) of (qid, doc_id, sparse, dense): KL of either distribution against the other and their weighted sum."""
    one = distillation(scores.select("qid", "doc_id", F.col("sparse").alias("teacher"), F.col("dense").alias("student"))).select(F.col("kl").alias("d2s"))
    two = distillation(scores.select("qid", "doc_id", F.col("dense").alias("teacher"), F.col("sparse").alias("student"))).select(F.col("kl").alias("s2d"))
    return one.crossJoin(two).withColumn("both", F.round(F.col("d2s") * dense_to_sparse + F.col("s2d") * sparse_to_dense, 6))


def balance(dense_loss: float, sparse_loss: float) -> tuple[float, float]:
    """(dense_to_sparse, sparse_to_dense): weights from the losses of the first regularised step, each the other's share."""
    total = dense_loss + sparse_loss
    return sparse_loss / total, dense_loss / total


def regularisation(step: Column, regulariser: Column, weight: float, warm_up: int) -> Column:
    """What the regulariser adds to the loss at a step: nothing before ``warm_up``, then ``weight`` times it."""
    return F.when(step < warm_up, F.lit(0.0)).otherwise(regulariser * weight)


def flops(weights: DataFrame, n_docs: DataFrame) -> DataFrame:
    """One row (flops): sum over terms of the squared mean absolute weight; documents without the term count as 0."""
    per = weights.groupBy("term").agg(F.sum(F.abs("weight")).alias("total")).crossJoin(F.broadcast(n_docs.select("n_docs")))
    return per.agg(F.round(F.sum(F.pow(F.col("total") / F.col("n_docs"), F.lit(2.0))), 6).alias("flops"))


def softmax(scores: DataFrame, group: str, score: str) -> DataFrame:
    """Add ``probability``; the sums of a group are combined map-side, so it may be of any size."""
    return scores.join(log_sum_exp(scores, group, score), group).withColumn("probability", F.exp(F.col(score) - F.col("lse"))).drop("lse")
