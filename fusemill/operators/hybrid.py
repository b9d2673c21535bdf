"""Fusion of a sparse and a dense ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusemill.functions.scoring import fused
from fusemill.operators.ranking import top_k


#: Rows of a grid of weights, at most.
MOST_SETTINGS = 10_000


def fuse(sparse: DataFrame, dense: DataFrame, sparse_weight: float = 1.0, dense_weight: float = 10000.0, how: str = "inner", digits: int = 6) -> DataFrame:
    """(qid, doc_id, score) of (qid, doc_id, score) tables: documents of both sides, or with ``how='full_outer'`` of either, absent scores being 0."""
    s, d = sparse.select("qid", "doc_id", F.col("score").alias("s")), dense.select("qid", "doc_id", F.col("score").alias("d"))
    both = s.join(d, ["qid", "doc_id"], how)
    return both.select("qid", "doc_id", F.round(fused(F.coalesce("s", F.lit(0.0)), F.coalesce("d", F.lit(0.0)), sparse_weight, dense_weight), digits).alias("score"))


def weight_grid(sparse: DataFrame, dense: DataFrame, weights: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """(sparse_weight, dense_weight, qid, rank, doc_id, score) for every row of ``weights``, a small table of settings."""
    s, d = sparse.select("qid", "doc_id", F.col("score").alias("s")), dense.select("qid", "doc_id", F.col("score").alias("d"))
    settings = weights.select("sparse_weight", "dense_weight").distinct()
    if settings.limit(MOST_SETTINGS + 1).count() > MOST_SETTINGS:
        raise ValueError(f"more than {MOST_SETTINGS} settings; every one is a ranking of its own")
    grid = s.join(d, ["qid", "doc_id"]).crossJoin(F.broadcast(settings))
    scored = grid.withColumn("score", F.round(fused(F.col("s"), F.col("d"), F.col("sparse_weight"), F.col("dense_weight")), digits)).drop("s", "d")
    return top_k(scored, ["sparse_weight", "dense_weight", "qid"], "score", "doc_id", k)
