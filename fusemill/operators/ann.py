"""Cluster-based approximate search: heads, replicated assignment, probing and re-ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusemill.functions.vectors import dot, opposite_distance, reciprocal_distance
from fusemill.operators.dense import nearest_in_cells, nearest_of
from fusemill.operators.ranking import top_k

HEAD_RATIO, REPLICAS, PROBES = 0.1, 8, 256
SCORES = {"dot": dot, "reciprocal": reciprocal_distance, "opposite": opposite_distance}


def heads(vectors: DataFrame, ratio: float = HEAD_RATIO, residue: int = 0) -> DataFrame:
    """(cluster_id, centroid): every 1/ratio-th id, those of the ``residue``, is a head; ids are assumed to be spread evenly."""
    step = max(1, round(1 / ratio))
    return vectors.filter(F.pmod("doc_id", F.lit(step)) == residue).select(F.col("doc_id").alias("cluster_id"), F.col("vector").alias("centroid"))


def kmeans_heads(vectors: DataFrame, clusters: int, seed: int = 1, rounds: int = 10) -> DataFrame:
    """(cluster_id, centroid) of a distributed k-means over all vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    fitted = KMeans(k=clusters, seed=seed, maxIter=rounds).fit(vectors.select(array_to_vector(F.transform("vector", lambda x: x.cast("double"))).alias("features")))
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(fitted.clusterCenters())]
    return vectors.sparkSession.createDataFrame(rows, "cluster_id bigint, centroid array<double>")


def probe(queries: DataFrame, head: DataFrame, n: int, metric: str = "dot") -> DataFrame:
    """(qid, probe_rank, cluster_id, cluster_score): the n best heads per query. Queries stream, heads are broadcast in blocks."""
    found = nearest_of(queries, head.select(F.col("cluster_id").alias("doc_id"), F.col("centroid").alias("vector")), n, metric)
    return found.select("qid", F.col("rank").alias("probe_rank"), F.col("doc_id").alias("cluster_id"), F.col("score").alias("cluster_score"))


def assign(vectors: DataFrame, head: DataFrame, replicas: int = REPLICAS) -> DataFrame:
    """(cluster_id, doc_id): each vector in its ``replicas`` nearest clusters."""
    return probe(vectors.select(F.col("doc_id").alias("qid"), "vector"), head, replicas).select("cluster_id", F.col("qid").alias("doc_id"))


def assign_in_cells(vectors: DataFrame, head: DataFrame, replicas: int = REPLICAS, probes: int = 8) -> DataFrame:
    """As :func:`assign`, approximately, for collections whose heads are too many to compare all: about the square root of the heads serve as coarse cells."""
    step = max(1, round(head.count() ** 0.5))
    targets = head.select(F.col("cluster_id").alias("doc_id"), F.col("centroid").alias("vector"))
    cells = targets.filter(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0)
    found = nearest_in_cells(vectors.select(F.col("doc_id").alias("qid"), "vector"), targets, cells, replicas, probes)
    return found.select(F.col("doc_id").alias("cluster_id"), F.col("qid").alias("doc_id"))


def candidates(probed: DataFrame, clusters: DataFrame) -> DataFrame:
    """Distinct (qid, doc_id) of the probed clusters; a document in several clusters counts once, absent clusters give none."""
    return probed.join(clusters, "cluster_id").select("qid", "doc_id").distinct()


def rescored(pairs: DataFrame, queries: DataFrame, vectors: DataFrame, metric: str = "dot", digits: int = 6) -> DataFrame:
    """(qid, doc_id, score) of candidate pairs by their vectors; candidates without a vector drop out."""
    both = pairs.join(vectors.select("doc_id", F.col("vector").alias("dv")), "doc_id").join(queries.select("qid", F.col("vector").alias("qv")), "qid")
    return both.select("qid", "doc_id", F.round(SCORES[metric](F.col("qv"), F.col("dv")), digits).alias("score"))


def cluster_scored(probed: DataFrame, clusters: DataFrame) -> DataFrame:
    """(qid, doc_id, score): a document takes the score of its last probed cluster."""
    return probed.join(clusters, "cluster_id").groupBy("qid", "doc_id").agg(F.max_by("cluster_score", "probe_rank").alias("score"))


def search_ann(queries: DataFrame, vectors: DataFrame, head: DataFrame, clusters: DataFrame, n: int, k: int, metric: str = "dot") -> DataFrame:
    return top_k(rescored(candidates(probe(queries, head, n), clusters), queries, vectors, metric), ["qid"], "score", "doc_id", k)
