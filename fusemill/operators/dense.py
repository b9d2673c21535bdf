"""Exact dense search and vector table operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fusemill.functions.vectors import augmented_document, augmented_query, squared_norm
from fusemill.operators.ranking import top_k
from fusemill.runtime import written

#: Query vectors broadcast at once (64 dimensions: 8 MB); more are taken in blocks of this size against all rows.
QUERY_BLOCK = 16_384
#: Rows of a cell that meet its targets in one task.
CELL_ROWS = 50_000
METRICS = ("dot", "reciprocal", "opposite")


def _scores(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    if metric == "dot":
        return q @ x.T
    distance = np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * (q @ x.T), 0.0)
    return -distance if metric == "opposite" else 1.0 / (1e-6 + distance)


def knn_exact(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "dot", digits: int = 6) -> DataFrame:
    """(qid, rank, doc_id, score): the k best of ``corpus`` (doc_id, vector) for every query (qid, vector).

    A matrix product per Arrow batch, with the batch's k best per query passed on; the global choice limits again
    before its shuffle. Queries are broadcast in blocks of at most ``QUERY_BLOCK``. Scores are double, rounded before
    ranking; ties go to the smaller doc_id. Null vectors take part on neither side; fewer than k rows: fewer results.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; choose from {', '.join(METRICS)}")
    spark = corpus.sparkSession
    wanted = written(queries.select("qid", "vector").filter("qid is not null and vector is not null"), "dense_queries")
    blocks = max(1, -(-wanted.count() // QUERY_BLOCK))
    found = None
    for block in range(blocks):
        part = wanted.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block).toArrow()
        ids = np.asarray(part.column("qid"), dtype=np.int64)
        matrix = np.array(part.column("vector").to_pylist(), dtype=np.float64)
        shared = spark.sparkContext.broadcast((ids, matrix))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qid, q = shared.value
            for batch in batches:
                if not batch.num_rows or not len(qid):
                    continue
                doc = np.asarray(batch.column(0), dtype=np.int64)
                x = np.asarray(batch.column(1).flatten(), dtype=np.float64).reshape(len(doc), -1)
                by_id = np.argsort(doc, kind="stable")
                doc, x = doc[by_id], x[by_id]
                for at in range(0, len(qid), 1024):
                    score = np.round(_scores(metric, q[at : at + 1024], x), digits)
                    top = np.argsort(-score, axis=1, kind="stable")[:, :k]
                    rows = np.arange(len(score))[:, None]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid[at : at + 1024], top.shape[1])), pa.array(doc[top].ravel()), pa.array(score[rows, top].ravel())], names=["qid", "doc_id", "score"])

        here = corpus.select("doc_id", "vector").filter("doc_id is not null and vector is not null").mapInArrow(run, "qid bigint, doc_id bigint, score double")
        found = here if found is None else found.unionByName(here)
    return top_k(found, ["qid"], "score", "doc_id", k)


def all_scores(queries: DataFrame, corpus: DataFrame, metric: str = "dot", digits: int = 6) -> DataFrame:
    """(qid, doc_id, score) of every query with every row, streamed from the tasks for an aggregate to follow; nothing is ranked or shuffled.

    Queries are broadcast in blocks of at most ``QUERY_BLOCK``. Meant for losses over batches and query sets; same null rules as :func:`knn_exact`.
    """
    spark = corpus.sparkSession
    wanted = written(queries.select("qid", "vector").filter("qid is not null and vector is not null"), "dense_queries")
    blocks = max(1, -(-wanted.count() // QUERY_BLOCK))
    found = None
    for block in range(blocks):
        part = wanted.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block).toArrow()
        shared = spark.sparkContext.broadcast((np.asarray(part.column("qid"), dtype=np.int64), np.array(part.column("vector").to_pylist(), dtype=np.float64)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qid, q = shared.value
            for batch in batches:
                doc = np.asarray(batch.column(0), dtype=np.int64)
                x = np.asarray(batch.column(1).flatten(), dtype=np.float64).reshape(len(doc), -1)
                for at in range(0, len(qid) if len(doc) else 0, 256):
                    score = np.round(_scores(metric, q[at : at + 256], x), digits)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid[at : at + 256], len(doc))), pa.array(np.tile(doc, len(score))), pa.array(score.ravel())], names=["qid", "doc_id", "score"])

        here = corpus.select("doc_id", "vector").filter("doc_id is not null and vector is not null").mapInArrow(run, "qid bigint, doc_id bigint, score double")
        found = here if found is None else found.unionByName(here)
    return found


def nearest_in_cells(rows: DataFrame, targets: DataFrame, cells: DataFrame, k: int, probes: int, homes: int = 3, metric: str = "dot", digits: int = 6) -> DataFrame:
    """As :func:`nearest_of`, approximately, for a target side that grows with the rows: work per row is ``probes`` cells instead of all targets.

    ``cells`` (doc_id, vector) are coarse centres, say the square root of the targets. Every target goes to its ``homes`` nearest cells, every row to its
    ``probes`` nearest; they meet cell by cell, the rows of a cell in chunks of ``CELL_ROWS``, so neither side of a task grows with the data.
    """
    placed = nearest_of(targets.select(F.col("doc_id").alias("qid"), "vector"), cells, homes, metric).select(F.col("qid").alias("doc_id"), F.col("doc_id").alias("cell")).join(targets.select("doc_id", "vector"), "doc_id")
    asked = nearest_of(rows, cells, probes, metric).select("qid", F.col("doc_id").alias("cell")).join(rows.select("qid", "vector"), "qid")
    asked = written(asked, "asked")
    chunks = asked.groupBy("cell").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("chunks"))
    asked = asked.join(chunks, "cell").withColumn("chunk", F.pmod(F.xxhash64("qid"), F.col("chunks")).cast("int")).drop("chunks")
    placed = placed.join(chunks, "cell").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        matrix = lambda t: np.asarray(t.column("vector").combine_chunks().flatten(), dtype=np.float64).reshape(t.num_rows, -1)
        names = ["qid", "doc_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        right = right.sort_by("doc_id")
        doc, x, qid, q = np.asarray(right.column("doc_id"), dtype=np.int64), matrix(right), np.asarray(left.column("qid"), dtype=np.int64), matrix(left)
        out = []
        for at in range(0, len(qid), 1024):
            score = np.round(_scores(metric, q[at : at + 1024], x), digits)
            top = np.argsort(-score, axis=1, kind="stable")[:, :k]
            out.append((np.repeat(qid[at : at + 1024], top.shape[1]), doc[top].ravel(), np.take_along_axis(score, top, axis=1).ravel()))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], names=names)

    met = asked.groupBy("cell", "chunk").cogroup(placed.select("cell", "chunk", "doc_id", "vector").groupBy("cell", "chunk")).applyInArrow(run, "qid bigint, doc_id bigint, score double")
    met = met.groupBy("qid", "doc_id").agg(F.max("score").alias("score"))  # a target has several cells
    return top_k(met, ["qid"], "score", "doc_id", k)


def nearest_of(rows: DataFrame, targets: DataFrame, k: int, metric: str = "dot", digits: int = 6) -> DataFrame:
    """(qid, rank, doc_id, score): the k best ``targets`` (doc_id, vector) for every one of many ``rows`` (qid, vector).

    The mirror of :func:`knn_exact` for a small target side: the rows stream through the tasks and are never
    collected; the targets are broadcast in blocks of at most ``QUERY_BLOCK``, and each block's k best are chosen among
    again. Same rounding, ties and null rules.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; choose from {', '.join(METRICS)}")
    spark = rows.sparkSession
    wanted = written(targets.select("doc_id", "vector").filter("doc_id is not null and vector is not null"), "targets")
    blocks = max(1, -(-wanted.count() // QUERY_BLOCK))
    found = None
    for block in range(blocks):
        part = wanted.filter(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) == block).orderBy("doc_id").toArrow()
        ids = np.asarray(part.column("doc_id"), dtype=np.int64)
        shared = spark.sparkContext.broadcast((ids, np.array(part.column("vector").to_pylist(), dtype=np.float64)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            doc, x = shared.value
            for whole in batches:
                for at in range(0, whole.num_rows if len(doc) else 0, 1024):
                    batch = whole.slice(at, 1024)
                    qid = np.asarray(batch.column(0), dtype=np.int64)
                    score = np.round(_scores(metric, np.asarray(batch.column(1).flatten(), dtype=np.float64).reshape(len(qid), -1), x), digits)
                    top = np.argsort(-score, axis=1, kind="stable")[:, :k]
                    each = np.arange(len(score))[:, None]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, top.shape[1])), pa.array(doc[top].ravel()), pa.array(score[each, top].ravel())], names=["qid", "doc_id", "score"])

        here = rows.select("qid", "vector").filter("qid is not null and vector is not null").mapInArrow(run, "qid bigint, doc_id bigint, score double")
        found = here if found is None else found.unionByName(here)
    return top_k(found, ["qid"], "score", "doc_id", k)


def largest_squared_norm(vectors: DataFrame) -> DataFrame:
    """One row (largest)."""
    return vectors.agg(F.max(squared_norm(F.col("vector"))).alias("largest"))


def mips_to_l2(vectors: DataFrame, role: str) -> DataFrame:
    """Add ``augmented``: documents get sqrt(largest - norm) in front, queries 0."""
    if role == "query":
        return vectors.withColumn("augmented", augmented_query(F.col("vector")))
    if role != "document":
        raise ValueError("role is 'document' or 'query'")
    return vectors.crossJoin(F.broadcast(largest_squared_norm(vectors))).withColumn("augmented", augmented_document(F.col("vector"), F.col("largest"))).drop("largest")


def reordered(vectors: DataFrame, order: DataFrame, key: str) -> DataFrame:
    """(pos, key, vector) in the order of another table (pos, key); keys without a vector drop out."""
    return order.join(vectors, key).orderBy("pos")


def pooled_vectors(tokens: DataFrame, how: str) -> DataFrame:
    """(doc_id, vector) from token vectors (doc_id, pos, mask, vector): first (cls), masked mean, or last unmasked (eos)."""
    live = tokens.filter("mask = 1")
    if how == "cls":
        return live.groupBy("doc_id").agg(F.min_by("vector", "pos").alias("vector"))
    if how == "eos":
        return live.groupBy("doc_id").agg(F.max_by("vector", "pos").alias("vector"))
    if how != "mean":
        raise ValueError(f"unknown pooling {how!r}; choose from cls, mean, eos")
    per = live.select("doc_id", F.posexplode("vector").alias("dim", "x")).groupBy("doc_id", "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return per.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("vector"))


def last_per_key(df: DataFrame, key: str, by: list) -> DataFrame:
    """Keyed overwrite: one row per key, the first in the order ``by``."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*by))).filter("_n = 1").drop("_n")
