"""Extension points: batch encoders, a table function that tokenises, training examples, hashing search, stage timing."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from fusemill.functions.text import WORD
from fusemill.operators.dense import pooled_vectors
from fusemill.operators.ranking import top_k
from fusemill.operators.sparse import pooled


def encoded(df: DataFrame, key: str, text: str, load: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 256) -> DataFrame:
    """(key, vector array<float>) by any encoder: ``load`` runs once per task and returns a function from texts to a matrix.

    Texts go through in Arrow batches, so only one batch is held. Null texts count as empty; null keys are kept.
    """
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                matrix = np.asarray(model([t or "" for t in part.column(1).to_pylist()]), np.float32)
                offsets = pa.array(np.arange(len(matrix) + 1) * matrix.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(matrix.ravel()))], names=[key, "vector"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, vector array<float>")


def hashed_encoder(dimensions: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A stand-in without weights: signed feature hashing of words, scaled to unit length."""
    import regex
    import xxhash

    word = regex.compile(WORD)

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions), np.float32)
        for i, t in enumerate(texts):
            for w in word.findall(t.lower()):
                h = xxhash.xxh3_64_intdigest(w.encode())
                out[i, h % dimensions] += 1.0 if h >> 63 else -1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return encode


@udtf(returnType="pos int, term string")
class Tokenize:
    """SQL: ``SELECT t.* FROM docs, LATERAL tokenize(text) t``; a null text gives no row."""

    def eval(self, text: str):
        import regex

        for i, w in enumerate(regex.findall(r"[\p{L}\p{N}]+", text.lower()) if text else []):
            yield i, w


def register_tokenize(spark: SparkSession, name: str = "tokenize") -> None:
    spark.udtf.register(name, Tokenize)


#: Outputs of an encoder by task name: the inputs each is made of.
TASKS = {"sent": "tokens", "sparse": "logits"}


def task_outputs(task_list: str, tokens: DataFrame, logits: DataFrame, dense_pooling: str = "mean", sparse_pooling: str = "max") -> dict[str, DataFrame]:
    """The outputs that a comma-separated list of task names switches on: ``sent`` pooled vectors, ``sparse`` pooled terms.

    Blanks around names are ignored and names may repeat; an unknown name is an error, an empty list switches nothing on.
    """
    names = list(dict.fromkeys(n.strip() for n in task_list.split(",") if n.strip()))
    if unknown := [n for n in names if n not in TASKS]:
        raise ValueError(f"unknown task {unknown[0]!r}; choose from {', '.join(TASKS)}")
    make = {"sent": lambda: pooled_vectors(tokens, dense_pooling), "sparse": lambda: pooled(logits, sparse_pooling)}
    return {n: make[n]() for n in names}


def training_examples(examples: DataFrame, queries: DataFrame, passages: DataFrame, negatives: int, seed: int = 0) -> DataFrame:
    """(qid, query, doc_id, text, positive) of (qid, positives array, negatives array): every positive and at most ``negatives`` negatives per query.

    Negatives are drawn without replacement in the order of a seeded hash; ids without a text drop out.
    """
    from fusemill.operators.sampling import negatives as drawn

    good = examples.select("qid", F.explode("positives").alias("doc_id")).distinct().withColumn("positive", F.lit(True))
    bad = drawn(examples.select("qid", "negatives"), negatives, seed).withColumn("positive", F.lit(False))
    pairs = good.unionByName(bad.join(good.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti"))
    return pairs.join(queries.select("qid", F.col("text").alias("query")), "qid").join(passages.select("doc_id", "text"), "doc_id").select("qid", "query", "doc_id", "text", "positive")


def lsh_search(queries: DataFrame, vectors: DataFrame, k: int, distance: float = 1.6, bucket: float = 1.0, tables: int = 8, seed: int = 1) -> DataFrame:
    """(qid, rank, doc_id, score): approximate neighbours by random-projection hashing; score is the negative distance."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    as_vector = array_to_vector(F.transform("vector", lambda x: x.cast("double"))).alias("features")
    docs, qs = vectors.select("doc_id", as_vector), queries.select("qid", as_vector)
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=seed).fit(docs)
    near = model.approxSimilarityJoin(qs, docs, distance, "d").select(F.col("datasetA.qid").alias("qid"), F.col("datasetB.doc_id").alias("doc_id"), (-F.round("d", 6)).alias("score"))
    return top_k(near.distinct(), ["qid"], "score", "doc_id", k)


class StageTimes:
    """Wall-clock seconds per named stage, and their mean per query."""

    def __init__(self) -> None:
        self.seconds: dict[str, float] = {}

    @contextmanager
    def stage(self, name: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began

    def per_query(self, spark: SparkSession, n_queries: int) -> DataFrame:
        rows = [(name, s, 1000.0 * s / max(n_queries, 1)) for name, s in self.seconds.items()]
        return spark.createDataFrame(rows, "stage string, seconds double, ms_per_query double")
