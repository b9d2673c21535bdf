"""Deterministic samples and restrictions to id lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fusemill.operators.ranking import running_total


def sample_ids(ids: DataFrame, key: str, ratio: float) -> DataFrame:
    """int(count * ratio) ids in the order of their md5 digests: the same ones in any engine and at any partitioning.

    ``orderBy().limit()`` keeps only each task's first rows. Repeated and null ids count once and not at all.
    """
    one = ids.select(key).filter(F.col(key).isNotNull()).distinct()
    return one.orderBy(F.md5(F.col(key).cast("string")), key).limit(int(one.count() * ratio))


def sample_corpus(ids: DataFrame, judged: DataFrame, key: str, ratio: float) -> DataFrame:
    """The sample and all judged documents, without repeats."""
    return sample_ids(ids, key, ratio).union(judged.select(key).filter(F.col(key).isNotNull())).distinct()


def restrict(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def shard(df: DataFrame, key: str, shards: int, number: int) -> DataFrame:
    """One of ``shards`` disjoint slices that together are the whole table."""
    return df.filter(F.pmod(key, F.lit(shards)) == number)


def range_shards(ids: DataFrame, key: str, shards: int, start_shard: int = 0) -> DataFrame:
    """Add ``shard``: rows in the order of ``key`` in slices of floor(n / shards), the last one with the rest; shards before ``start_shard`` are left out.

    Rows are numbered by range-partitioned running totals; ``key`` is unique. Fewer rows than shards: all are in the last shard.
    """
    n = ids.count()
    size = n // shards
    numbered = running_total(ids.withColumn("_g", F.lit(0)), ["_g"], key, F.lit(1), "_n").drop("_g")
    place = F.least(F.floor((F.col("_n") - 1) / F.lit(size)), F.lit(shards - 1)) if size else F.lit(shards - 1)
    return numbered.withColumn("shard", place.cast("long")).drop("_n").filter(F.col("shard") >= start_shard)


def negatives(examples: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(qid, doc_id): at most n negatives per query without replacement, in the order of seeded md5 digests; examples (qid, negatives array)."""
    each = examples.select("qid", F.explode("negatives").alias("doc_id")).distinct()
    w = Window.partitionBy("qid").orderBy(F.md5(F.concat_ws("-", "qid", "doc_id", F.lit(str(seed)))), "doc_id")
    return each.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def upsert(base: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Rows of ``fresh`` replace rows of ``base`` with the same key; ``fresh`` must name each key once."""
    return base.join(fresh.select(key), key, "left_anti").unionByName(fresh)
