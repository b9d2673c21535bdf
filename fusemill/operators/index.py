"""Term statistics and postings as columnar tables keyed by external document ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fusemill.functions.scoring import B, DELTA, K1, term_weight
from fusemill.operators.ranking import running_total
from fusemill.runtime import written

#: Terms that are broadcast, at most.
BROADCAST_TERMS = 500_000
#: Postings of one array of a packed index, at most.
CHUNK = 100_000


def tokens(df: DataFrame, key: str, analysed: Column) -> DataFrame:
    """(doc_id, dl, tokens) of every row with a key; an empty document keeps its row with dl 0."""
    return df.filter(F.col(key).isNotNull()).select(F.col(key).alias("doc_id"), analysed.alias("tokens")).select("doc_id", F.size("tokens").alias("dl"), "tokens")


def term_frequencies(tok: DataFrame) -> DataFrame:
    """(doc_id, dl, term, tf). All tokens of a document are in one task, so the map-side combine already counts them."""
    return tok.select("doc_id", "dl", F.explode("tokens").alias("term")).groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))


def document_frequencies(tf: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """(term, df); with a vocabulary (term) only its terms, those without a document with df 0."""
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    if vocabulary is None:
        return df
    return vocabulary.select("term").distinct().join(df, "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"))


def corpus_stats(tok: DataFrame, average: float | None = None) -> DataFrame:
    """One row (n_docs, avgdl): empty documents count in both; ``average`` pins the mean length."""
    mean = F.avg("dl") if average is None else F.lit(average)
    return tok.agg(F.count("*").alias("n_docs"), mean.alias("avgdl"))


def postings(tok: DataFrame, tf: DataFrame, method: str = "lucene", k1: float = K1, b: float = B, delta: float = DELTA, average: float | None = None, allow_negative: bool = False) -> DataFrame:
    """(term, doc_id, weight): precomputed weights, so that a query only adds up. The statistics are one broadcast row."""
    weight = term_weight(method, F.col("tf"), F.col("df"), F.col("dl"), F.col("n_docs"), F.col("avgdl"), k1, b, delta, allow_negative)
    return tf.join(document_frequencies(tf), "term").crossJoin(F.broadcast(corpus_stats(tok, average))).select("term", "doc_id", weight.alias("weight"))


def wanted_postings(tok: DataFrame, wanted: DataFrame, method: str = "lucene", average: float | None = None, frequencies: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
    """:func:`postings` of the terms of ``wanted`` (term) alone; frequencies and statistics are those of the whole ``tok``, or given.

    Only words that are wanted are shuffled, once and by document.
    """
    df = wanted_frequencies(tok, wanted) if frequencies is None else frequencies
    words = tok.select("doc_id", "dl", F.explode("tokens").alias("term")).join(_small(df), "term").repartition("doc_id")
    tf = words.groupBy("doc_id", "dl", "term", "df").agg(F.count("*").alias("tf"))
    weight = term_weight(method, F.col("tf"), F.col("df"), F.col("dl"), F.col("n_docs"), F.col("avgdl"))
    return tf.crossJoin(F.broadcast(corpus_stats(tok, average) if stats is None else stats)).select("term", "doc_id", weight.alias("weight"))


def wanted_frequencies(tok: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, df), written, of the terms of ``wanted`` that stand in a document."""
    words = written(wanted.select("term").distinct(), "wanted")
    return written(tok.select(F.explode(F.array_distinct("tokens")).alias("term")).join(_small(words), "term").groupBy("term").agg(F.count("*").alias("df")), "frequencies")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a written table of terms if a count allows it."""
    return F.broadcast(df) if df.count() <= BROADCAST_TERMS else df


def posting_lengths(post: DataFrame) -> DataFrame:
    """(term, length)."""
    return post.groupBy("term").agg(F.count("*").alias("length"))


def stop_terms(post: DataFrame, n_docs: DataFrame, ratio: float) -> DataFrame:
    """Terms of more than ``ratio`` of the documents (strictly); ``n_docs`` is one row."""
    return posting_lengths(post).crossJoin(F.broadcast(n_docs.select("n_docs"))).filter(F.col("length") > F.col("n_docs") * F.lit(ratio)).select("term")


def without_terms(post: DataFrame, terms: DataFrame) -> DataFrame:
    return post.join(terms.select("term").distinct(), "term", "left_anti")


def with_terms(post: DataFrame, terms: DataFrame) -> DataFrame:
    """Posting fetch: only the wanted terms; missing ones are silently absent."""
    return post.join(terms.select("term").distinct(), "term", "left_semi")


def term_ids(tf: DataFrame) -> DataFrame:
    """(term, term_id): ordinals from 0 in the byte order of the terms, numbered by range-partitioned running totals."""
    one = tf.select("term").distinct().withColumn("_g", F.lit(0))
    return running_total(one, ["_g"], "term", F.lit(1), "n").select("term", (F.col("n") - 1).cast("long").alias("term_id"))


def ignoring_low_ids(tf: DataFrame, ids: DataFrame, first: int = 173) -> DataFrame:
    """Drop terms whose id is below ``first``."""
    return tf.join(ids.filter(F.col("term_id") >= first), "term")


def merged(*indexes: DataFrame) -> DataFrame:
    """Union of index shards; external ids need no offsets."""
    out = indexes[0]
    for i in indexes[1:]:
        out = out.unionByName(i)
    return out


def save(post: DataFrame, path: str, partitions: int | None = None) -> None:
    """Postings clustered by term and sorted by document, so that row-group statistics prune to the wanted terms."""
    ranged = post.repartitionByRange(partitions, "term") if partitions else post.repartitionByRange("term")
    ranged.sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """(term, doc_id, weight) of a saved index, for any number of searches."""
    return spark.read.schema("term string, doc_id bigint, weight double").parquet(path)


def packed(post: DataFrame, key: str = "term", chunk: int = CHUNK) -> DataFrame:
    """(term, chunk, postings array<struct<doc_id, weight>>) sorted by document; for interchange, not for search.

    No array holds more than ``chunk`` postings: those of a frequent term are numbered by range-partitioned running totals and cut
    into chunks, so a term that stands in every document is nowhere collected whole.
    """
    numbered = running_total(post.select(key, "doc_id", "weight"), [key], "doc_id", F.lit(1), "_n").withColumn("chunk", F.floor((F.col("_n") - 1) / F.lit(chunk)).cast("long"))
    return numbered.groupBy(key, "chunk").agg(F.array_sort(F.collect_list(F.struct("doc_id", "weight"))).alias("postings"))
