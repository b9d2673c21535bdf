"""Sparse search: term join, score accumulation, threshold, term budgets, pooling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusemill.functions.scoring import saturated
from fusemill.operators import shards
from fusemill.operators.ranking import top_k
from fusemill.runtime import written

#: Query terms (qid, term, weight) that are broadcast at once, some 40 MB; a larger set of queries is taken in blocks against all postings.
BLOCK_TERMS = 500_000


def text_queries(df: DataFrame, key: str, analysed) -> DataFrame:
    """(qid, term, weight): every occurrence of a term adds weight 1."""
    return df.filter(F.col(key).isNotNull()).select(F.col(key).alias("qid"), F.explode(analysed).alias("term")).groupBy("qid", "term").agg(F.count("*").cast("double").alias("weight"))


def weighted_queries(df: DataFrame, key: str, terms: str, weights: str) -> DataFrame:
    """(qid, term, weight) from parallel arrays; an absent weight array or entry counts as 1."""
    pairs = F.explode(F.arrays_zip(F.col(terms).alias("t"), F.coalesce(F.col(weights), F.expr(f"transform({terms}, x -> 1.0D)")).alias("w")))
    return df.select(F.col(key).alias("qid"), pairs.alias("p")).filter("p.t is not null").groupBy("qid", F.col("p.t").alias("term")).agg(F.sum(F.coalesce(F.col("p.w"), F.lit(1.0)).cast("double")).alias("weight"))


def match(queries: DataFrame, post: DataFrame, digits: int = 6) -> DataFrame:
    """(qid, doc_id, score): sum of query weight times posting weight over shared terms.

    Postings are partitioned by document and meet a broadcast block of queries, so all scores of a document are added up where
    its postings are: no (query, document) pair is shuffled, and a following top-k sends k rows per query and task. A term
    without postings adds nothing. Empty sides give an empty result.
    """
    q = written(queries.select("qid", "term", F.col("weight").alias("q_weight")), "query_terms")
    blocks = max(1, -(-q.count() // BLOCK_TERMS))
    placed = post.select("term", "doc_id", "weight").repartition("doc_id")
    if blocks > 1:
        placed = written(placed, "placed_postings").repartition("doc_id")
    out = None
    for block in range(blocks):
        part = F.broadcast(q.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block))
        here = placed.join(part, "term").groupBy("qid", "doc_id").agg(F.round(F.sum(F.col("q_weight") * F.col("weight")), digits).alias("score"))
        out = here if out is None else out.unionByName(here)
    return out


def above(scores: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Scores strictly above the threshold."""
    return scores.filter(F.col("score") > threshold)


def search(queries: DataFrame, post: DataFrame, k: int, threshold: float = 0.0, digits: int = 6) -> DataFrame:
    """The first k of ``match`` above the threshold, with ``rank``; equal scores go by document.

    No score of a (query, document) pair leaves a task: the postings of the queries' terms are packed into shards of whole documents in the
    shared folder, and each block of queries adds up its sums shard by shard in memory, keeping k documents. Queries that have the same
    terms in the index are searched for once. A threshold below 0 would let in documents that share no term with the query: then,
    and for ids that are not numbers, all pairs are joined.
    """
    if threshold >= 0 and dict(post.dtypes)["doc_id"] in ("bigint", "int"):
        return shards.search(queries, post, k, threshold, digits, BLOCK_TERMS)
    return top_k(above(match(queries, post, digits), threshold), ["qid"], "score", "doc_id", k)


def merged_top_k(shards: list[DataFrame], k: int) -> DataFrame:
    """Re-selection of the first k over the rankings of several shards."""
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s)
    return top_k(out.drop("rank"), ["qid"], "score", "doc_id", k)


def term_budget(df: DataFrame, key: str, k: int) -> DataFrame:
    """The k heaviest terms of every document or query, ties by term; zero weights drop out."""
    return top_k(df.filter("weight <> 0"), [key], "weight", "term", k)


def pooled(logits: DataFrame, how: str) -> DataFrame:
    """(doc_id, term, weight) from (doc_id, pos, term, logit): saturated logits pooled by sum, max or mean over all positions of the document."""
    kind = {"sum": F.sum, "max": F.max}
    value = saturated(F.col("logit"))
    if how in kind:
        return logits.groupBy("doc_id", "term").agg(kind[how](value).alias("weight"))
    if how != "mean":
        raise ValueError(f"unknown pooling {how!r}; choose from sum, max, mean")
    length = logits.groupBy("doc_id").agg(F.countDistinct("pos").alias("length"))
    return logits.groupBy("doc_id", "term").agg(F.sum(value).alias("total")).join(length, "doc_id").select("doc_id", "term", (F.col("total") / F.col("length")).alias("weight"))


def weighted_terms(df: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Multiply by a per-term weight (term, term_weight); terms without one keep theirs, weight 0 masks a term."""
    return df.join(vocabulary, "term", "left").withColumn("weight", F.col("weight") * F.coalesce("term_weight", F.lit(1.0))).drop("term_weight")


def decoded(df: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """(key, text): term ids with positions back to text."""
    named = df.join(vocabulary, "term_id")
    return named.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]), " ").alias("text"))
