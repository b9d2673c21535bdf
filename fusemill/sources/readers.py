"""Readers and writers of the file formats around the engine; every schema is declared, none inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPARSE_QUERY = T.StructType([T.StructField("text_id", T.LongType()), T.StructField("text", T.ArrayType(T.LongType())), T.StructField("value", T.ArrayType(T.DoubleType()))])
CORPUS_FIELDS = ("url", "language", "doc_id", "title", "body")
TOKENS = "doc_id bigint, url array<string>, title array<string>, body array<string>"


def corpus_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(url, language, doc_id, title, body) strings of tab-separated lines; blank lines and lines without exactly 5 fields are dropped."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parts = lines.select(F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), "\t").alias("p")).filter(F.size("p") == len(CORPUS_FIELDS))
    return parts.select(*[F.col("p")[i].alias(n) for i, n in enumerate(CORPUS_FIELDS)])


def line_counts(spark: SparkSession, path: str) -> DataFrame:
    """(file, n_lines) of every part file; blank lines count."""
    return spark.read.text(path).groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n_lines"))


def query_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(qid, text, lang); quotes and backslashes are ordinary characters."""
    parts = spark.read.text(path).select(F.split("value", "\t").alias("p"))
    return parts.select(F.get("p", F.lit(0)).cast("long").alias("qid"), F.get("p", F.lit(1)).alias("text"), F.get("p", F.lit(2)).alias("lang"))


def sparse_queries(spark: SparkSession, path: str) -> DataFrame:
    """(text_id, text array<bigint>, value array<double>) of JSON lines; an absent value is null and means weight 1 everywhere."""
    return spark.read.schema(SPARSE_QUERY).json(path)


def json_files(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All ``.json`` and ``.jsonl`` files of a folder, or the one file named; other files of the folder are not read."""
    if folder.endswith((".json", ".jsonl")):
        return spark.read.schema(schema).json(folder)
    return spark.read.schema(schema).option("pathGlobFilter", "*.{json,jsonl}").json(folder)


def qrels_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(qid, doc_id) of the first and third column; lines that do not parse are an error when read."""
    rows = spark.read.csv(path, sep="\t", schema="qid string, ignored string, pid string, relevance string")
    return rows.select(F.col("qid").cast("bigint").alias("qid"), F.col("pid").cast("bigint").alias("doc_id"))


def qrels_grouped(qrels: DataFrame) -> DataFrame:
    """(qid, pids) with the pids sorted, repeats kept once."""
    return qrels.groupBy("qid").agg(F.sort_array(F.collect_set("doc_id")).alias("pids"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line bigint, value): the lines of one text file, numbered from 0 by the offsets of its splits.

    Each split counts its own lines; a table with one row per split tells how many lines lie before it.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("_id"))
    counts = raw.groupBy("split").agg(F.count("*").alias("n"), F.min("_id").alias("first"))
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the ids of a split follow each other, for a split is never divided and its lines keep their order
    offsets = counts.select("split", "first", ahead.alias("ahead"))
    return raw.join(offsets, "split").select((F.col("_id") - F.col("first") + F.col("ahead")).alias("line"), "value")


def cluster_file(spark: SparkSession, path: str) -> DataFrame:
    """(cluster_id, doc_id): line i of the text file is cluster i, its documents separated by commas; an empty line is an empty cluster."""
    ids = numbered_lines(spark, path).select(F.col("line").alias("cluster_id"), F.explode(F.split("value", ",")).alias("doc"))
    return ids.select("cluster_id", F.trim("doc").alias("doc")).filter("doc <> ''").select("cluster_id", F.col("doc").cast("bigint").alias("doc_id"))


def id_map_json(spark: SparkSession, path: str) -> DataFrame:
    """(row_idx, doc_id) of one JSON object that maps ordinals, as strings, to ids.

    The file is split at its commas, which no key or value holds, so one line of any length is read by many tasks.
    """
    pair = r'"\s*(-?[0-9]+)\s*"\s*:\s*"?(-?[0-9]+)'
    pieces = spark.read.option("lineSep", ",").text(path).filter(F.col("value").rlike(pair))
    return pieces.select(F.regexp_extract("value", pair, 1).cast("bigint").alias("row_idx"), F.regexp_extract("value", pair, 2).cast("bigint").alias("doc_id"))


def embedding_pieces(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(doc_id, vector) of several Parquet pieces as one table."""
    return spark.read.schema("doc_id bigint, vector array<float>").parquet(*paths)


def write_embeddings(vectors: DataFrame, path: str) -> None:
    """A piece of (doc_id, vector), sorted by id."""
    vectors.select("doc_id", "vector").sortWithinPartitions("doc_id").write.mode("overwrite").parquet(path)


def training_examples_dir(spark: SparkSession, folder: str) -> DataFrame:
    """(qid, positives, negatives) of all example files of a folder."""
    return spark.read.schema("qid bigint, positives array<bigint>, negatives array<bigint>").option("pathGlobFilter", "*.parquet").parquet(folder)


def write_tokens(tokens: DataFrame, path: str) -> None:
    """The tokenised corpus: (doc_id, url, title, body) token arrays, clustered by id for lookups."""
    tokens.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.mode("overwrite").parquet(path)


def tokens_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TOKENS).parquet(path)


def write_sparse_queries(weights: DataFrame, path: str) -> None:
    """JSON lines of (qid, term_id, weight), heaviest terms first."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col("weight").alias("w"), F.col("term_id").alias("t"))), asc=False)
    rows = weights.groupBy(F.col("qid").alias("text_id")).agg(pairs.alias("p"))
    rows.select("text_id", F.transform("p", lambda x: x["t"]).alias("text"), F.transform("p", lambda x: x["w"]).alias("value")).write.mode("overwrite").json(path)


def write_ranking(ranking: DataFrame, path: str) -> None:
    """(qid, rank, doc_id, score) clustered by query."""
    ranking.repartition("qid").sortWithinPartitions("qid", "rank").write.mode("overwrite").parquet(path)


def ranking_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("qid bigint, rank bigint, doc_id bigint, score double").parquet(path)
