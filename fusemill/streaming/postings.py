"""Incremental index maintenance: new documents of a watched folder are appended to the term-frequency table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fusemill.operators import index


def append_term_frequencies(spark: SparkSession, source: str, schema: str, key: str, analysed: Column, target: str, checkpoint: str):
    """A streaming query that tokenises every new Parquet file of ``source`` and appends (doc_id, dl, term, tf, batch) to ``target``.

    Each micro-batch writes its own ``batch=<id>`` folder in overwrite mode, so a batch repeated after a failure
    replaces itself. Weights depend on corpus statistics and are derived from the whole table by
    :func:`current_postings`, not frozen at arrival.
    """

    def store(batch: DataFrame, number: int) -> None:
        tf = index.term_frequencies(index.tokens(batch, key, analysed))
        lengths = index.tokens(batch, key, analysed).select("doc_id", "dl")
        tf.write.mode("overwrite").parquet(f"{target}/tf/batch={number}")
        lengths.write.mode("overwrite").parquet(f"{target}/lengths/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_postings(spark: SparkSession, target: str, method: str = "lucene") -> DataFrame:
    """Postings over everything that has arrived; a document that came again counts with its latest batch."""
    tf, lengths = spark.read.parquet(f"{target}/tf"), spark.read.parquet(f"{target}/lengths")
    latest = lengths.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    tok = lengths.join(latest, ["doc_id", "batch"]).select("doc_id", "dl")
    return index.postings(tok, tf.join(latest, ["doc_id", "batch"]).select("doc_id", "dl", "term", "tf"), method)
