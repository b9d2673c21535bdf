"""Exact search of packed shards of postings: every block of queries walks all shards and keeps its first k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusemill.runtime import written
from fusemill.sources.binary import opened

#: Postings of one shard, about; a document is never divided.
SHARD_POSTINGS = 2_000_000
#: Query terms of one block, about.
BLOCK_TERMS = 25_000
#: Documents whose scores are looked at as one when a first lower bound is sought.
_STRIDE = 64
_FIELDS = ("docs", "terms", "starts", "places", "weights")


def packed(coded: DataFrame) -> DataFrame:
    """(docs, terms, starts, places, weights), all binary: shards of (term_id, doc_id, weight) bigint, bigint, double.

    All postings of a document are in one shard. Repeats of a posting are added up. No postings give no shards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush(parts: list[tuple]) -> pa.RecordBatch:
            term, doc, weight = (np.concatenate(x) for x in zip(*parts))
            docs, place = np.unique(doc, return_inverse=True)
            order = np.lexsort((place, term))
            term, place, weight = term[order], place[order].astype(np.int32), weight[order]
            first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (place[1:] != place[:-1])]))
            term, place, weight = term[first], place[first], np.add.reduceat(weight, first)
            terms, starts = np.unique(term, return_index=True)
            arrays = (docs, terms, np.append(starts, len(term)).astype(np.int64), place, weight)
            return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in arrays], names=list(_FIELDS))

        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = tuple(np.asarray(c) for c in batch.columns)
            cut = 0
            if size + len(part[1]) >= SHARD_POSTINGS:  # the rows are sorted by document: cut where the last one of the batch begins
                cut = int(np.searchsorted(part[1], part[1][-1]))
            if cut:
                held.append(tuple(x[:cut] for x in part))
                yield flush(held)
                held, size = [], 0
            held.append(tuple(x[cut:] for x in part))
            size += len(part[1]) - cut
        if held:
            yield flush(held)

    return coded.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(run, ", ".join(f"{f} binary" for f in _FIELDS))


def posted_terms(shards: DataFrame) -> DataFrame:
    """(term_id): the terms that any shard has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row.as_py(), np.int64))], names=["term_id"])

    return shards.select("terms").mapInArrow(run, "term_id bigint").distinct()


def _read(path: str) -> Iterator[tuple[np.ndarray, ...]]:
    """The arrays of one shard after the other."""
    from pyarrow import fs, parquet

    store, folder = opened(path)
    for info in sorted(store.get_file_info(fs.FileSelector(folder)), key=lambda x: x.path):
        if info.is_file and info.path.endswith(".parquet"):
            with store.open_input_file(info.path) as f:
                for batch in parquet.ParquetFile(f).iter_batches(batch_size=1, columns=list(_FIELDS)):
                    for row in range(batch.num_rows):
                        yield tuple(np.frombuffer(batch.column(name)[row].as_buffer(), dtype) for name, dtype in zip(_FIELDS, (np.int64, np.int64, np.int64, np.int32, np.float64)))


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Halves go away from zero, as in SQL."""
    y = x * 10.0**digits
    whole = np.trunc(y)
    return (whole + np.sign(y) * (np.abs(y - whole) >= 0.5)) / 10.0**digits


class _Block:
    """Distinct queries (term numbers and weights end to end, ``starts`` of each) and the first k documents of each so far."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray, starts: np.ndarray, k: int, threshold: float, digits: int):
        self.terms, self.weights, self.starts = terms, weights, starts
        self.k, self.threshold, self.digits, self.unit = k, threshold, digits, 10.0**-digits
        self.scores = [np.empty(0)] * (len(starts) - 1)
        self.docs = [np.empty(0, np.int64)] * (len(starts) - 1)
        # a sum below this is not above the threshold when it is rounded
        self.least = (np.floor(threshold / self.unit) + 1) * self.unit - 0.75 * self.unit
        self.floor = np.full(len(starts) - 1, self.least)

    def walk(self, docs: np.ndarray, terms: np.ndarray, starts: np.ndarray, places: np.ndarray, weights: np.ndarray) -> None:
        """Take in one shard. A query whose greatest possible sum here is below its k-th score so far is passed over."""
        if not len(self.terms):
            return
        slot = np.minimum(np.searchsorted(terms, self.terms), len(terms) - 1)
        here = terms[slot] == self.terms
        high, low = np.maximum.reduceat(weights, starts[:-1])[slot], np.minimum.reduceat(weights, starts[:-1])[slot]
        most = np.where(here, np.maximum(0.0, np.maximum(self.weights * high, self.weights * low)), 0.0)
        most = np.add.reduceat(most, self.starts[:-1])
        wide = -(-len(docs) // _STRIDE) * _STRIDE
        total = np.zeros(wide)
        begin, end = starts[slot].tolist(), starts[slot + 1].tolist()
        here, factor, first = here.tolist(), self.weights.tolist(), self.starts.tolist()
        dense: dict[int, np.ndarray] = {}
        for q in np.flatnonzero(most >= self.floor - self.unit).tolist():
            used = [j for j in range(first[q], first[q + 1]) if here[j]]
            if not used:
                continue
            total.fill(0.0)
            for j in used:
                a, b = begin[j], end[j]
                if 4 * (b - a) < wide:
                    total[places[a:b]] += factor[j] * weights[a:b]
                    continue
                row = dense.get(a)
                if row is None:
                    row = dense[a] = np.zeros(wide)
                    row[places[a:b]] = weights[a:b]
                total += row if factor[j] == 1.0 else factor[j] * row
            self.take(q, total, docs)

    def take(self, q: int, total: np.ndarray, docs: np.ndarray) -> None:
        bound = self.floor[q]
        if len(self.scores[q]) < self.k <= len(total) // _STRIDE:
            peaks = total.reshape(_STRIDE, -1).max(axis=0)  # of sets without a common document, so k of them have k documents
            bound = max(bound, np.partition(peaks, len(peaks) - self.k)[len(peaks) - self.k] - self.unit)
        at = np.flatnonzero(total >= bound)
        if not len(at):
            return
        score = _rounded(total[at], self.digits)
        kept = score > self.threshold
        score, doc = np.concatenate([self.scores[q], score[kept]]), np.concatenate([self.docs[q], docs[at[kept]]])
        order = np.lexsort((doc, -score))[: self.k]
        self.scores[q], self.docs[q] = score[order], doc[order]
        if len(order) == self.k:
            self.floor[q] = max(self.least, self.scores[q][-1] - self.unit)


def top_documents(queries: DataFrame, shards: DataFrame, k: int, threshold: float, digits: int, doc_type: str) -> DataFrame:
    """(qid, doc_id, rank, score) of (qid, terms array<bigint>, weights array<double>) over written shards.

    Queries of the same terms and weights should be in one partition: they are searched for once.
    """
    path = shards._written_path
    arrow = {"bigint": pa.int64(), "int": pa.int32()}[doc_type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [b for b in batches if b.num_rows]
        if not asked:
            return
        table = pa.Table.from_batches(asked).combine_chunks()
        qids = table.column(0).combine_chunks()
        lists = [table.column(i).combine_chunks() for i in (1, 2)]
        terms, weights = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
        ends = np.cumsum(lists[0].value_lengths().to_numpy(zero_copy_only=False))
        known: dict[bytes, int] = {}
        rows: list[list[int]] = []
        spans: list[tuple[int, int]] = []
        for i, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
            key = terms[a:b].tobytes() + weights[a:b].tobytes()
            if (n := known.setdefault(key, len(rows))) == len(rows):
                rows.append([])
                spans.append((a, b))
            rows[n].append(i)
        starts = np.cumsum([0, *(b - a for a, b in spans)])
        block = _Block(np.concatenate([terms[a:b] for a, b in spans]), np.concatenate([weights[a:b] for a, b in spans]), starts, k, threshold, digits)
        for shard in _read(path):
            block.walk(*shard)
        out: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            place, doc, rank, score = (np.concatenate(x) for x in zip(*out))
            return pa.RecordBatch.from_arrays([qids.take(pa.array(place)), pa.array(doc).cast(arrow), pa.array(rank), pa.array(score)], names=["qid", "doc_id", "rank", "score"])

        for q, places in enumerate(rows):
            n = len(block.docs[q])
            for i in places if n else ():
                out.append((np.full(n, i), block.docs[q], np.arange(1, n + 1), block.scores[q]))
                size += n
                if size >= 100_000:
                    yield batch()
                    out, size = [], 0
        if out:
            yield batch()

    return queries.mapInArrow(run, f"qid {dict(queries.dtypes)['qid']}, doc_id {doc_type}, rank bigint, score double")


def search(queries: DataFrame, post: DataFrame, k: int, threshold: float, digits: int, most_broadcast: int) -> DataFrame:
    """(qid, doc_id, rank, score) of queries (qid, term, weight) and postings (term, doc_id, weight); see ``sparse.search``."""
    q = written(queries.select("qid", "term", F.col("weight").cast("double").alias("weight")).filter("term is not null and weight is not null"), "query_terms")
    named = written(q.select("term").distinct().withColumn("term_id", F.monotonically_increasing_id()), "query_words")
    hint = F.broadcast if named.count() <= most_broadcast else (lambda df: df)
    coded = post.filter("weight is not null and doc_id is not null").join(hint(named), "term").select("term_id", F.col("doc_id").cast("bigint").alias("doc_id"), F.col("weight").cast("double").alias("weight"))
    shards = written(packed(coded), "shards")
    used = named.join(hint(posted_terms(shards)), "term_id")
    pairs = F.sort_array(F.collect_list(F.struct("term_id", "weight")))
    each = q.join(hint(used), "term").groupBy("qid").agg(pairs.alias("p")).select("qid", F.col("p.term_id").alias("terms"), F.col("p.weight").alias("weights"))
    blocks = max(2 * q.sparkSession.sparkContext.defaultParallelism, -(-q.count() // BLOCK_TERMS))
    return top_documents(each.repartition(blocks, "terms", "weights"), shards, k, threshold, digits, dict(post.dtypes)["doc_id"])
