"""One ranking from several differently scaled scores, by leximin order of percentiles (problem 2)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fusemill.operators.ranking import running_total
from fusemill.runtime import table, written

#: Sorted scores counted at once inside a task.
PIECE = 400_000
#: Edges of pieces (two per piece) that are broadcast, at most; more are joined by a shuffle.
BROADCAST_EDGES = 200_000


def _counted(rows: DataFrame, kinds: int) -> DataFrame:
    """Counts of values at or below each row's, from rows sorted by (g, which, value).

    A run of one (g, which) that lies inside a piece is final: ``upto`` of ``total``. Of the first and last run of a piece, ``piece`` is
    set and both count this piece only; an extra row per such run (i null) has what its neighbours need: ``first``, ``n_first``, ``last``.
    Kinds from ``kinds`` on stand for missing scores, whose counts mean nothing.
    """
    group_type, item_type = rows.schema["g"].dataType.simpleString(), rows.schema["i"].dataType.simpleString()

    def piece_rows(whole: pa.Table, piece: int) -> Iterator[pa.RecordBatch]:
        g, which, value = whole.column("g").combine_chunks(), np.asarray(whole.column("which")), np.asarray(whole.column("value"))
        n = len(which)
        fresh = np.ones(n, bool)
        if n > 1:
            fresh[1:] = pc.not_equal(g[1:], g[:-1]).to_numpy(zero_copy_only=False) | (which[1:] != which[:-1])
        starts = np.flatnonzero(fresh)
        run = np.cumsum(fresh) - 1
        sizes = np.diff(np.append(starts, n))
        other = fresh.copy()
        other[1:] |= value[1:] != value[:-1]
        ends = np.append(np.flatnonzero(other)[1:], n)
        upto = ends[np.cumsum(other) - 1] - starts[run]
        outer = (run == 0) | (run == len(starts) - 1)
        numbers = lambda x, null=None: pa.array(x, pa.int64(), mask=null)
        yield pa.RecordBatch.from_arrays(
            [g, whole.column("i").combine_chunks(), pa.array(which % kinds, pa.int32()), whole.column("weight").combine_chunks(), pa.array(which >= kinds), pa.array(value), numbers(upto), numbers(sizes[run]), numbers(np.full(n, piece), ~outer), pa.nulls(n, pa.float64()), numbers(np.zeros(n, np.int64)), pa.nulls(n, pa.float64())],
            names=names,
        )
        at = np.unique([0, len(starts) - 1])
        head, tail = starts[at], starts[at] + sizes[at] - 1
        k = len(at)
        yield pa.RecordBatch.from_arrays(
            [g.take(pa.array(head)), pa.nulls(k, whole.schema.field("i").type), pa.array(which[head] % kinds, pa.int32()), pa.nulls(k, pa.float64()), pa.array(which[head] >= kinds), pa.nulls(k, pa.float64()), numbers(np.zeros(k, np.int64)), numbers(sizes[at]), numbers(np.full(k, piece)), pa.array(value[head]), numbers(upto[head]), pa.array(value[tail])],
            names=names,
        )

    names = ["g", "i", "which", "weight", "missing", "value", "upto", "total", "piece", "first", "n_first", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        held, number = 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                held += batch.num_rows
            if held >= PIECE:
                yield from piece_rows(pa.Table.from_batches(waiting), number)
                waiting, held, number = [], 0, number + 1
        if held:
            yield from piece_rows(pa.Table.from_batches(waiting), number)

    schema = f"g {group_type}, i {item_type}, which int, weight double, missing boolean, value double, upto bigint, total bigint, piece bigint, first double, n_first bigint, last double"
    return rows.mapInArrow(run, schema)


def percentiles(base: DataFrame, group: str, item: str, scores: list[str], weights: list[str]) -> DataFrame:
    """(group, item, which, weight, percentile): the share of the group's given scores at or below the item's score; 0 for a missing one.

    A score's scale and spread play no part. All scores are range-partitioned once by (group, kind, value, item), so neither a group nor
    a value that many items share is sorted in one task; each piece counts on its own, and the edges of the pieces, two
    rows each, tell how many values lie before it and how far its last value goes on.
    """
    kinds = len(scores)
    each = [F.struct(F.lit(k).alias("kind"), (F.col(s).cast("double") + F.lit(0.0)).alias("value"), F.col(w).alias("weight")) for k, (s, w) in enumerate(zip(scores, weights))]
    long = base.select(F.col(group).alias("g"), F.col(item).alias("i"), F.explode(F.array(*each)).alias("x"))
    given = F.col("x.value").isNotNull()
    long = long.select("g", "i", F.when(given, F.col("x.kind")).otherwise(F.col("x.kind") + kinds).alias("which"), F.coalesce("x.value", F.lit(0.0)).alias("value"), "x.weight")
    counted = written(_counted(long.repartitionByRange("g", "which", "value", "i").sortWithinPartitions("g", "which", "value"), kinds), "percentiles")
    edges = counted.filter("i is null")
    run = Window.partitionBy("g", "which", "missing")
    onward = F.sum("n_first").over(run.partitionBy("g", "which", "missing", "first").orderBy(F.desc("piece")))
    edges = edges.withColumn("onward", onward).select(
        "g", "which", "missing", "piece",
        F.coalesce(F.sum("total").over(run.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"),
        F.sum("total").over(run).alias("whole"),
        "last",
        F.when(F.lead("first").over(run.orderBy("piece")) == F.col("last"), F.lead("onward").over(run.orderBy("piece"))).otherwise(0).alias("ties"),
    )
    edges = written(edges, "edges")
    side = F.broadcast(edges) if edges.limit(BROADCAST_EDGES + 1).count() <= BROADCAST_EDGES else edges
    rows = counted.filter("i is not null").alias("c").join(side.alias("e"), ["g", "which", "missing", "piece"], "left")
    upto = F.col("upto") + F.coalesce("ahead", F.lit(0)) + F.when(F.col("value") == F.col("e.last"), F.col("ties")).otherwise(0)
    share = F.when(F.col("missing"), 0.0).otherwise(upto / F.coalesce("whole", "total"))
    return rows.select(F.col("g").alias(group), F.col("i").alias(item), "which", "weight", share.alias("percentile"))


def leximin_vectors(df: DataFrame, group: str, item: str, scores: list[str], weights: dict[str, Column] | None = None) -> DataFrame:
    """(group, item, vector): the item's percentiles as ``1 - w * (1 - p)``, sorted ascending; a missing score has p = 0.

    Comparing these arrays from left to right puts the weakest score first, so no strong score can mask a weak one,
    and a weight above 1 makes a shortfall in its score count more. ``weights`` are columns of ``df`` (null: 1).
    Repeated rows of an item count once with its best score of each kind; null groups or items are left out.
    """
    weights = weights or {}
    names = [f"_w{i}" for i in range(len(scores))]
    best = [F.max(F.when(~F.isnan(F.col(s).cast("double")), F.col(s))).alias(s) for s in scores]
    weight = [F.coalesce(F.max(weights[s]), F.lit(1.0)).cast("double").alias(w) if s in weights else F.lit(1.0).alias(w) for s, w in zip(scores, names)]
    base = df.filter(F.col(group).isNotNull() & F.col(item).isNotNull()).groupBy(group, item).agg(*best, *weight)
    short = F.round(F.lit(1.0) - F.col("weight") * (F.lit(1.0) - F.col("percentile")), 9)
    each = percentiles(base, group, item, scores, names).withColumn("short", short)
    kept = [F.max(F.when(F.col("which") == i, F.col("short"))) for i in range(len(scores))]
    return each.groupBy(group, item).agg(F.array_sort(F.array(*kept)).alias("vector"))


def leximin_rank(vectors: DataFrame, group: str, item: str, most: int | None = None) -> DataFrame:
    """Add ``rank`` bigint: vectors compared lexicographically, greatest first, ties by ascending item.

    With ``most`` only the first ranks come out, limited before the shuffle. Without it every row gets its rank by
    range-partitioned running totals, whatever the size of a group.
    """
    if most is not None:
        w = Window.partitionBy(group).orderBy(F.col("vector").desc(), F.col(item).asc())
        return vectors.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).withColumn("rank", F.col("rank").cast("long"))
    ordered = vectors.withColumn("_o", F.struct(F.transform("vector", lambda x: -x).alias("v"), F.col(item).alias("i")))
    return running_total(ordered, [group], "_o", F.lit(1), "rank").drop("_o")


def _pool_vectors(spark, folder: str) -> DataFrame:
    config = table(spark, folder, "run_config").select("run_id", "sparse_weight", "dense_weight")
    pools = table(spark, folder, "hybrid_pools").join(config, "run_id", "left")
    return leximin_vectors(pools, "qid", "doc_id", ["sparse_score", "dense_score", "term_score"], {"sparse_score": F.col("sparse_weight"), "dense_score": F.col("dense_weight")})


def p2_found(spark, folder: str) -> DataFrame:
    return leximin_rank(_pool_vectors(spark, folder), "qid", "doc_id", 1).select("qid", "doc_id")


def p2_ranked(spark, folder: str) -> DataFrame:
    return leximin_rank(_pool_vectors(spark, folder), "qid", "doc_id").select("qid", "doc_id", "rank")


_LEXIMIN = """
with base as (select qid, doc_id, max(sparse_score) as s, max(dense_score) as d, max(term_score) as t,
    coalesce(max(c.sparse_weight), 1) as ws, coalesce(max(c.dense_weight), 1) as wd
  from hybrid_pools p left join run_config c on c.run_id = p.run_id where qid is not null and doc_id is not null group by 1, 2),
pct as (select qid, doc_id,
    case when s is null then 0 else (rank() over (partition by qid, s is null order by s) - 1 + count(*) over (partition by qid, s)) / (count(s) over (partition by qid))::double end as ps, ws,
    case when d is null then 0 else (rank() over (partition by qid, d is null order by d) - 1 + count(*) over (partition by qid, d)) / (count(d) over (partition by qid))::double end as pd, wd,
    case when t is null then 0 else (rank() over (partition by qid, t is null order by t) - 1 + count(*) over (partition by qid, t)) / (count(t) over (partition by qid))::double end as pt
  from base),
vec as (select qid, doc_id, list_sort([round(1 - ws * (1 - ps), 9), round(1 - wd * (1 - pd), 9), round(1 - (1 - pt), 9)]) as v from pct),
ranked as (select qid, doc_id, row_number() over (partition by qid order by v desc, doc_id) as rank from vec)
"""
QUERIES = {"p2_found": p2_found, "p2_ranked": p2_ranked}
ORACLES = {
    "p2_found": _LEXIMIN + "select qid, doc_id from ranked where rank = 1",
    "p2_ranked": _LEXIMIN + "select qid, doc_id, rank from ranked",
}
