"""Order statistics that never put one group into one task."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fusemill.runtime import written


def top_k(df: DataFrame, group: list[str], score: str, tie: str, k: int, rank: str = "rank") -> DataFrame:
    """The one deterministic top-k: score descending, ``tie`` ascending; null scores are left out.

    ``row_number() <= k`` makes Catalyst place a WindowGroupLimit before the shuffle, so each task sends
    at most k rows of a group. Empty input gives an empty result; ties are broken by ``tie``.
    """
    w = Window.partitionBy(*group).orderBy(F.col(score).desc(), F.col(tie).asc())
    ranked = df.filter(F.col(score).isNotNull()).withColumn(rank, F.row_number().over(w))
    return ranked.filter(F.col(rank) <= k).withColumn(rank, F.col(rank).cast("long"))


def running_total(df: DataFrame, group: list[str], order: str, weight: Column, out: str) -> DataFrame:
    """Add ``out``: the sum of ``weight`` over the rows of the same group that sort at or before this row.

    The rows are range-partitioned by (group, order); each (group, partition) block sums on its own and a small
    table of block totals gives the offsets, so a group of any size is spread over many tasks. ``order`` must
    be unique in its group. Null groups form one group; empty input gives an empty result.
    """
    block, amount, before = (f"_{x}_{uuid.uuid4().hex[:6]}" for x in ("block", "amount", "before"))
    spread = df.withColumn(amount, weight).repartitionByRange(*[F.col(c) for c in group], F.col(order)).withColumn(block, F.spark_partition_id())
    spread = written(spread, "running")
    totals = spread.groupBy(*group, block).agg(F.sum(amount).alias(before))
    ahead = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn(before, F.coalesce(F.sum(before).over(ahead), F.lit(0)))
    here = Window.partitionBy(*group, block).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = spread.withColumn(out, F.sum(amount).over(here)).alias("l")
    keys = [F.col(f"l.{c}").eqNullSafe(F.col(f"t.{c}")) for c in [*group, block]]
    on = keys[0]
    for k in keys[1:]:
        on = on & k
    return local.join(totals.alias("t"), on).select(*[F.col(f"l.{c}") for c in df.columns], (F.col(f"l.{out}") + F.col(f"t.{before}")).alias(out))
