"""Connected components of a link table: union-find inside tasks, large-star / small-star between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusemill.runtime import dropped, written

#: A star join converges in about log2(longest path) rounds; more rounds than this mean a defect.
MOST_ROUNDS = 60
#: Links held by one union-find at a time.
UNION_LINKS = 200_000


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace blocks of links by stars around the least member of each block's components."""
    kind = None

    def flush(parent: dict) -> pa.RecordBatch:
        pairs = [(x, find(parent, x)) for x in parent]
        pairs = [(x, r) for x, r in pairs if x != r]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], kind), pa.array([p[1] for p in pairs], kind)], names=["u", "v"])

    def find(parent: dict, x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    parent: dict = {}
    for batch in batches:
        kind = batch.schema.types[0]
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(parent, parent.setdefault(u, u) and u), find(parent, parent.setdefault(v, v) and v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > UNION_LINKS:
            yield flush(parent)
            parent = {}
    if kind is not None:
        yield flush(parent)


def _least_neighbour(links: DataFrame) -> DataFrame:
    """(u, v, m) with m the least of u and its neighbours; the aggregation is combined map-side, so hubs do no harm."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return links.join(least, "u")


def connected_components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for every node with a link: root is the least node of its component (both columns of one type).

    Every round is written to the shared folder, so neither lineage nor the driver grows. Self links are ignored,
    repeated links count once, no links give no rows.
    """
    pairs = links.select(F.col(left).alias("u"), F.col(right).alias("v")).filter("u is not null and v is not null and u <> v")
    edges = written(pairs.mapInArrow(_stars, pairs.schema).distinct(), "stars")
    state = None
    for _ in range(MOST_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least_neighbour(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = _least_neighbour(down).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        last, edges = edges, written(small.filter("u <> v").distinct(), "stars")
        dropped(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    else:
        raise RuntimeError("components did not converge")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
