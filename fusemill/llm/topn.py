"""Top N items within every group, by descending score bands (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fusemill.runtime import table, written

#: Shares of the rows above the band edges, from the top; the last band is the rest.
BAND_SHARES = (0.05, 0.3)
#: Filled groups that are broadcast, at most; with more, rows and filled groups are shuffled by group.
BROADCAST_GROUPS = 500_000
#: Scales (say, runs) whose band edges may be broadcast; with more, the edges are joined by a shuffle.
BROADCAST_SCALES = 100_000


def _same(a: str, b: str, keys: list[str]):
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return on


def score_bands(df: DataFrame, scale: list[str], score: str) -> DataFrame:
    """Add ``band``, 0 at the top: edges are approximate quantiles per scale, so they only steer the work, never the result."""
    shares = F.array(*[F.lit(1.0 - s) for s in BAND_SHARES])
    edges = df.groupBy(*scale).agg(F.percentile_approx(F.col(score), shares, F.lit(1000)).alias("edges"))
    edges = written(edges, "band_edges")
    if edges.limit(BROADCAST_SCALES + 1).count() <= BROADCAST_SCALES:
        edges = F.broadcast(edges)
    band = F.lit(len(BAND_SHARES))
    for i in reversed(range(len(BAND_SHARES))):
        band = F.when(F.col(f"d.{score}") >= F.col("e.edges")[i], F.lit(i)).otherwise(band)
    return df.alias("d").join(edges.alias("e"), _same("d", "e", scale)).select("d.*", band.alias("band"))


def top_n_per_group(df: DataFrame, group: list[str], item: str, score: str, n: DataFrame, n_column: str, scale: list[str] | None = None) -> DataFrame:
    """The first n items of every group: best score of each item, score descending, then item ascending.

    ``n`` maps some of the group's columns to the wanted number in ``n_column``; ``scale`` are the group columns
    within which scores are comparable (default: those of ``n``). Rows with null or NaN score or null item do not
    count, repeated items count once with their best score, groups without an n give nothing, groups smaller than n
    come out whole, null group keys form a group of their own when n names one. Empty input: empty result.
    Returns (group..., item, score, rank bigint).

    Bands run from the top. A band's rows of groups already filled are dropped by an anti-join, before any shuffle of
    items while the filled groups can be broadcast; the rest are reduced to one row per item. Groups are closed as soon as they hold n items, so of a group
    with millions of items only the top bands are ever shuffled. The exact tie rank at the end keeps at most max(n)
    rows per group and task before its shuffle.
    """
    keys = [c for c in n.columns if c in group]
    scale = scale or keys
    wanted = written(n.filter(F.col(n_column) > 0).groupBy(*keys).agg(F.max(n_column).cast("long").alias("_n")), "wanted")
    most = wanted.agg(F.max("_n")).first()[0]
    rows = df.select(*group, item, score).filter(F.col(score).isNotNull() & ~F.isnan(score) & F.col(item).isNotNull())
    if most is None:
        return rows.withColumn("rank", F.lit(0).cast("long")).limit(0)
    columns = [*group, item, score]
    banded = score_bands(rows.alias("r").join(wanted.alias("w"), _same("r", "w", keys)).select("r.*", "w._n"), scale, score)
    banded = written(banded, "bands", ["band"])
    kept: DataFrame | None = None
    filled: DataFrame | None = None
    for band in range(len(BAND_SHARES) + 1):
        here = banded.filter(F.col("band") == band).drop("band")
        if filled is not None:
            here = here.alias("a").join(filled.alias("f"), _same("a", "f", group), "left_anti")
        here = here.groupBy(*group, item, "_n").agg(F.max(score).alias(score))
        if kept is not None:
            here = here.alias("a").join(kept.alias("k"), _same("a", "k", [*group, item]), "left_anti")
        here = written(here, f"band_{band}")
        kept = here if kept is None else kept.unionByName(here)
        if band < len(BAND_SHARES):
            filled = written(kept.groupBy(*group, "_n").agg(F.count("*").alias("have")).filter(F.col("have") >= F.col("_n")).select(*group), f"filled_{band}")
            if filled.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
                filled = F.broadcast(filled)
    order = Window.partitionBy(*group).orderBy(F.col(score).desc(), F.col(item).asc())
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return ranked.filter(F.col("rank") <= F.col("_n")).select(*columns, F.col("rank").cast("long").alias("rank"))


def ranking_top(spark, folder: str) -> DataFrame:
    config = table(spark, folder, "run_config").select("run_id", "retrieve_topk")
    return top_n_per_group(table(spark, folder, "rankings"), ["run_id", "qid"], "doc_id", "score", config, "retrieve_topk")


def p1_found(spark, folder: str) -> DataFrame:
    return ranking_top(spark, folder).select("run_id", "qid", "doc_id")


def p1_ranked(spark, folder: str) -> DataFrame:
    return ranking_top(spark, folder).withColumn("score", F.col("score").cast("double"))


_RANKED = """
with best as (select run_id, qid, doc_id, max(score) as score from rankings
  where score is not null and not isnan(score) and doc_id is not null group by 1, 2, 3),
ranked as (select b.*, row_number() over (partition by b.run_id, b.qid order by b.score desc, b.doc_id) as rank, c.retrieve_topk
  from best b join run_config c on c.run_id = b.run_id)
"""
QUERIES = {"p1_found": p1_found, "p1_ranked": p1_ranked}
ORACLES = {
    "p1_found": _RANKED + "select run_id, qid, doc_id from ranked where rank <= retrieve_topk",
    "p1_ranked": _RANKED + "select run_id, qid, doc_id, score::double as score, rank from ranked where rank <= retrieve_topk",
}
