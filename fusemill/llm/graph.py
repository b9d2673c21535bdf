"""Most similar vectors for every vector, by robust-pruned directed graphs over shards (problem 6).

Vectors are routed to cells around centroids that are fitted on a bounded sample; a cell above ``SHARD`` members is divided by centroids of
its own, so a shard always fits a task and a query meets a bounded number of shards, however many vectors there are. Each shard gets one directed
graph: greedy beam searches propose neighbours, relaxed-distance pruning keeps diverse edges, reverse edges are added and
pruned alike. Every vector is indexed in its ``HOMES`` nearest cells, whose graphs it searches by beam search where they are built, and searches those of
its other cells among the ``PROBES`` nearest as a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fusemill.runtime import dropped, table, written

DIMENSIONS = 96
#: Most members of a shard; wanted members of a cell.
SHARD, CELL = 16_384, 4096
HOMES, PROBES = 2, 3
#: Shards of a divided cell that a query searches; a member belongs to one.
SUB_PROBES = 2
#: Members of a cell on which its own centroids are fitted, at most.
SUB_SAMPLE = 16_384
#: Vectors the centroids are fitted on, at most, and centroids at most. Every vector is indexed, in the sample or not.
SAMPLE, MOST_CELLS = 32_768, 2048
DEGREE, BEAM, EXPAND, ALPHA = 24, 48, 4, 1.2
#: Members of a shard that are compared whole before searches begin.
FIRST = 512
#: Entry points of a search: the medoid and evenly spread members.
ENTRIES = 32
#: Queries of a shard that meet its graph in one task.
QUERY_CHUNK = 20_000


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def beam_search(x: np.ndarray, edges: np.ndarray, queries: np.ndarray, entries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, similarities), best first, of a greedy beam search for every query at once; -1 fills short results.

    In each step every query expands its ``EXPAND`` best members not yet expanded, until its whole beam is expanded. The
    similarities of the batch to the shard, which is bounded, come from one matrix product: a walk looks them up, which costs
    less than gathering the vectors of each step.
    """
    b, n = len(queries), len(x)
    rows = np.arange(b)[:, None]
    table_ = np.full((b, n + 1), -9.0, np.float32)  # the last column stands for no member
    np.matmul(queries, x.T, out=table_[:, :n])
    seen = np.zeros((b, n + 1), bool)
    seen[:, entries] = True
    seen[:, n] = True
    beam = min(beam, n)
    ids = np.full((b, beam), n, np.int32)
    sims = np.full((b, beam), -9.0, np.float32)
    first = table_[:, entries]
    order = np.argsort(-first, axis=1)[:, :beam]
    ids[:, : order.shape[1]] = entries.astype(np.int32)[order]
    sims[:, : order.shape[1]] = np.take_along_axis(first, order, 1)
    done = ids == n
    live = np.arange(b)
    width = min(EXPAND, beam)
    while len(live):
        own_ids, own_sims, own_done = ids[live], sims[live], done[live]
        key = np.where(own_done, -9.0, own_sims)
        pick = np.argpartition(-key, width - 1, axis=1)[:, :width] if width < beam else np.tile(np.arange(beam), (len(live), 1))
        fresh = np.take_along_axis(key, pick, 1) > -9.0
        node = np.where(fresh, np.take_along_axis(own_ids, pick, 1), n)
        np.put_along_axis(own_done, pick, True, 1)
        found = edges[node].reshape(len(live), -1)
        at = live[:, None]
        found[seen[at, found]] = n
        # the same neighbour may come from two nodes: keep one
        found.sort(axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = n
        seen[at, found] = True
        all_ids = np.concatenate([own_ids, found], 1)
        all_sims = np.concatenate([own_sims, table_[at, found]], 1)
        all_done = np.concatenate([own_done, found == n], 1)
        top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        ids[live], sims[live] = np.take_along_axis(all_ids, top, 1), np.take_along_axis(all_sims, top, 1)
        own_done = np.take_along_axis(all_done, top, 1)
        done[live] = own_done
        live = live[~own_done.all(axis=1)]
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = ids[rows, order], sims[rows, order]
    return np.where(ids == n, -1, ids), sims


def robust_prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """(points, degree) edges: the nearest candidate is kept and strikes out all that lie alpha times nearer to it than to the point.

    The last row of ``x`` stands for no candidate. Where no more than ``degree`` candidates are left, all are kept.
    """
    rows, none = np.arange(len(points)), len(x) - 1
    cand = np.sort(candidates, axis=1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = none
    cand[cand == points[:, None]] = none
    cand.sort(axis=1)
    cand = cand[:, : max(degree, int((cand < none).sum(axis=1).max(initial=0)))]
    if cand.shape[1] <= degree:
        out = np.full((len(points), degree), none, np.int32)
        out[:, : cand.shape[1]] = cand
        return out
    vectors = x[cand]
    to_point = 2 - 2 * np.matmul(vectors, x[points][:, :, None])[:, :, 0]
    to_point[cand == none] = np.inf
    between = alpha * (2 - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1)))
    out = np.full((len(points), degree), none, np.int32)
    for k in range(degree):
        best = to_point.argmin(axis=1)
        alive = np.isfinite(to_point[rows, best])
        if not alive.any():
            break
        out[:, k] = np.where(alive, cand[rows, best], none)
        strike = between[rows, best] <= to_point
        strike[rows, best] = True
        to_point[strike] = np.inf
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """(edges, entry points) of one shard; an edge to ``len(x)`` is none.

    Members come in random order, in batches that double: each batch searches the graph of those before it, is pruned with relaxed distances, and
    its reverse edges are added and pruned alike. A first batch is compared whole.
    """
    n = len(x)
    rng = np.random.default_rng(n)
    medoid = int((x @ x.mean(axis=0)).argmax())
    edges = np.full((n + 1, degree), n, np.int32)
    if n <= degree + 1:
        for i in range(n):
            others = np.delete(np.arange(n), i)
            edges[i, : len(others)] = others
        return edges, np.arange(n)
    order = rng.permutation(n)
    order = np.concatenate([[medoid], order[order != medoid]])
    wide = np.concatenate([x, np.zeros((1, x.shape[1]), x.dtype)])
    at = 0
    while at < n:
        stop = min(n, max(FIRST, 2 * at), at + 512 if at else FIRST)
        batch = order[at:stop]
        if at == 0:
            found = np.tile(batch.astype(np.int32), (len(batch), 1))
            near = np.argsort(-(x[batch] @ x[batch].T), axis=1)[:, : beam + 1]
            found = np.take_along_axis(found, near, 1)
        else:
            entries = order[np.unique(np.linspace(0, at - 1, min(at, ENTRIES)).astype(np.int64))]
            found, _ = beam_search(x, edges, x[batch], entries, beam)
            # members of the batch that are near each other would not see each other
            own = np.argsort(-(x[batch] @ x[batch].T), axis=1)[:, : degree // 2 + 1]
            found = np.concatenate([np.where(found < 0, n, found), batch.astype(np.int32)[own]], 1)
        edges[batch] = robust_prune(wide, batch, found, degree, alpha)
        source, target = np.repeat(batch, degree), edges[batch].ravel()
        source, target = source[target < n], target[target < n]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        by = np.argsort(count, kind="stable")
        nodes, first, count = nodes[by], first[by], count[by]
        for lo in range(0, len(nodes), 512):
            some = slice(lo, lo + 512)
            slot = first[some][:, None] + np.arange(int(count[some].max()))
            extra = np.where(np.arange(slot.shape[1]) < count[some][:, None], source[np.minimum(slot, len(source) - 1)], n)
            edges[nodes[some]] = robust_prune(wide, nodes[some], np.concatenate([edges[nodes[some]], extra.astype(np.int32)], 1), degree, alpha)
        at = stop
    return edges, order[np.unique(np.linspace(0, n - 1, min(n, ENTRIES)).astype(np.int64))]


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of a spherical k-means on the sample, seeded with rows of the sample."""
    x = unit(sample)
    centres = x[np.random.default_rng(7).permutation(len(x))[:cells]]
    for _ in range(rounds if cells > 1 else 0):
        home = np.concatenate([(x[i : i + 4096] @ centres.T).argmax(1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(centres, dtype=np.float64)
        np.add.at(total, home, x)
        size = np.linalg.norm(total, axis=1)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1e-12)[:, None], centres).astype(np.float32)
    return centres


def usable_vectors(df: DataFrame, key: str, vector: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """(id, embedding, d0, d1): one row per key whose vector has ``dimensions`` finite numbers, not all zero, and a digest of it in two halves."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.filter((F.size(vector) == dimensions) & finite & F.exists(vector, lambda x: x != 0) & F.col(key).isNotNull())
    one = rows.groupBy(F.col(key).alias("id")).agg(F.min(vector).alias("embedding"))
    return one.select("id", "embedding", F.xxhash64("embedding").alias("d0"), F.xxhash64(F.lit(1), "embedding", F.lit(2)).alias("d1"))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float32).reshape(len(column), -1)


def routed(reps: DataFrame, centres: np.ndarray) -> DataFrame:
    """(cell, home, rep, embedding): each vector once for each of its ``PROBES`` nearest cells; ``home`` marks the ``HOMES`` nearest."""
    shared = reps.sparkSession.sparkContext.broadcast(centres)
    probes = min(PROBES, len(centres))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                scores = unit(_matrix(batch.column(1))) @ shared.value.T
                cell = np.argsort(-scores, axis=1, kind="stable")[:, :probes] if scores.shape[1] <= 64 else _best(scores, probes)
                row = pa.array(np.repeat(np.arange(batch.num_rows), probes))
                home = np.tile(np.arange(probes) < HOMES, batch.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(cell.ravel().astype(np.int32)), pa.array(home), batch.column(0).take(row), batch.column(1).take(row)], names=["cell", "home", "rep", "embedding"])

    return reps.select("rep", "embedding").mapInArrow(run, "cell int, home boolean, rep bigint, embedding array<float>")


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    part = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    rows = np.arange(len(scores))[:, None]
    return part[rows, np.argsort(-scores[rows, part], axis=1, kind="stable")]


def _nearest(ids: np.ndarray, raw: np.ndarray, edges: np.ndarray, entries: np.ndarray, rep: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rep, near, cosine): what beam search finds in one shard, k + 1 at most for each query; cosines of the found are exact."""
    beam = max(BEAM, 2 * k + 16)  # a shard may hold all k neighbours
    x, exact = unit(raw), raw.astype(np.float64)
    exact /= np.linalg.norm(exact, axis=1, keepdims=True)
    out = []
    for at in range(0, len(rep), 500):
        mine, own = rep[at : at + 500], q[at : at + 500]
        found, _ = beam_search(x, edges, unit(own), entries, beam)
        own = own.astype(np.float64)
        own /= np.linalg.norm(own, axis=1, keepdims=True)
        ok = (found >= 0) & (ids[found] != mine[:, None])
        ok &= np.cumsum(ok, axis=1) <= k + 1
        row, column = np.nonzero(ok)
        member = found[row, column]
        out.append((mine[row], ids[member], np.round(np.einsum("bd,bd->b", own[row], exact[member]), 10)))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


_GRAPH = {"cell": "int", "sub": "int", "degree": "int", "ids": "binary", "vectors": "binary", "edges": "binary", "entries": "binary", "rep": "binary", "near": "binary", "cosine": "binary"}


def _build(k: int):
    """The graph of one shard, and what its own members find in it."""

    def run(key, group):
        vectors, ids = _matrix(group.column("embedding").combine_chunks()), np.asarray(group.column("rep"), dtype=np.int64)
        edges, entries = build_graph(unit(vectors))
        found = _nearest(ids, vectors, edges, entries, ids, vectors, k)
        row = [key[0].as_py(), key[1].as_py(), edges.shape[1], *[x.tobytes() for x in (ids, vectors, edges, entries.astype(np.int64), *found)]]
        kinds = {"int": pa.int32(), "binary": pa.binary()}
        return pa.table({name: pa.array([value], kinds[kind]) for (name, kind), value in zip(_GRAPH.items(), row)})

    return run


def _found_at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rep, near, cosine in zip(*[batch.column(i).to_pylist() for i in range(3)]):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(rep, np.int64)), pa.array(np.frombuffer(near, np.int64)), pa.array(np.frombuffer(cosine, np.float64))], names=["rep", "near", "cosine"])


def _search(k: int):
    def run(key: tuple, queries: pa.Table, index: pa.Table) -> pa.Table:
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for g in index.to_pylist() if queries.num_rows else []:
            ids = np.frombuffer(g["ids"], np.int64)
            raw, edges = np.frombuffer(g["vectors"], np.float32).reshape(len(ids), -1), np.frombuffer(g["edges"], np.int32).reshape(len(ids) + 1, g["degree"])
            found = _nearest(ids, raw, edges, np.frombuffer(g["entries"], np.int64), np.asarray(queries.column("rep"), dtype=np.int64), _matrix(queries.column("embedding").combine_chunks()), k)
        return pa.table({"rep": pa.array(found[0]), "near": pa.array(found[1]), "cosine": pa.array(found[2])})

    return run


def _fit_cell(key, group):
    """Centroids of a cell that is divided, from a sample of its members."""
    centres = fit_centroids(_matrix(group.column("embedding").combine_chunks()), min(int(group.column("subs")[0].as_py()), group.num_rows))
    return pa.table({"cell": pa.array([key[0].as_py()], pa.int32()), "centres": pa.array([centres.tobytes()], pa.binary())})


def _place(key: tuple, rows: pa.Table, cell: pa.Table) -> pa.Table:
    """Rows of a divided cell, each once for each of its ``SUB_PROBES`` nearest shards; its home is the nearest."""
    centres = np.frombuffer(cell.column("centres")[0].as_py(), np.float32).reshape(-1, _matrix(rows.column("embedding").combine_chunks()).shape[1]) if cell.num_rows and rows.num_rows else None
    if centres is None:
        return pa.table({"cell": pa.array([], pa.int32()), "sub": pa.array([], pa.int32()), "home": pa.array([], pa.bool_()), "rep": pa.array([], pa.int64()), "embedding": pa.array([], pa.list_(pa.float32()))})
    scores = unit(_matrix(rows.column("embedding").combine_chunks())) @ centres.T
    k = min(SUB_PROBES, scores.shape[1])
    sub = _best(scores, k) if k < scores.shape[1] else np.argsort(-scores, axis=1, kind="stable")
    take = pa.array(np.repeat(np.arange(rows.num_rows), k))
    home = np.asarray(rows.column("home"), bool)[:, None] & (np.arange(k) == 0)
    return pa.table({"cell": rows.column("cell").take(take).cast(pa.int32()), "sub": pa.array(sub.ravel().astype(np.int32)), "home": pa.array(home.ravel()), "rep": rows.column("rep").take(take), "embedding": rows.column("embedding").take(take)})


def placed_rows(reps: DataFrame, centres: np.ndarray) -> DataFrame:
    """(cell, sub, home, rep, embedding): each vector once for each shard it searches; ``home`` marks those that index it.

    Cells of up to ``SHARD`` members are shards. Larger ones are divided by centroids of their own, and their rows placed in
    chunks of ``QUERY_CHUNK``, so no task holds a cell.
    """
    rows = routed(reps, centres)
    sizes = rows.groupBy("cell").agg(F.sum(F.col("home").cast("long")).alias("members"), F.count("*").alias("queries"))
    sizes = written(sizes.select("cell", "members", F.ceil(F.col("members") / CELL).cast("int").alias("subs"), F.ceil(F.col("queries") / QUERY_CHUNK).cast("int").alias("chunks")), "cells")
    small, large = (F.broadcast(sizes.filter(c)) for c in (f"members <= {SHARD}", f"members > {SHARD}"))  # one row per cell, MOST_CELLS at most
    whole = rows.join(small.select("cell"), "cell").withColumn("sub", F.lit(0)).select("cell", "sub", "home", "rep", "embedding")
    divided = rows.join(large, "cell")
    sample = divided.filter(F.col("home") & (F.pmod(F.xxhash64("rep", F.lit(3)), F.col("members")) < SUB_SAMPLE)).select("cell", "subs", "embedding")
    own = written(sample.groupBy("cell").applyInArrow(_fit_cell, "cell int, centres binary"), "cell_centres")
    chunked = divided.withColumn("chunk", F.pmod(F.xxhash64("rep", F.lit(2)), F.col("chunks")).cast("int")).select("cell", "chunk", "home", "rep", "embedding")
    spread_centres = own.join(large, "cell").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("cell", "chunk", "centres")
    schema = "cell int, sub int, home boolean, rep bigint, embedding array<float>"
    return whole.unionByName(written(chunked.groupBy("cell", "chunk").cogroup(spread_centres.groupBy("cell", "chunk")).applyInArrow(_place, schema), "divided"))


def class_neighbours(reps: DataFrame, k: int) -> DataFrame:
    """(rep, near, cosine): the k most similar other vectors of every vector of ``reps`` (rep bigint, embedding), all distinct.

    A vector is sent to its homes, where it is indexed and searched with, and once more for each other shard it searches: the index (one
    graph per shard) is a written table, which these queries meet shard by shard, in chunks of ``QUERY_CHUNK``.
    """
    n = reps.count()
    if not n:
        return reps.select("rep", F.col("rep").alias("near"), F.lit(0.0).alias("cosine")).limit(0)
    cells = max(1, min(MOST_CELLS, -(-n // CELL)))
    share = min(1.0, SAMPLE / n)
    sample = reps.filter(F.pmod(F.xxhash64("rep"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("embedding").limit(SAMPLE).toArrow()
    matrix = _matrix(sample.column("embedding").combine_chunks())
    centres = fit_centroids(matrix, min(cells, len(matrix)))
    placed = placed_rows(reps, centres)
    schema = ", ".join(f"{name} {kind}" for name, kind in _GRAPH.items())
    index = written(placed.filter("home").select("cell", "sub", "rep", "embedding").groupBy("cell", "sub").applyInArrow(_build(k), schema), "graphs")
    away = placed.filter("not home")
    shards = away.groupBy("cell", "sub").agg(F.ceil(F.count("*") / QUERY_CHUNK).cast("int").alias("chunks"))
    shards = written(shards, "shards")
    keys = ["cell", "sub", "chunk"]
    graphs = index.drop("rep", "near", "cosine").join(shards, ["cell", "sub"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    queries = away.join(shards, ["cell", "sub"]).withColumn("chunk", F.pmod(F.xxhash64("rep", F.lit(2)), F.col("chunks")).cast("int"))
    answer = "rep bigint, near bigint, cosine double"
    found = queries.select(*keys, "rep", "embedding").groupBy(*keys).cogroup(graphs.groupBy(*keys)).applyInArrow(_search(k), answer)
    found = found.unionByName(index.select("rep", "near", "cosine").mapInArrow(_found_at_home, answer))
    # at most k + 1 from each of the few shards a vector searches, so a group is bounded
    best = found.groupBy("rep").agg(F.array_sort(F.collect_set(F.struct((-F.col("cosine")).alias("c"), "near"))).alias("f"))
    fresh = F.filter("f", lambda x, i: ~F.exists(F.slice("f", F.lit(1), i), lambda y: y["near"] == x["near"]))
    best = best.select("rep", F.explode(F.slice(fresh, 1, k)).alias("x")).select("rep", F.col("x.near").alias("near"), (-F.col("x.c")).alias("cosine"))
    near = written(best, "class_neighbours")
    dropped(index)
    return near


def nearest_vectors(df: DataFrame, key: str, vector: str, k: int, dimensions: int = DIMENSIONS) -> DataFrame:
    """(id, near, cosine, rank): the k other vectors of greatest cosine to every usable vector; ties to the smaller id.

    Unusable vectors (null, wrong length, non-finite, all zero) and null keys take no part; repeated keys count once.
    Identical vectors are indexed once: each of them gets the others of its class, of which only the k + 1 smallest
    ids can matter, so a class may hold any share of the rows. Fewer than k others: fewer rows. Empty: no rows.
    """
    vectors = written(usable_vectors(df, key, vector, dimensions), "vectors")
    # classes are found by digests, so embeddings are not shuffled for it
    classes = written(vectors.groupBy("d0", "d1").agg(F.min("id").alias("rep")), "vector_classes")
    members = written(vectors.select("id", "d0", "d1").join(classes, ["d0", "d1"]).select("rep", "id"), "class_members")
    reps = written(vectors.select(F.col("id").alias("rep"), "embedding").join(classes.select("rep"), "rep", "left_semi"), "reps")
    dropped(vectors)
    near = class_neighbours(reps, k)
    few = Window.partitionBy("rep").orderBy("id")
    first = members.withColumn("_r", F.row_number().over(few)).filter(F.col("_r") <= k + 1).drop("_r")
    offered = near.unionByName(reps.select("rep", F.col("rep").alias("near"), F.lit(1.0).alias("cosine")))
    offered = offered.join(first.select(F.col("rep").alias("near"), F.col("id").alias("other")), "near").select("rep", "other", "cosine")
    order = Window.partitionBy("rep").orderBy(F.col("cosine").desc(), F.col("other"))
    offered = offered.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)
    own = members.join(offered, "rep")
    mine = own.groupBy("rep", "id").agg(F.min(F.when(F.col("id") == F.col("other"), F.col("place"))).alias("self"))
    rank = F.col("place") - F.when(F.col("self") < F.col("place"), 1).otherwise(0)
    return own.join(mine, ["rep", "id"]).filter("id <> other").select("id", F.col("other").alias("near"), "cosine", rank.cast("long").alias("rank")).filter(F.col("rank") <= k)


def _wanted(spark, folder: str) -> int:
    row = table(spark, folder, "run_config").filter("run_name = 'vector_neighbours'").agg(F.max("retrieve_topk")).first()
    return int(row[0] or 0)


def p6_neighbours(spark, folder: str) -> DataFrame:
    return nearest_vectors(table(spark, folder, "doc_vectors"), "vec_id", "embedding", _wanted(spark, folder)).select(F.col("id").alias("vec_id"), F.col("near").alias("near_id"), "rank", F.round("cosine", 6).alias("cosine"))


def p6_found(spark, folder: str) -> DataFrame:
    near = p6_neighbours(spark, folder)
    return near.select(F.least("vec_id", "near_id").alias("vec_id_a"), F.greatest("vec_id", "near_id").alias("vec_id_b")).distinct()


QUERIES = {"p6_found": p6_found, "p6_neighbours": p6_neighbours}
_NEAREST = f"""with v as (select vec_id, min(embedding)::double[] as e from doc_vectors where len(embedding) = {DIMENSIONS} and vec_id is not null
  and len(list_filter(embedding, lambda x: isfinite(x))) = {DIMENSIONS} and len(list_filter(embedding, lambda x: x <> 0)) > 0 group by 1),
k as (select coalesce(max(retrieve_topk), 0) as k from run_config where run_name = 'vector_neighbours'),
s as (select a.vec_id as va, b.vec_id as vb, round(list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)), 10) as c from v a, v b where a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by va order by c desc, vb) as n from s)"""
ORACLES = {
    "p6_found": f"{_NEAREST} select distinct least(va, vb) as vec_id_a, greatest(va, vb) as vec_id_b from r, k where n <= k",
    "p6_neighbours": f"{_NEAREST} select va as vec_id, vb as near_id, n as rank, round(c, 6) as cosine from r, k where n <= k",
}
