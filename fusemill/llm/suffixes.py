"""Same or near-same records across splits, by a partitioned suffix array (problem 5).

Records of the same words in the same order are one class. The suffixes of all classes, in their real word order, form one suffix
array: it is range-partitioned by the leading ``RUN`` words and what follows, so a partition is a piece of the array and a frequent
run is cut like any other. Neighbours of different splits with ``RUN`` or more words in common reveal shared spans; the spans
of a record are merged into its coverage. A shared run of any length is found from each of its starts, so cutting the
compared words changes no coverage.

Pairs: the neighbours are candidates. As the overlap asked for ignores word order and 0.8 of the words may be shared without
any run of five, a second source of candidates stands beside them, an exact prefix filter (see :func:`prefix_keys`); the
union is compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fusemill.llm.minhash import BLOCK, LEAST_WORDS, OVERLAP, verified
from fusemill.llm.oracle import OVERLAPS, words_sql
from fusemill.llm.words import class_table, digested, lists_of, mix
from fusemill.runtime import dropped, spread, table, written

#: Least words of a shared span; a shorter record is a span as a whole.
RUN = 5
#: Words after a run by which its suffixes are ordered, 16 bits of each.
AFTER = 4
#: Words in common from which neighbours are candidates; a record with fewer words must stand there whole.
LONG = RUN + AFTER
#: Suffixes compared at once inside a task.
PIECE = 120_000
#: Bits of the filter of held-out keys, 8 MB whatever the corpus; where it fills up, fewer keys of the other split are left out early.
FILTER_BITS = 1 << 26
#: Elements held by at most ``HOT`` texts are keys of candidates alone; each ``HOT_GROWTH``-fold frequency joins one more to
#: the key, up to the number given for texts of at most so many words.
HOT, HOT_GROWTH = 256, 16
KEY_WORDS = ((16, 4), (48, 3), (1 << 31, 2))
#: Element frequencies are counted in a table of fixed size; a collision can only change the canonical order, alike for all.
COUNTERS = 1 << 20
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
EVAL_SPLITS = ("dev", "test")
KINDS = ("passage", "query")


def element_counts(spark: SparkSession, classes: DataFrame) -> np.ndarray:
    """Occurrences of all elements over all classes in ``COUNTERS`` counters (4 MB, whatever the corpus)."""
    counted = classes.select(F.explode("elements").alias("e")).groupBy(F.pmod("e", F.lit(COUNTERS)).cast("int").alias("slot")).agg(F.count("*").alias("n"))
    out = np.zeros(COUNTERS, np.int32)
    got = counted.toArrow()
    out[np.asarray(got.column("slot"))] = np.minimum(np.asarray(got.column("n")), np.iinfo(np.int32).max)
    return out


def suffixes_of(offsets: np.ndarray, flat: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(record, start, key, after) of every suffix that holds a run: key of its leading words, code of the words after them."""
    size = np.diff(offsets)
    rec = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(flat)) - offsets[rec]
    use = np.flatnonzero((at + RUN <= size[rec]) | ((at == 0) & (size[rec] < RUN)))
    left = (size[rec] - at)[use]
    padded = np.concatenate([flat, np.zeros(RUN + AFTER, np.uint64)])
    key = mix(np.minimum(left, RUN).astype(np.uint64) + salt[rec[use]] * _GOLDEN)
    for i in range(RUN):
        key = np.where(i < left, mix(key * np.uint64(31) + padded[use + i] + _GOLDEN), key)
    after = np.zeros(len(use), np.uint64)
    for i in range(AFTER):
        code = np.where(RUN + i < left, (mix(padded[use + RUN + i]) >> np.uint64(48)) | np.uint64(1), np.uint64(0))
        after = (after << np.uint64(16)) | code
    return rec[use], at[use], key, after


def held_filter(keyed: DataFrame, spark: SparkSession) -> np.ndarray:
    """Bits of the keys in ``keyed`` (key bigint), ``FILTER_BITS`` of them, as uint64 words."""
    slot = F.pmod("key", F.lit(FILTER_BITS))
    bits = keyed.select((slot / 64).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(key, {FILTER_BITS}) % 64 as int))").alias("bit"))
    got = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[np.asarray(got.column("word"))] = np.asarray(got.column("bits")).view(np.uint64)
    return out


def _in_filter(words: np.ndarray, key: np.ndarray) -> np.ndarray:
    slot = key % np.uint64(FILTER_BITS)
    return (words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0


def _rows_both_sides(classes: DataFrame, run_on, names: list[str], schema: str) -> DataFrame:
    """Rows of the held-out classes and those rows of the other classes whose key may stand among them.

    ``run_on(batch, keep)`` gives arrays named ``names``, the key first; ``keep(key, held)`` tells which to give.
    """
    spark = classes.sparkSession

    def mapper(filter_words):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = filter_words.value if filter_words is not None else None
            for whole in batches:
                for begin in range(0, whole.num_rows, 250):
                    batch = whole.slice(begin, 250)
                    held = np.asarray(batch.column("held").to_numpy(zero_copy_only=False), bool)
                    keep = (lambda rec, key: held[rec] | _in_filter(words, key)) if words is not None else None
                    arrays = run_on(batch, keep)
                    yield pa.RecordBatch.from_arrays(arrays if words is not None else arrays[:1], names=names if words is not None else names[:1])

        return run

    held = classes.filter("held").mapInArrow(mapper(None), "key bigint")
    return classes.mapInArrow(mapper(spark.sparkContext.broadcast(held_filter(held, spark))), schema)


def suffix_rows(classes: DataFrame) -> DataFrame:
    """(key, after, num, place): the suffixes of the classes; place is 4 * start + 2 * train + held."""

    def run_on(batch: pa.RecordBatch, keep) -> list[pa.Array]:
        rec, at, key, after = suffixes_of(*lists_of(batch.column("sequence")), np.asarray(batch.column("kind"), np.uint64))
        if keep is not None:
            some = keep(rec, key)
            rec, at, key, after = rec[some], at[some], key[some], after[some]
        flags = [np.asarray(batch.column(c).to_numpy(zero_copy_only=False), bool)[rec] for c in ("train", "held")]
        place = at * 4 + flags[0] * 2 + flags[1]
        return [pa.array(key.view(np.int64)), pa.array(after.view(np.int64)), batch.column("num").take(pa.array(rec)), pa.array(place, pa.int64())]

    return _rows_both_sides(classes.select("kind", "num", "train", "held", "sequence"), run_on, ["key", "after", "num", "place"], "key bigint, after bigint, num bigint, place bigint")


def _neighbours(key: np.ndarray, after: np.ndarray, mine: np.ndarray, other: np.ndarray, forward: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row of the nearest suffix of the other split before - or after - each of ``mine``, words in common), -1 and 0 where its run has none."""
    n = len(key)
    rows = np.arange(n)
    if forward:
        near = np.maximum.accumulate(np.where(other, rows, -1))
        near = np.concatenate([[-1], near[:-1]])
    else:
        near = np.minimum.accumulate(np.where(other, rows, n)[::-1])[::-1]
        near = np.concatenate([near[1:], [n]])
        near = np.where(near == n, -1, near)
    ok = mine & (near >= 0) & (key[near] == key)
    common = np.where(ok, RUN, 0)
    same = ok.copy()
    for i in range(AFTER):
        shift = np.uint64(16 * (AFTER - 1 - i))
        a, b = (after >> shift) & np.uint64(0xFFFF), (after[near] >> shift) & np.uint64(0xFFFF)
        same &= (a == b) & (a > 0)
        common += same
    return np.where(ok, near, -1), common


def shared_spans(suffixes: DataFrame) -> DataFrame:
    """One row per fact found in the sorted array: what = 'pair' (num, other), 'span' (num, start, length) or 'edge' (key, train, held).

    Rows of the first and last run of a piece that have no neighbour of the other split there are 'open' (key, num, start, train, held);
    the edges tell whether their run goes on with the other split in the next piece. See :func:`closed_spans`.
    """
    schema = "what string, key bigint, num bigint, other bigint, start bigint, length bigint, train boolean, held boolean"
    names = [c.split()[0] for c in schema.split(", ")]

    def table_of(what: str, n: int, **columns) -> pa.RecordBatch:
        kinds = {"what": pa.string(), "train": pa.bool_(), "held": pa.bool_()}
        return pa.RecordBatch.from_arrays([pa.repeat(what, n) if c == "what" else pa.array(columns[c], kinds.get(c, pa.int64())) if c in columns else pa.nulls(n, kinds.get(c, pa.int64())) for c in names], names=names)

    def piece(key, after, num, place) -> Iterator[pa.RecordBatch]:
        train, held, start = (place & 2) > 0, (place & 1) > 0, place >> 2
        best, pairs = np.where(train & held, RUN, 0), []
        for forward in (True, False):
            for mine, other in ((train, held), (held, train)):
                near, common = _neighbours(key, after, mine, other, forward)
                best = np.maximum(best, common)
                short = (start == 0) & (after & np.uint64(0xFFFF) == 0)
                ok = (near >= 0) & (num[near] != num) & ((common >= LONG) | short)
                a, b = num[ok], num[near[ok]]
                # (train, held-out) in this order; a class of both splits may be either
                pairs.append(np.stack([a, b] if mine is train else [b, a]))
        pairs = np.unique(np.concatenate(pairs, axis=1), axis=1)
        yield table_of("pair", pairs.shape[1], num=pairs[0], other=pairs[1])
        hit = best > 0
        yield table_of("span", int(hit.sum()), num=num[hit], start=start[hit], length=best[hit])
        border = (key == key[0]) | (key == key[-1])
        for k in {int(key[0]), int(key[-1])}:
            rows = key == np.int64(k)
            yield table_of("edge", 1, key=[k], train=[bool(train[rows].any())], held=[bool(held[rows].any())])
        wait = border & ~hit
        yield table_of("open", int(wait.sum()), key=key[wait], num=num[wait], start=start[wait], train=train[wait], held=held[wait])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        rows = 0

        def flush() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(waiting)
            yield from piece(np.asarray(whole.column(0)), np.asarray(whole.column(1)).view(np.uint64), np.asarray(whole.column(2)), np.asarray(whole.column(3)))

        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                rows += batch.num_rows
            if rows >= PIECE:
                yield from flush()
                waiting, rows = [], 0
        if rows:
            yield from flush()

    array = suffixes.repartitionByRange("key", "after", "num", "place").sortWithinPartitions("key", "after", "num", "place")
    return array.mapInArrow(run, schema)


def closed_spans(found: DataFrame) -> DataFrame:
    """(num, start, length) of all shared spans, those at the edges of pieces included; ``found`` is a written table."""
    edges = found.filter("what = 'edge'").groupBy("key").agg(F.max("train").alias("_t"), F.max("held").alias("_h"))
    late = found.filter("what = 'open'").select("key", "num", "start", "train", "held").join(edges, "key").filter("train and _h or held and _t")
    return found.filter("what = 'span'").select("num", "start", "length").unionByName(late.select("num", "start", F.lit(RUN).cast("long").alias("length")))


def _canonical(offsets: np.ndarray, flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(size, record, element, frequency), the latter three by element, every record in canonical order."""
    size = np.diff(offsets)
    rec = np.repeat(np.arange(len(size)), size)
    often = counts[(flat % np.uint64(COUNTERS)).astype(np.int64)]
    order = np.lexsort((flat, often, rec))
    return size, rec, flat[order], often[order]


def _least_common(n: np.ndarray, overlap: float) -> np.ndarray:
    """Elements two texts have in common at least, the longer of n elements."""
    return np.ceil(n * overlap - 1e-9).astype(np.int64)


def length_bands(most: int, overlap: float) -> np.ndarray:
    """First lengths of bands; texts whose lengths allow the overlap are in one band or in neighbouring ones."""
    out = [1]
    while out[-1] <= most:
        out.append(int(out[-1] / overlap + 1e-9) + 1)
    return np.array(out, np.int64)


def prefix_keys(offsets: np.ndarray, flat: np.ndarray, counts: np.ndarray, overlap: float = OVERLAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(record, key, own) such that any two records of the overlap share a key, and one has it as its own.

    A pair is looked for in the band of its longer text. There, a text of n elements has at most s = n - (least common)
    elements that the other lacks, so the pair's first d common elements in canonical order are among the first s + d of both. All
    choices of d of these, with no more than s left out, are keys. d follows from the frequency of the first of them
    and the band, which both texts know; it decides only how many texts meet at a key, never whether a pair does.
    """
    size, rec, flat, often = _canonical(offsets, flat, counts)
    bands = length_bands(int(size.max(initial=1)), overlap)
    mine = np.searchsorted(bands, size, "right") - 1
    wanted = 1 + np.maximum(0, np.ceil(np.log(np.maximum(often, 1) / HOT) / np.log(HOT_GROWTH))).astype(np.int64)
    out = []
    for step in (0, 1):
        band = mine + step
        low = np.maximum(size, bands[np.minimum(band, len(bands) - 1)])
        spare = size - _least_common(low, overlap)  # below 0: no pair with a text of this band
        first = bands[np.minimum(band, len(bands) - 1)]
        most = np.select([first <= n for n, _ in KEY_WORDS], [d for _, d in KEY_WORDS])
        most = np.minimum(most, np.maximum(_least_common(first, overlap), 1))
        begin = offsets[:-1]
        at = np.arange(len(flat)) - begin[rec]
        last = np.flatnonzero(at <= spare[rec])
        left = np.minimum(wanted[last], most[rec[last]]) - 1
        key = mix(flat[last] + (band[rec[last]].astype(np.uint64) + np.uint64(1)) * _GOLDEN)
        chosen = 1
        while len(last):
            done = left == 0
            who = rec[last[done]]
            out.append((who, key[done], np.full(len(who), step == 0)))
            last, left, key = last[~done], left[~done], key[~done]
            stop = np.minimum(spare[rec[last]] + chosen, size[rec[last]] - 1) + begin[rec[last]]
            many = np.maximum(stop - last, 0)
            source = np.repeat(np.arange(len(last)), many)
            following = last[source] + 1 + np.arange(len(source)) - np.repeat(np.cumsum(many) - many, many)
            key = mix(key[source] * np.uint64(31) + flat[following] + _GOLDEN)
            last, left, chosen = following, left[source] - 1, chosen + 1
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*out))


def prefix_rows(classes: DataFrame, counts: np.ndarray, overlap: float = OVERLAP) -> DataFrame:
    """(key, num, train, held): the keys of :func:`prefix_keys` of every class."""
    shared = classes.sparkSession.sparkContext.broadcast(counts)

    def run_on(batch: pa.RecordBatch, keep) -> list[pa.Array]:
        rec, key = prefix_keys(*lists_of(batch.column("elements")), shared.value, overlap)[:2]
        key = mix(key + np.asarray(batch.column("kind"), np.uint64)[rec] * _GOLDEN)
        if keep is not None:
            some = keep(rec, key)
            rec, key = rec[some], key[some]
        take = pa.array(rec)
        return [pa.array(key.view(np.int64)), *[batch.column(c).take(take) for c in ("num", "train", "held")]]

    return _rows_both_sides(classes.select("kind", "num", "train", "held", "elements"), run_on, ["key", "num", "train", "held"], "key bigint, num bigint, train boolean, held boolean")


def prefix_candidates(keyed: DataFrame) -> DataFrame:
    """(a, b) of classes, a in train and b held out, that share a prefix key; ``keyed`` is a written table.

    Keys are counted with map-side combination, and a train class that meets one held-out class comes out of the count itself. Only
    larger keys are joined back to their rows; above ``BLOCK`` train classes they are split into blocks, each of
    which meets all held-out classes in a task of its own; none is capped.
    """
    t, h = F.when(F.col("train"), F.col("num")), F.when(F.col("held"), F.col("num"))
    met = keyed.groupBy("key").agg(F.count(t).alias("nt"), F.count(h).alias("nh"), F.min(t).alias("a"), F.min(h).alias("b")).filter("nt > 0 and nh > 0")
    met = written(met, "split_keys")
    many = keyed.join(met.filter("nt > 1 or nh > 1").select("key", F.ceil(F.col("nt") / BLOCK).cast("int").alias("blocks")), "key")
    trained = many.filter("train").select("key", F.pmod(F.xxhash64("num"), F.col("blocks")).cast("int").alias("block"), F.col("num").alias("a"))
    held = many.filter("held").select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("num").alias("b"))
    both = trained.join(held, ["key", "block"]).select("a", "b")
    return met.filter("nt = 1 and nh = 1").select("a", "b").unionByName(both).filter("a <> b")


def split_records(df: DataFrame, kind: str, key: str, text: str, least_words: int) -> DataFrame:
    """(kind, id, split, source, text, cls, n) of the records that belong to train, dev or test."""
    split = F.regexp_replace(F.lower(F.col("data_split")), r"[\s\p{Z}]+", "")
    rows = df.select(F.lit(KINDS.index(kind)).alias("kind"), F.col(key).alias("id"), split.alias("split"), F.col("source").cast("string").alias("source"), F.col(text).alias("text"))
    rows = rows.filter(F.col("split").isin("train", *EVAL_SPLITS) & F.col("id").isNotNull() & F.col("text").isNotNull())
    return digested(spread(rows), "text", least_words, ordered=True)


def split_classes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, classes), both written. Empty input: empty results."""
    rows = written(records, "split_records")
    side = [F.max(F.col("split") == "train").alias("train"), F.max(F.col("split") != "train").alias("held")]
    classes = written(class_table(rows, "text", ["kind"], side, ordered=True), "split_classes")
    named = written(rows.drop("text").join(classes.select("kind", "cls", "num"), ["kind", "cls"]).select("kind", "id", "split", "source", "n", "num"), "split_members")
    dropped(rows)
    return named, classes


def cross_split(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records (kind, id, split, source, n, num) written, links (a, b, overlap) between a train class and a held-out class)."""
    rows, classes = split_classes(records)
    found = written(shared_spans(suffix_rows(classes)), "suffix_neighbours")
    neighbours = found.filter("what = 'pair'").select(F.col("num").alias("a"), F.col("other").alias("b"))
    keyed = written(prefix_rows(classes, element_counts(records.sparkSession, classes)), "prefix_keys")
    links = verified(neighbours.unionByName(prefix_candidates(keyed)), classes)
    dropped(found, keyed, classes)
    return rows, links


def overlapping_pairs(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct (kind, t, h): train record t and held-out record h of equal or linked classes, t <> h.

    As many rows as there are pairs, for those who ask for pairs of records. Train records of a large class are split into blocks, so
    no task holds all pairs of one class.
    """
    records = rows.select("kind", "id", F.col("split") == "train", "num").toDF("kind", "id", "train", "num").distinct()
    sizes = records.filter("train").groupBy("num").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    t = records.filter("train").join(sizes, "num").select(F.col("num").alias("a"), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "kind", F.col("id").alias("t"))
    h = records.filter("not train").select(F.col("num").alias("b"), F.col("id").alias("h"))
    met = links.select("a", "b").unionByName(sizes.select(F.col("num").alias("a"), F.col("num").alias("b")))
    met = met.join(sizes.withColumnRenamed("num", "a"), "a").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    return met.join(h, "b").join(t, ["a", "block"]).select("kind", "t", "h").filter("t <> h").distinct()


def span_coverage(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """(record_type, id, split, source, n_words, covered): words of each record inside spans of ``RUN`` or more words shared with the other split.

    A record shorter than that is covered if it stands whole in the other split. Spans of a class are merged: a word in
    several spans counts once, so a record that stands in both splits is covered whole.
    """
    order = Window.partitionBy("num").orderBy("start")
    ends = F.col("start") + F.col("length")
    before = F.coalesce(F.max(ends).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = rows.groupBy("num").agg(F.max("n").alias("size"))
    inside = spans.groupBy("num", "start").agg(F.max("length").alias("length")).join(sizes, "num").withColumn("length", F.least("length", F.col("size") - F.col("start")))
    merged = inside.withColumn("fresh", F.greatest(ends - F.greatest("start", before), F.lit(0))).groupBy("num").agg(F.sum("fresh").alias("covered"))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    return rows.join(merged, "num", "left").select(kind.alias("record_type"), "id", "split", "source", F.col("n").cast("long").alias("n_words"), F.coalesce("covered", F.lit(0)).cast("long").alias("covered"))


def _records(spark, folder: str) -> DataFrame:
    passages = split_records(table(spark, folder, "passages"), "passage", "doc_id", "body", LEAST_WORDS)
    return passages.unionByName(split_records(table(spark, folder, "queries"), "query", "qid", "text", 1))


def _kind_name():
    return F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1).alias("record_type")


def p5_found(spark, folder: str) -> DataFrame:
    pairs = overlapping_pairs(*cross_split(_records(spark, folder)))
    return pairs.select(_kind_name(), F.least("t", "h").alias("id_a"), F.greatest("t", "h").alias("id_b")).distinct()


def p5_report(spark, folder: str) -> DataFrame:
    """Per record type, held-out split and source: records, those that overlap with train, and pairs."""
    rows, links = cross_split(_records(spark, folder))
    pairs = overlapping_pairs(rows, links).groupBy("kind", F.col("h").alias("id")).agg(F.count("*").alias("pairs"))
    held = rows.filter("split <> 'train'").select("kind", "id", "split", "source").distinct()
    per = held.join(pairs, ["kind", "id"], "left").groupBy(_kind_name(), "split", "source")
    return per.agg(F.count("*").alias("n_records"), F.count("pairs").alias("n_overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("n_pairs"))


def p5_coverage(spark, folder: str) -> DataFrame:
    rows, classes = split_classes(_records(spark, folder))
    found = written(shared_spans(suffix_rows(classes)), "suffix_neighbours")
    dropped(classes)
    return span_coverage(rows, closed_spans(found))


QUERIES = {"p5_found": p5_found, "p5_report": p5_report, "p5_coverage": p5_coverage}
_SPLIT = "lower(trim(data_split))"
_RECORDS = f"""recs as (
select 'passage' as kind, doc_id as id, {_SPLIT} as split, source, {words_sql('body')} as words from passages where doc_id is not null and {_SPLIT} in ('train', 'dev', 'test') and len({words_sql('body')}) >= {LEAST_WORDS}
union all select 'query', qid, {_SPLIT}, source, {words_sql('text')} from queries where qid is not null and {_SPLIT} in ('train', 'dev', 'test') and len({words_sql('text')}) >= 1)"""
ORACLES = {
    "p5_found": f"with {_RECORDS}, {OVERLAPS} select distinct kind as record_type, least(ia, ib) as id_a, greatest(ia, ib) as id_b from pairs where (sa = 'train') <> (sb = 'train')",
    "p5_report": f"""with {_RECORDS}, {OVERLAPS},
crossed as (select distinct kind, case when sa = 'train' then ib else ia end as h, case when sa = 'train' then ia else ib end as t from pairs where (sa = 'train') <> (sb = 'train')),
per as (select kind, h, count(*) as n from crossed group by 1, 2),
held as (select distinct kind, id, split, source from recs where split <> 'train')
select h.kind as record_type, split, source, count(*) as n_records, count(n) as n_overlapping, coalesce(sum(n), 0)::bigint as n_pairs from held h left join per on per.kind = h.kind and per.h = h.id group by all""",
    "p5_coverage": f"""with {_RECORDS}, numbered as (select row_number() over () as r, * from recs),
grams as (select r, kind, split, s, array_to_string(words[s + 1:s + {RUN}], ' ') || case when len(words) < {RUN} then ' .' else '' end as g, least(len(words), {RUN}) as n from (select *, unnest(range(greatest(len(words) - {RUN} + 1, 1))) as s from numbered)),
sides as (select kind, g, bool_or(split = 'train') as t, bool_or(split <> 'train') as h from grams group by 1, 2),
places as (select distinct r, s + unnest(range(n)) as place from grams join sides using (kind, g) where case when split = 'train' then h else t end),
covers as (select r, count(*) as covered from places group by 1)
select kind as record_type, id, split, source, len(words) as n_words, coalesce(covered, 0)::bigint as covered from numbered left join covers using (r)""",
}
