"""Near-duplicate records with small edits: SuperMinHash, banding, verification, union-find groups (problem 4).

Similarity is the overlap of word multisets: words in common divided by the words of the longer text. An overlap of
0.8 is a Jaccard similarity of at least 2/3, for which ``BANDS`` bands of ``ROWS`` values miss a pair with probability
(1 - (2/3)^5)^56 = 0.0004 (at Jaccard 0.8: 2e-10).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fusemill.llm.components import connected_components
from fusemill.llm.oracle import OVERLAPS, words_sql
from fusemill.llm.words import class_table, digested, lists_of, mix
from fusemill.runtime import dropped, spread, table, written

BANDS, ROWS = 56, 5
OVERLAP = 0.8
LEAST_WORDS = 20
#: Pairs that are broadcast to the texts, at most; more are joined by a shuffle.
BROADCAST_PAIRS = 500_000
#: Members of a bucket that meet in one task; larger buckets are split into blocks which meet pairwise.
BLOCK = 1000
#: Elements whose permutations are held at once, so that a text of any length fits a task.
CHUNK = 32_768
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def superminhash(offsets: np.ndarray, elements: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash signatures (texts, m) of element sets, as uint64: permutation rank in the high half, random part below.

    Step j of every element's own random permutation is taken for all elements at once. A text stops as soon as its
    largest value has a rank at or below j, for no later step can lower any of its values.
    """
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    best = np.full(n * m, np.iinfo(np.uint64).max, np.uint64)
    for begin in range(0, len(elements), CHUNK):
        live = np.arange(begin, min(begin + CHUNK, len(elements)))
        perm = np.tile(np.arange(m, dtype=np.int16), (len(live), 1))
        for j in range(m):
            if not len(live):
                break
            row = live - begin
            bits = mix(elements[live] + np.uint64((j + 1) * int(_GOLDEN) & 0xFFFFFFFFFFFFFFFF))
            k = j + (((bits & np.uint64(0xFFFFFFFF)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64)
            slot, old = perm[row, k], perm[row, j]
            perm[row, k], perm[row, j] = old, slot
            value = (np.uint64(j) << np.uint64(32)) | (bits >> np.uint64(32))
            np.minimum.at(best, doc[live] * m + slot, value)
            first, last = doc[live[0]], doc[live[-1]] + 1
            worst = best[first * m : last * m].reshape(-1, m).max(1) >> np.uint64(32)
            live = live[worst[doc[live] - first] > j]
    return best.reshape(n, m)


def band_rows(classes: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, num): one row per text class and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 250):
                batch = whole.slice(at, 250)
                signature = superminhash(*lists_of(batch.column(1)), bands * rows)
                key = np.zeros((len(signature), bands), np.uint64)
                for r in range(rows):
                    key = mix(key * np.uint64(31) + signature[:, r::rows] + _GOLDEN)
                key = mix(key + np.arange(bands, dtype=np.uint64) * _GOLDEN)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), batch.column(0).take(pa.array(np.repeat(np.arange(len(signature)), bands)))], names=["key", "num"])

    return classes.select("num", "elements").mapInArrow(run, "key bigint, num bigint")


def _traits(classes: DataFrame) -> DataFrame:
    return classes.select("num", F.struct("n", "s0", "s1", "s2", "s3").alias("traits"))


def _may_reach(x: str, y: str, overlap: float) -> Column:
    """Whether lengths and parity sketches of two ``traits`` allow the overlap; never false for a true pair."""
    longer = F.greatest(f"{x}.n", f"{y}.n")
    common = F.ceil(longer * overlap - 1e-9)
    differ = sum((F.bit_count(F.col(f"{x}.s{i}").bitwiseXOR(F.col(f"{y}.s{i}"))) for i in range(4)), F.lit(0))
    return (F.least(f"{x}.n", f"{y}.n") >= common) & (differ <= F.col(f"{x}.n") + F.col(f"{y}.n") - 2 * common)


def candidate_pairs(banded: DataFrame, classes: DataFrame, overlap: float = OVERLAP) -> DataFrame:
    """(a, b), a < b, of classes that share a bucket; ``banded`` is a written table.

    Buckets are counted with map-side combination, and the two members of a pair come out of the count itself. Only
    larger buckets are joined back to their rows: above ``BLOCK`` members they are split into blocks that meet
    pairwise in separate tasks; none is capped. Lengths and sketches are compared inside that join.
    """
    counted = banded.groupBy("key").agg(F.count("*").alias("many"), F.min("num").alias("a"), F.max("num").alias("b")).filter("many > 1")
    counted = written(counted, "buckets")
    large = counted.filter("many > 2").select("key", F.ceil(F.col("many") / BLOCK).cast("int").alias("blocks"))
    mine = banded.join(large, "key").join(_traits(classes), "num").withColumn("block", F.pmod(F.xxhash64("num"), F.col("blocks")).cast("int"))
    mine = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    mine = mine.select("key", "num", "traits", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    x, y = mine.alias("x"), mine.alias("y")
    met = (F.col("x.key") == F.col("y.key")) & (F.col("x.low") == F.col("y.low")) & (F.col("x.high") == F.col("y.high")) & (F.col("x.num") < F.col("y.num"))
    large_pairs = x.join(y, met & _may_reach("x.traits", "y.traits", overlap)).select(F.col("x.num").alias("a"), F.col("y.num").alias("b"))
    return counted.filter("many = 2").select("a", "b").unionByName(large_pairs)


def near_enough(pairs: DataFrame, classes: DataFrame, overlap: float = OVERLAP) -> DataFrame:
    """Distinct pairs whose lengths and parity sketches allow the overlap; no true pair is lost."""
    traits = _traits(classes)
    both = pairs.distinct().join(traits.select(F.col("num").alias("a"), F.col("traits").alias("x")), "a")
    both = both.join(traits.select(F.col("num").alias("b"), F.col("traits").alias("y")), "b")
    return both.filter(_may_reach("x", "y", overlap)).select("a", "b")


def verified(pairs: DataFrame, classes: DataFrame, overlap: float = OVERLAP) -> DataFrame:
    """(a, b, overlap) of the pairs whose exact overlap reaches the threshold; ``classes`` is a written table.

    Up to ``BROADCAST_PAIRS`` pairs are broadcast to the classes, so that only elements of paired classes are shuffled.
    """
    near = written(near_enough(pairs, classes, overlap), "near")
    side = F.broadcast(near) if near.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS else near
    left = classes.select(F.col("num").alias("a"), F.col("n").alias("na"), F.col("elements").alias("ea")).join(side, "a")
    right = classes.select(F.col("num").alias("b"), F.col("n").alias("nb"), F.col("elements").alias("eb")).join(side, "b")
    share = F.size(F.array_intersect("ea", "eb")) / F.greatest("na", "nb")
    links = written(left.join(right, ["a", "b"]).select("a", "b", share.alias("overlap")).filter(F.col("overlap") >= overlap), "links")
    dropped(near)
    return links


def near_duplicates(df: DataFrame, key: str, text: str, least_words: int = LEAST_WORDS, overlap: float = OVERLAP) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (key, num) of every text of at least ``least_words`` words, links (a, b, overlap) between classes.

    Texts with the same words, in any order, are one class; so a group of exact copies of any size costs one row
    after map-side combination. Null keys, null, empty and short texts have no members. Empty input: empty results.
    """
    usable = df.select(F.col(key), F.col(text).alias("_text_of")).filter(F.col(key).isNotNull() & F.col(text).isNotNull())
    rows = written(digested(spread(usable), "_text_of", least_words), "digests")
    classes = written(class_table(rows, "_text_of", [], []), "classes")
    members = written(rows.select(key, "cls").distinct().join(classes.select("cls", "num"), "cls").select(key, "num"), "members")
    dropped(rows)
    banded = written(band_rows(classes), "bands")
    links = verified(candidate_pairs(banded, classes, overlap), classes, overlap)
    dropped(banded, classes)
    return members, links


def pairs_of_members(members: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """Distinct (a, b), a < b, of all keys whose classes are equal or linked.

    As many rows as there are pairs, for those who ask for pairs of records; :func:`groups_of_members` has one row per record.
    Members of a large class are split into blocks, so no task holds all pairs of one class.
    """
    counts = members.groupBy("num").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    m = members.join(counts, "num").withColumn("block", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int"))
    own = links.select("a", "b").unionByName(counts.select(F.col("num").alias("a"), F.col("num").alias("b")))
    a = m.select(F.col("num").alias("a"), F.col("block").alias("i"), F.col(key).alias("ka"))
    b = m.select(F.col("num").alias("b"), F.col("block").alias("j"), F.col(key).alias("kb"))
    sizes = counts.select(F.col("num").alias("b"), F.col("blocks").alias("others"))
    met = own.join(sizes, "b").join(a, "a").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("others") - 1))).join(b, ["b", "j"])
    return met.filter("ka <> kb").select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b")).distinct()


def groups_of_members(members: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """(key, group_id, n_links): group_id is the least key of the records joined by chains of links, n_links the links of the record's classes.

    A key with several texts belongs to the groups of all of them, which are then one group.
    """
    least_num = members.groupBy(key).agg(F.min("num").alias("a"))
    own = members.join(least_num, key).filter("num <> a").select("a", F.col("num").alias("b"))
    roots = connected_components(links.select("a", "b").unionByName(own), "a", "b")
    degree = links.select(F.explode(F.array("a", "b")).alias("num")).groupBy("num").agg(F.count("*").alias("n_links"))
    named = members.join(roots.withColumnRenamed("node", "num"), "num", "left").join(degree, "num", "left").select(key, F.coalesce("root", "num").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    least = named.groupBy("root").agg(F.min(key).alias("group_id"))
    return named.join(least, "root").groupBy(key).agg(F.min("group_id").alias("group_id"), F.sum("n_links").alias("n_links"))


def p4_found(spark, folder: str) -> DataFrame:
    members, links = near_duplicates(table(spark, folder, "passages"), "doc_id", "body")
    return pairs_of_members(members, links, "doc_id").select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p4_groups(spark, folder: str) -> DataFrame:
    members, links = near_duplicates(table(spark, folder, "passages"), "doc_id", "body")
    return groups_of_members(members, links, "doc_id")


QUERIES = {"p4_found": p4_found, "p4_groups": p4_groups}
_RECORDS = f"recs as (select 'passage' as kind, doc_id as id, '' as split, {words_sql('body')} as words from passages where doc_id is not null and body is not null and len({words_sql('body')}) >= {LEAST_WORDS})"
ORACLES = {
    "p4_found": f"""with {_RECORDS}, {OVERLAPS} select distinct least(ia, ib) as doc_id_a, greatest(ia, ib) as doc_id_b from pairs""",
    "p4_groups": f"""with recursive {_RECORDS}, {OVERLAPS},
edges as (select distinct ia as x, ib as y from pairs union select distinct ib, ia from pairs union select id, id from recs),
reach as (select x, y from edges union select r.x, e.y from reach r join edges e on e.x = r.y),
bagged as (select id, md5(array_to_string(list_sort(words), chr(10))) as cls from recs),
classes as (select cls, min(id) as any_id from bagged group by 1),
reprs as (select distinct b.cls, n.r from bagged b join numbered n on n.id = b.id and md5(array_to_string(list_sort(n.words), chr(10))) = b.cls),
links as (select distinct p.cls as ca, q.cls as cb from common join numbered x on x.r = ra join numbered y on y.r = rb join reprs p on p.r = ra join reprs q on q.r = rb
  where p.cls <> q.cls and c >= 8e-1 * greatest(len(x.words), len(y.words))),
degree as (select cls, count(*) as n from (select distinct ca as cls, cb as other from links union select distinct cb, ca from links) group by 1)
select g.id as doc_id, g.group_id, coalesce(l.n, 0)::bigint as n_links from (select x as id, min(y) as group_id from reach group by 1) g
  join (select id, sum(coalesce(n, 0)) as n from (select distinct id, cls from bagged) left join degree using (cls) group by 1) l using (id)""",
}
