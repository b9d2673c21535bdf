"""References to records that do not exist (at their own time).

References are pre-aggregated per key and month. A month that lies wholly inside or outside the validity of its key is settled
by its count; only months on a border are looked at row by row. Skew-aware split: the few heavy keys, those with a fixed share
of the references, are checked against a broadcast table, all other keys by a shuffled anti-join; both results are united.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fusemill.runtime import table, written

#: A key with at least this share of all references is heavy, so there are never more than 100 heavy keys.
HEAVY_SHARE = 0.01
#: At most so many validity spans of heavy keys are broadcast (about 10 MB); beyond it every key is shuffled.
BROADCAST_SPANS = 200_000


def ordinal(text: Column) -> Column:
    """A row ordinal in any spelling (blanks around it, plus sign, leading zeros, ``.0``) as bigint; else null."""
    digits = F.regexp_extract(text, r"^[\s\p{Z}]*\+?0*([0-9]{1,18})(?:\.0*)?[\s\p{Z}]*$", 1)
    return F.when(digits != "", digits.cast("long"))


def references_of(df: DataFrame, name: str, row_id: str, field: str, target: str, at: str) -> DataFrame:
    """(table_name, row_id, field_name, target, key, at) of one referring column; null references refer to nothing."""
    return df.select(F.lit(name).alias("table_name"), F.col(row_id).alias("row_id"), F.lit(field).alias("field_name"), F.lit(target).alias("target"), F.col(field).alias("key"), F.col(at).alias("at")).filter("key is not null")


def validity_spans(targets: DataFrame) -> DataFrame:
    """(target, key, valid_from, valid_to) reduced to one row per end: the earliest start decides."""
    return targets.filter("key is not null and valid_from is not null").groupBy("target", "key", "valid_to").agg(F.min("valid_from").alias("valid_from"))


REFERENCE = ["table_name", "field_name", "target", "key", "period"]


def per_key_and_period(refs: DataFrame) -> DataFrame:
    """(table_name, field_name, target, key, period, n, first_at, last_at): map-side combined per referring column, key and month (null where the reference has no time)."""
    month = F.date_trunc("month", "at").alias("period")
    return refs.groupBy("table_name", "field_name", "target", "key", month).agg(F.count("*").alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def _on(a: str, b: str, columns: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns))


def _verdicts(months: DataFrame, spans: DataFrame) -> DataFrame:
    """``months`` that hold orphans or may: ``dead`` where no span of the key touches the month's references."""
    m, s = months.alias("m"), spans.alias("s")
    reaches = (F.col("s.valid_from") <= F.col("m.last_at")) & (F.col("s.valid_to").isNull() | (F.col("m.first_at") < F.col("s.valid_to")))
    holds = (F.col("s.valid_from") <= F.col("m.first_at")) & (F.col("s.valid_to").isNull() | (F.col("m.last_at") < F.col("s.valid_to")))
    touched = m.join(s, (F.col("m.target") == F.col("s.target")) & (F.col("m.key") == F.col("s.key")) & reaches, "left")
    out = touched.groupBy(*[F.col(f"m.{c}") for c in REFERENCE]).agg(F.max("m.n").alias("n"), F.coalesce(F.max(holds), F.lit(False)).alias("alive"), F.count("s.target").alias("spans"))
    return out.filter("not alive").select(*REFERENCE, "n", (F.col("spans") == 0).alias("dead"))


def _unmatched(refs: DataFrame, spans: DataFrame) -> DataFrame:
    r, s = refs.alias("r"), spans.alias("s")
    alive = (F.col("s.valid_from") <= F.col("r.at")) & (F.col("s.valid_to").isNull() | (F.col("r.at") < F.col("s.valid_to")))
    return r.join(s, (F.col("r.target") == F.col("s.target")) & (F.col("r.key") == F.col("s.key")) & alive, "left_anti")


class _Split:
    """The months of all references with their verdicts, light keys and heavy keys apart."""

    def __init__(self, refs: DataFrame, targets: DataFrame, heavy_share: float):
        spans = validity_spans(targets)
        self.months = written(per_key_and_period(refs), "months")
        total = self.months.agg(F.sum("n")).first()[0] or 0
        per_key = self.months.groupBy("target", "key").agg(F.sum("n").alias("n"))
        heavy = written(per_key.filter(F.col("n") >= F.lit(max(heavy_share * total, 1.0))).select("target", "key"), "heavy_keys")
        heavy_spans = written(spans.join(F.broadcast(heavy), ["target", "key"], "left_semi"), "heavy_spans")
        if heavy_spans.limit(BROADCAST_SPANS + 1).count() > BROADCAST_SPANS:
            heavy, heavy_spans = heavy.limit(0), heavy_spans.limit(0)
        # (references of these keys, their spans): a heavy key's side is small by its share, the light side is shuffled
        hot, cold = F.broadcast(heavy), spans.join(F.broadcast(heavy), ["target", "key"], "left_anti")
        self.parts = []
        for how, near in (("left_semi", F.broadcast(heavy_spans)), ("left_anti", cold)):
            verdicts = written(_verdicts(self.months.join(hot, ["target", "key"], how), near), "verdicts")
            self.parts.append((verdicts, near, how == "left_semi"))

    def rows(self, refs: DataFrame, dead_too: bool) -> DataFrame:
        """The orphans among ``refs`` of months on a border, with ``dead_too`` also those of months without any span."""
        dated = refs.withColumn("period", F.date_trunc("month", "at"))
        out = []
        for verdicts, near, heavy in self.parts:
            # verdicts of heavy keys: at most one per column, heavy key and month
            v = F.broadcast(verdicts) if heavy else verdicts
            flagged = dated.alias("d").join(v.alias("v"), _on("d", "v", REFERENCE)).select("d.*", "v.dead")
            border = _unmatched(flagged.filter("not dead"), near)
            out.append(border.unionByName(flagged.filter("dead")) if dead_too else border)
        return out[0].unionByName(out[1])


def find_orphans(refs: DataFrame, targets: DataFrame, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """References without a target row alive at their time: valid_from <= at and (valid_to null or at < valid_to).

    ``refs`` as from :func:`references_of`, ``targets`` (target, key, valid_from, valid_to). Returns distinct
    (table_name, row_id, field_name, at). Null keys are no references; a reference without a time is an orphan
    (nothing is alive then); a null row_id is reported as null; repeated rows count once; empty targets make every
    reference an orphan; empty references give an empty result. Extra columns are ignored.
    """
    return _Split(refs, targets, heavy_share).rows(refs, True).select("table_name", "row_id", "field_name", "at").distinct()


def orphan_report(refs: DataFrame, targets: DataFrame, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """(table_name, field_name, period, n_references, n_orphans): distinct references and orphans per table and month.

    The counts of months without any span and those of border rows, of heavy and of light keys, are added up.
    """
    one = written(refs.select("table_name", "row_id", "field_name", "target", "key", "at").distinct(), "references")
    split = _Split(one, targets, heavy_share)
    per = ["table_name", "field_name", "period"]
    counts = [split.months.select(*per, F.col("n").alias("n_references"), F.lit(0).cast("long").alias("n_orphans"))]
    counts += [v.filter("dead").select(*per, F.lit(0).cast("long").alias("n_references"), F.col("n").alias("n_orphans")) for v, _, _ in split.parts]
    counts.append(split.rows(one, False).select(*per, F.lit(0).cast("long").alias("n_references"), F.lit(1).cast("long").alias("n_orphans")))
    return reduce(DataFrame.unionByName, counts).groupBy(*per).agg(F.sum("n_references").alias("n_references"), F.sum("n_orphans").alias("n_orphans"))


def retrieval_references(spark, folder: str) -> tuple[DataFrame, DataFrame]:
    """The references and targets of the retrieval tables."""
    qrels, ids, vectors = (table(spark, folder, t) for t in ("qrels_test", "idmapping", "doc_vectors"))
    ids_at = ids.select(ordinal(F.col("row_idx")).alias("key"), F.col("mapped_at").alias("valid_from"))
    refs = [
        references_of(qrels, "qrels_test", "qrel_id", "qid", "queries", "judged_at"),
        references_of(qrels, "qrels_test", "qrel_id", "pid", "passages", "judged_at"),
        references_of(ids, "idmapping", "map_id", "doc_id", "passages", "mapped_at"),
        references_of(vectors, "doc_vectors", "vec_id", "row_idx", "idmapping", "encoded_at"),
    ]
    targets = [
        table(spark, folder, name).select(F.lit(name).alias("target"), F.col(key).alias("key"), F.col("loaded_at").alias("valid_from"), F.col("deleted_at").alias("valid_to"))
        for name, key in (("queries", "qid"), ("passages", "doc_id"))
    ] + [ids_at.select(F.lit("idmapping").alias("target"), "key", "valid_from", F.lit(None).cast("timestamp_ntz").alias("valid_to"))]
    return reduce(DataFrame.unionByName, refs), reduce(DataFrame.unionByName, targets)


def p3_found(spark, folder: str) -> DataFrame:
    refs, targets = retrieval_references(spark, folder)
    return find_orphans(refs, targets).select("table_name", "row_id", "field_name").distinct()


def p3_report(spark, folder: str) -> DataFrame:
    refs, targets = retrieval_references(spark, folder)
    return orphan_report(refs, targets)


_CASES = f"""
with ords as (select try_cast(trim(row_idx) as bigint) as ord, mapped_at from idmapping),
refs as (
  select 'qrels_test' as table_name, qrel_id as row_id, 'qid' as field_name, judged_at as t, qid is not null as given,
    exists (select 1 from queries x where x.qid = r0.qid and x.loaded_at <= r0.judged_at and (x.deleted_at is null or r0.judged_at < x.deleted_at)) as ok from qrels_test r0
  union all select 'qrels_test', qrel_id, 'pid', judged_at, pid is not null,
    exists (select 1 from passages x where x.doc_id = r0.pid and x.loaded_at <= r0.judged_at and (x.deleted_at is null or r0.judged_at < x.deleted_at)) from qrels_test r0
  union all select 'idmapping', map_id, 'doc_id', mapped_at, doc_id is not null,
    exists (select 1 from passages x where x.doc_id = r0.doc_id and x.loaded_at <= r0.mapped_at and (x.deleted_at is null or r0.mapped_at < x.deleted_at)) from idmapping r0
  union all select 'doc_vectors', vec_id, 'row_idx', encoded_at, row_idx is not null,
    exists (select 1 from ords x where x.ord = r0.row_idx and x.mapped_at <= r0.encoded_at) from doc_vectors r0)
"""

QUERIES = {"p3_found": p3_found, "p3_report": p3_report}
ORACLES = {
    "p3_found": _CASES + "select distinct table_name, row_id, field_name from refs where given and not ok",
    "p3_report": _CASES
    + """select table_name, field_name, date_trunc('month', t)::timestamp as period, count(*) as n_references, count(*) filter (where not ok) as n_orphans
from (select distinct table_name, row_id, field_name, t, ok from refs where given) group by 1, 2, 3""",
}
