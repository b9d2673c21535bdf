"""Sources and sinks as queries: each writes a table in a file format of the engine, reads it back and gives rows that SQL can compare."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusemill.functions import text
from fusemill.operators import encoders, index, sparse
from fusemill.operators.ranking import running_total, top_k
from fusemill.plans import catalog as c
from fusemill.runtime import scratch, table, written
from fusemill.sources import binary, readers

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


def _clean(column: str):
    return F.coalesce(text.clean_text(F.col(column)), F.lit(""))


def _clean_sql(column: str) -> str:
    return f"coalesce({c._clean_sql(column)}, '')"


# ---- text formats ---------------------------------------------------------------------------------------------------------


def _corpus_lines(spark, d: str) -> str:
    """The corpus as tab-separated lines in several files, with blank and malformed lines among them."""
    path = scratch(spark, "corpus_tsv")
    lines = c.corpus(spark, d).select(F.concat_ws("\t", _clean("url"), F.coalesce("lang", F.lit("")), F.col("doc_id").cast("string"), _clean("title"), _clean("body")).alias("value"))
    broken = c.corpus(spark, d).select(F.explode(F.array(F.lit(""), F.concat(F.lit("four\tfields\there\t"), F.col("doc_id").cast("string")), F.lit("one\ttwo\tthree\tfour\tfive\tsix"))).alias("value"))
    lines.unionByName(broken).write.text(path)
    return path


_LINES = f"{c._BASE}, fields as (select {_clean_sql('url')} as url, coalesce(lang, '') as lang, doc_id, {_clean_sql('title')} as title, {_clean_sql('body')} as body from corpus)"


@_query("source_corpus_tsv", f"with {_LINES} select doc_id, lang as language, length(title) as title_chars, length(body) as body_chars from fields where url <> '' and body <> ''")
def _(spark, d):
    # the ends of a line are trimmed, so a line whose first or last field is empty has fewer than five fields
    rows = readers.corpus_tsv(spark, _corpus_lines(spark, d))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "language", F.length("title").cast("long").alias("title_chars"), F.length("body").cast("long").alias("body_chars"))


@_query("source_line_counts", f"with {c._BASE} select 4 * count(*) as n_lines, true as several_files from corpus")
def _(spark, d):
    counts = readers.line_counts(spark, _corpus_lines(spark, d))
    return counts.agg(F.sum("n_lines").alias("n_lines"), (F.count("*") > 1).alias("several_files"))


@_query("source_query_tsv", f"with {c._BASE} select qid, {_clean_sql('text')} as text, 'en' as lang from qtexts")
def _(spark, d):
    path = scratch(spark, "queries_tsv")
    c.query_texts(spark, d).select(F.concat_ws("\t", F.col("qid").cast("string"), _clean("text"), F.lit("en")).alias("value")).write.text(path)
    return readers.query_tsv(spark, path)


def _coded_queries(spark, d: str) -> DataFrame:
    """(qid, term_id, weight) with the ordinals of the queries' own terms."""
    q = written(c._queries(spark, d), "query_terms")
    return q.join(index.term_ids(q), "term").select("qid", "term_id", "weight")


_CODED = f"{c._BASE}, ids as (select term, row_number() over (order by term) - 1 as term_id from (select distinct term from qterms)), coded as (select qid, term_id, weight from qterms join ids using (term))"


@_query("source_sparse_queries", f"with {_CODED} select qid, term_id as term, case when qid % 2 = 0 then weight * 0.5e0 else 1e0 end as weight from coded")
def _(spark, d):
    path = scratch(spark, "sparse_queries")
    readers.write_sparse_queries(_coded_queries(spark, d).withColumn("weight", F.col("weight") * 0.5), path)
    read = readers.sparse_queries(spark, path).withColumn("value", F.when(F.pmod("text_id", F.lit(2)) == 0, F.col("value")))  # odd queries come without weights
    return sparse.weighted_queries(read, "text_id", "text", "value")


@_query("source_qrels_tsv", f"with {c._BASE} select qid, count(*) as n, array_to_string(list_sort(list(doc_id)), ',') as pids from judged group by 1")
def _(spark, d):
    path = scratch(spark, "qrels_tsv")
    rows = table(spark, d, "qrels_test").filter("qid is not null and pid is not null")
    rows.select("qid", F.lit("0").alias("ignored"), "pid", F.lit("1").alias("relevance")).write.csv(path, sep="\t")
    grouped = readers.qrels_grouped(readers.qrels_tsv(spark, path))
    return grouped.select("qid", F.size("pids").cast("long").alias("n"), F.array_join("pids", ",").alias("pids"))


@_query("source_json_folder", f"with {_CODED} select qid as text_id, count(*) as n from coded group by 1")
def _(spark, d):
    path = scratch(spark, "json_folder")
    readers.write_sparse_queries(_coded_queries(spark, d), path)
    spark.range(10).selectExpr("-id as text_id").write.mode("append").option("compression", "none").csv(path)  # other files of the folder are left alone
    rows = readers.json_files(spark, path, "text_id bigint, text array<bigint>")
    return rows.select("text_id", F.size("text").cast("long").alias("n"))


_HEADS = f"{c._EMB}, numbered as (select doc_id, row_number() over (order by doc_id) - 1 as place from emb)"


@_query("source_cluster_file", f"with {_HEADS} select place // 16 as cluster_id, doc_id from numbered where (place // 16) % 5 <> 2")
def _(spark, d):
    path = scratch(spark, "clusters")
    placed = running_total(c._emb(spark, d).select("doc_id", F.lit(0).alias("g")), ["g"], "doc_id", F.lit(1), "n").select("doc_id", F.floor((F.col("n") - 1) / 16).alias("cluster_id"))
    lines = placed.groupBy("cluster_id").agg(F.array_join(F.array_sort(F.collect_list("doc_id")), ", ").alias("line"))
    lines = lines.select("cluster_id", F.when(F.pmod("cluster_id", F.lit(5)) == 2, "").otherwise(F.col("line")).alias("line"))  # some clusters are empty
    lines.coalesce(1).sortWithinPartitions("cluster_id").select("line").write.text(path)
    return readers.cluster_file(spark, path)


@_query("source_id_map", f"with {_HEADS} select place as row_idx, doc_id * 3 as doc_id from numbered")
def _(spark, d):
    path = scratch(spark, "id_map")
    placed = running_total(c._emb(spark, d).select("doc_id", F.lit(0).alias("g")), ["g"], "doc_id", F.lit(1), "n").withColumn("at", F.col("n") - 1)
    pair = F.concat(F.when(F.col("at") == 0, F.lit("{")).otherwise(F.lit("")), F.lit('"'), F.col("at").cast("string"), F.lit('": '), (F.col("doc_id") * 3).cast("string"))
    placed.coalesce(1).sortWithinPartitions("at").select(pair.alias("value")).write.option("lineSep", ", ").text(path)
    return readers.id_map_json(spark, path)


# ---- Parquet stores -------------------------------------------------------------------------------------------------------


@_query("source_embedding_pieces", f"with {c._EMB} select doc_id, round(v[1], 6) as first, round(list_sum(v), 4) as total from emb")
def _(spark, d):
    e = c._emb(spark, d)
    paths = [scratch(spark, f"embeddings_{i}") for i in range(3)]
    for i, path in enumerate(paths):
        readers.write_embeddings(e.filter(F.pmod("doc_id", F.lit(3)) == i), path)
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return readers.embedding_pieces(spark, paths).select("doc_id", F.round(F.element_at("vector", 1).cast("double"), 6).alias("first"), F.round(total, 4).alias("total"))


@_query("source_training_examples", f"with {c._BASE} select qid, count(*) as n_positives, min(doc_id) as first from judged group by 1")
def _(spark, d):
    path = scratch(spark, "examples")
    grouped = c.judged(spark, d).groupBy("qid").agg(F.array_sort(F.collect_list("doc_id")).alias("positives")).withColumn("negatives", F.array().cast("array<bigint>"))
    for half in (0, 1):
        grouped.filter(F.pmod("qid", F.lit(2)) == half).write.mode("append").parquet(path)
    rows = readers.training_examples_dir(spark, path)
    return rows.select("qid", F.size("positives").cast("long").alias("n_positives"), F.element_at("positives", 1).alias("first"))


@_query("sink_tokens", f"with {c._BASE}, t as (select doc_id, {c._terms_sql('url')} as u, {c._terms_sql('title')} as t, {c._terms_sql('body')} as b from corpus) select doc_id, array_to_string(u, ' ') as url, len(t) as n_title, len(b) as n_body from t where doc_id in (select doc_id from judged)")
def _(spark, d):
    path = scratch(spark, "tokens")
    fields = c._fields()
    readers.write_tokens(c.corpus(spark, d).select("doc_id", *[f.alias(n) for f, n in zip(fields, ("url", "title", "body"))]), path)
    wanted = readers.tokens_table(spark, path).join(c.judged(spark, d).select("doc_id").distinct(), "doc_id", "left_semi")
    return wanted.select("doc_id", F.array_join("url", " ").alias("url"), F.size("title").cast("long").alias("n_title"), F.size("body").cast("long").alias("n_body"))


@_query("sink_budgeted_tokens", f"{c._BUDGET_SQL} select doc_id, len(tokens) as n_tokens from budget")
def _(spark, d):
    path = scratch(spark, "budgeted")
    c.corpus(spark, d).select("doc_id", text.budgeted_tokens(*c._fields()).alias("tokens")).write.parquet(path)
    return spark.read.schema("doc_id bigint, tokens array<string>").parquet(path).select("doc_id", F.size("tokens").cast("long").alias("n_tokens"))


@_query("sink_ranking", f"with best as (select qid, doc_id, max(score)::double as score from rankings where run_id = 1 and qid is not null and score is not null and not isnan(score) and doc_id is not null group by 1, 2), {c._top_sql('best')} select qid, rank, doc_id, score from top")
def _(spark, d):
    path = scratch(spark, "ranking")
    rows = table(spark, d, "rankings").filter("run_id = 1 and qid is not null and score is not null and not isnan(score) and doc_id is not null")
    readers.write_ranking(top_k(rows.groupBy("qid", "doc_id").agg(F.max("score").cast("double").alias("score")), ["qid"], "score", "doc_id", c.K).select("qid", "rank", "doc_id", "score"), path)
    return readers.ranking_table(spark, path)


# ---- binary formats -------------------------------------------------------------------------------------------------------


def _matrix(spark, d: str) -> DataFrame:
    e = running_total(c._emb(spark, d).withColumn("g", F.lit(0)), ["g"], "doc_id", F.lit(1), "n")
    return e.select((F.col("n") - 1).cast("long").alias("row_idx"), "vector", "label")


_ROWS = f"{c._EMB}, placed as (select row_number() over (order by doc_id) - 1 as row_idx, v, label from emb)"


@_query("source_fbin", f"with {_ROWS} select row_idx, round(v[1], 6) as first, round(list_sum(v), 4) as total from placed")
def _(spark, d):
    path = scratch(spark, "matrix") + ".fbin"
    binary.write_matrix(_matrix(spark, d), path)
    read = spark.read.format("fbin").option("path", path).option("rowsPerTask", 500).load()
    return read.select("row_idx", F.round(F.element_at("vector", 1).cast("double"), 6).alias("first"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@_query("source_fbin_range", f"with {_ROWS} select row_idx, round(v[64], 6) as last from placed where row_idx between 100 and 149")
def _(spark, d):
    path = scratch(spark, "matrix") + ".fbin"
    binary.write_matrix(_matrix(spark, d), path)
    read = spark.read.format("fbin").option("path", path).option("start", 100).option("count", 50).load()
    return read.select("row_idx", F.round(F.element_at("vector", -1).cast("double"), 6).alias("last"))


@_query("source_ibin", f"with {_ROWS} select row_idx, label::int as label, (row_idx % 100)::int as place from placed")
def _(spark, d):
    path = scratch(spark, "matrix") + ".ibin"
    rows = _matrix(spark, d).select("row_idx", F.array(F.col("label").cast("int"), F.pmod("row_idx", F.lit(100)).cast("int")).alias("vector"))
    binary.write_matrix(rows, path, "ibin")
    read = spark.read.format("ibin").option("path", path).load()
    return read.select("row_idx", F.element_at("vector", 1).alias("label"), F.element_at("vector", 2).alias("place"))


@_query("source_binary_postings", f"with {c._post_sql()}, ids as (select term, row_number() over (order by term) - 1 as term_id from (select distinct term from post)) select term_id, count(*) as n, min(doc_id) as first, max(doc_id) as last, round(sum(weight), 2) as total from post join ids using (term) group by 1")
def _(spark, d):
    path = scratch(spark, "binary_index")
    post = written(c._postings(spark, d)[1], "postings")
    coded = post.join(index.term_ids(post), "term").select("term_id", "doc_id", "weight")
    binary.write_postings(index.packed(coded, "term_id", 2000), path, 0)
    return binary.postings_table(spark, path).groupBy("term_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.round(F.sum("weight"), 2).alias("total"))


@_query("sink_binary_queries", f"with {_CODED}, q as (select qid, count(*) as n, sum(term_id)::bigint as terms, sum(weight) as total from coded group by 1) select row_number() over (order by qid) - 1 as place, n, terms, case when qid % 2 = 0 then total else n::double end as total from q")
def _(spark, d):
    path = scratch(spark, "binary_queries")
    pairs = F.array_sort(F.collect_list(F.struct("term_id", "weight")))
    rows = _coded_queries(spark, d).groupBy(F.col("qid").alias("key")).agg(pairs.alias("p"))
    rows = rows.select("key", F.transform("p", lambda x: x["term_id"]).alias("ids"), F.when(F.pmod("key", F.lit(2)) == 0, F.transform("p", lambda x: x["weight"])).alias("values"))
    binary.write_records(rows, path, "weights")
    read = written(binary.read_records(spark, path, "weights"), "binary_rows")
    numbered = running_total(read.withColumn("g", F.lit(0)).withColumn("o", F.struct("part", "place")), ["g"], "o", F.lit(1), "n")
    return numbered.select((F.col("n") - 1).cast("long").alias("place"), F.size("ids").cast("long").alias("n"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("terms"), F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("total"))


@_query("sink_posting_dump", f"with {c._post_sql()} select doc_id, count(*) as n, round(sum(weight), 2) as total from post where term in (select term from qterms where qid = (select min(qid) from qterms)) group by 1")
def _(spark, d):
    """The postings of one query's terms, dumped record by record and read back."""
    path = scratch(spark, "posting_dump")
    q = written(c._queries(spark, d), "query_terms")
    one = q.join(F.broadcast(q.agg(F.min("qid").alias("qid"))), "qid", "left_semi")
    fetched = written(index.with_terms(c._postings(spark, d)[1], one), "fetched")
    packed = index.packed(fetched.join(index.term_ids(fetched), "term").select("term_id", "doc_id", "weight"), "term_id", 2000)
    binary.write_records(packed.select(F.col("term_id").alias("key"), F.transform("postings", lambda p: p["doc_id"]).alias("ids"), F.transform("postings", lambda p: p["weight"]).alias("values")), path, "weights")
    rows = binary.read_records(spark, path, "weights").select(F.explode(F.arrays_zip("ids", "values")).alias("p"))
    return rows.groupBy(F.col("p.ids").cast("long").alias("doc_id")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("p.values").cast("double")), 2).alias("total"))


@_query("sink_binary_tokens", f"with {_CODED} select qid, count(*) as n, min(term_id) as first from coded group by 1")
def _(spark, d):
    path = scratch(spark, "binary_tokens")
    rows = _coded_queries(spark, d).groupBy(F.col("qid").alias("key")).agg(F.array_sort(F.collect_list("term_id")).alias("ids"))
    binary.write_records(rows, path, "lists")
    read = binary.read_records(spark, path, "lists")
    return read.select(F.col("key").alias("qid"), F.size("ids").cast("long").alias("n"), F.element_at("ids", 1).cast("long").alias("first"))


@_query("sink_binary_qrels", f"with {c._BASE} select qid, array_to_string(list_sort(list(doc_id)), ',') as pids from judged group by 1")
def _(spark, d):
    path = scratch(spark, "binary_qrels")
    grouped = readers.qrels_grouped(c.judged(spark, d)).select(F.col("qid").alias("key"), F.col("pids").alias("ids"))
    binary.write_records(grouped, path, "groups")
    return binary.read_records(spark, path, "groups").select(F.col("key").alias("qid"), F.array_join("ids", ",").alias("pids"))


@_query("sink_stage_times", f"with {c._BASE} select stage, true as measured, true as mean_agrees from (select unnest(['index', 'search']) as stage)")
def _(spark, d):
    """Seconds of each stage and their mean per query, stored as a table."""
    times, path = encoders.StageTimes(), scratch(spark, "times")
    with times.stage("index"):
        post = written(c._postings(spark, d)[1], "postings")
    with times.stage("search"):
        sparse.search(c._queries(spark, d), post, c.K).write.format("noop").mode("overwrite").save()
    n = c.query_texts(spark, d).count()
    times.per_query(spark, n).write.parquet(path)
    rows = spark.read.schema("stage string, seconds double, ms_per_query double").parquet(path)
    return rows.select("stage", (F.col("seconds") > 0).alias("measured"), (F.abs(F.col("ms_per_query") * n / 1000 - F.col("seconds")) < 1e-6).alias("mean_agrees"))
