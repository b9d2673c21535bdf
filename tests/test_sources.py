import json
import struct

import numpy as np
from pyspark.sql import functions as F

from fusemill.functions.text import terms
from fusemill.operators import index
from fusemill.sources import binary, readers
from fusemill.streaming import postings


def test_text_formats(spark, tmp_path):
    corpus = tmp_path / "corpus"
    corpus.mkdir()
    (corpus / "part-0").write_text("u\ten\t1\tt\tb\n\nu\ten\t2\tt\n a\tb\tc\td\te\tf\n")
    (corpus / "part-1").write_text("v\tde\t3\tx\ty z\n")
    assert sorted(r.doc_id for r in readers.corpus_tsv(spark, str(corpus)).collect()) == ["1", "3"]
    assert sorted(r.n_lines for r in readers.line_counts(spark, str(corpus)).collect()) == [1, 4]
    (tmp_path / "q.tsv").write_text('7\ta "quoted\ten\n')
    assert tuple(readers.query_tsv(spark, str(tmp_path / "q.tsv")).first()) == (7, 'a "quoted', "en")
    (tmp_path / "qrels.tsv").write_text("1\t0\t5\t1\n1\t0\t4\t1\n1\t0\t5\t1\n")
    assert [tuple(r) for r in readers.qrels_grouped(readers.qrels_tsv(spark, str(tmp_path / "qrels.tsv"))).collect()] == [(1, [4, 5])]
    (tmp_path / "s.jsonl").write_text('{"text_id": 1, "text": [3, 4], "value": [0.5, 2]}\n{"text_id": 2, "text": [3]}\n')
    assert [tuple(r) for r in readers.sparse_queries(spark, str(tmp_path / "s.jsonl")).collect()] == [(1, [3, 4], [0.5, 2.0]), (2, [3], None)]
    (tmp_path / "clusters.txt").write_text("1,2\n\n2, 3,\n")
    assert sorted(map(tuple, readers.cluster_file(spark, str(tmp_path / "clusters.txt")).collect())) == [(0, 1), (0, 2), (2, 2), (2, 3)]
    (tmp_path / "ids.json").write_text(json.dumps({"0": 10, "1": 20}))
    assert sorted(map(tuple, readers.id_map_json(spark, str(tmp_path / "ids.json")).collect())) == [(0, 10), (1, 20)]


def test_sparse_query_round_trip(spark, tmp_path):
    w = spark.createDataFrame([(1, 3, 0.5), (1, 4, 2.0), (2, 9, 1.0)], "qid bigint, term_id bigint, weight double")
    readers.write_sparse_queries(w, str(tmp_path / "out"))
    assert sorted((r.text_id, r.text, r.value) for r in readers.sparse_queries(spark, str(tmp_path / "out")).collect()) == [(1, [4, 3], [2.0, 0.5]), (2, [9], [1.0])]


def test_matrix_files(spark, tmp_path):
    path = str(tmp_path / "m.fbin")
    x = np.arange(30, dtype=np.float32).reshape(10, 3)
    with open(path, "wb") as f:
        f.write(struct.pack("<ii", *x.shape) + x.tobytes())
    binary.register(spark)
    rows = spark.read.format("fbin").option("path", path).option("rowsPerTask", 4).load().orderBy("row_idx").collect()
    assert [r.vector for r in rows] == x.tolist() and [r.row_idx for r in rows] == list(range(10))
    some = spark.read.format("fbin").option("path", path).option("start", 2).option("count", 3).load().orderBy("row_idx").collect()
    assert [r.row_idx for r in some] == [2, 3, 4] and some[0].vector == x[2].tolist()
    out = str(tmp_path / "copy.fbin")
    binary.write_matrix(spark.read.format("fbin").option("path", path).load().repartition(3), out)
    assert open(out, "rb").read() == open(path, "rb").read()
    ids = str(tmp_path / "i.ibin")
    binary.write_matrix(spark.createDataFrame([(0, [7]), (1, [8])], "row_idx bigint, vector array<int>"), ids, "ibin")
    assert [r.vector for r in spark.read.format("ibin").option("path", ids).load().orderBy("row_idx").collect()] == [[7], [8]]


def test_binary_postings(spark, tmp_path):
    post = spark.createDataFrame([(1, 5, 0.5), (1, 6, 1.5), (2, 5, 2.0)], "term bigint, doc_id bigint, weight double")
    path = str(tmp_path / "index")
    assert binary.write_postings(index.packed(post, chunk=1).withColumnRenamed("term", "term_id"), path, 2) >= 1
    assert sorted(map(tuple, binary.postings_table(spark, path).collect())) == [(1, 5, 0.5), (1, 6, 1.5), (2, 5, 2.0)]
    raw = struct.pack("<II", 1, 9) + struct.pack("<II", 7, 8) + np.array([1, 2], "<i4").tobytes() + struct.pack("<I", 8) + np.array([0.5, 1], "<f4").tobytes()
    (tmp_path / "one.bin").write_bytes(raw)
    assert sorted(map(tuple, binary.postings_table(spark, str(tmp_path / "one.bin")).collect())) == [(7, 1, 0.5), (7, 2, 1.0)]


def test_binary_record_layouts(spark, tmp_path):
    rows = spark.createDataFrame([(4, [3], None), (2, [1, 2], [0.5, 2.0]), (9, [], [])], "key bigint, ids array<int>, values array<double>")
    got = {}
    for layout in binary.LAYOUTS:
        path = str(tmp_path / layout)
        binary.write_records(rows.coalesce(1), path, layout)
        got[layout] = sorted((r.part, r.place, r.key, r.ids, r["values"]) for r in binary.read_records(spark, path, layout).collect())
    assert [(r[2], r[3], r[4]) for r in got["postings"]] == [(2, [1, 2], [0.5, 2.0]), (4, [3], [1.0]), (9, [], [])]
    assert [(r[3], r[4]) for r in got["weights"]] == [([1, 2], [0.5, 2.0]), ([3], [1.0]), ([], [])]
    assert [(r[2], r[3], r[4]) for r in got["lists"]] == [(r[2], r[3], r[4]) for r in got["groups"]] == [(2, [1, 2], None), (4, [3], None), (9, [], None)]
    binary.write_records(rows.limit(0), str(tmp_path / "none"), "lists")


def test_lines_are_numbered_across_splits(spark, tmp_path):
    (tmp_path / "lines.txt").write_text("".join(f"line {i}\n" for i in range(500)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = readers.numbered_lines(spark, str(tmp_path / "lines.txt")).collect()
        assert sorted((r.line, r.value) for r in rows) == [(i, f"line {i}") for i in range(500)]
        (tmp_path / "ids.json").write_text(json.dumps({str(i): i * 7 for i in range(400)}))
        assert {r.row_idx: r.doc_id for r in readers.id_map_json(spark, str(tmp_path / "ids.json")).collect()} == {i: i * 7 for i in range(400)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_tables_are_deleted(spark):
    import os

    from fusemill import runtime

    one, two = runtime.written(spark.range(5), "one"), runtime.written(spark.range(6), "two")
    folder = runtime.shared_dir(spark).removeprefix("file://")
    assert one.count() + two.count() == 11
    runtime.dropped(one, spark.range(3))
    left = os.listdir(folder)
    assert not any(x.startswith("one-") for x in left) and any(x.startswith("two-") for x in left)


def test_index_layout(spark, tmp_path):
    post = spark.createDataFrame([(t, d, 1.0) for t in "cab" for d in (2, 1)], "term string, doc_id bigint, weight double")
    index.save(post, str(tmp_path / "idx"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "idx")).collect())) == sorted(map(tuple, post.collect()))


def test_stream_equals_batch(spark, tmp_path):
    schema, docs = "doc_id bigint, text string", [(1, "a b"), (2, "a"), (3, "c c")]
    src, target = str(tmp_path / "src"), str(tmp_path / "idx")
    for part in (docs[:2], docs[2:]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(src)
        postings.append_term_frequencies(spark, src, schema, "doc_id", terms(F.col("text")), target, str(tmp_path / "ckpt")).awaitTermination()
    tok = index.tokens(spark.createDataFrame(docs, schema), "doc_id", terms(F.col("text")))
    want = sorted((r.term, r.doc_id, round(r.weight, 9)) for r in index.postings(tok, index.term_frequencies(tok)).collect())
    assert sorted((r.term, r.doc_id, round(r.weight, 9)) for r in postings.current_postings(spark, target).collect()) == want
