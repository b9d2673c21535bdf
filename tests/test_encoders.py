import numpy as np
import pytest

from fusemill.operators import encoders


def test_encoder_keeps_rows_and_nulls(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "b a"), (None, "")], "qid bigint, text string")
    got = {r.qid: r.vector for r in encoders.encoded(df, "qid", "text", encoders.hashed_encoder, batch=2).collect()}
    assert got[1] == got[3] and len(got) == 4 and abs(np.linalg.norm(got[1]) - 1) < 1e-6 and not any(got[2])


def test_table_function(spark):
    encoders.register_tokenize(spark)
    spark.createDataFrame([(1, "Ab, c"), (2, None), (3, "")], "id bigint, text string").createOrReplaceTempView("t")
    rows = spark.sql("SELECT t.id, w.pos, w.term FROM t, LATERAL tokenize(t.text) w ORDER BY 1, 2").collect()
    assert [tuple(r) for r in rows] == [(1, 0, "ab"), (1, 1, "c")]


def test_training_examples(spark):
    ex = spark.createDataFrame([(1, [10, 10, 99], [11, 12, 13, 10]), (2, [], [11])], "qid bigint, positives array<bigint>, negatives array<bigint>")
    q = spark.createDataFrame([(1, "q1"), (2, "q2")], "qid bigint, text string")
    p = spark.createDataFrame([(i, f"p{i}") for i in (10, 11, 12, 13)], "doc_id bigint, text string")
    got = encoders.training_examples(ex, q, p, 2).collect()
    assert [r.doc_id for r in got if r.positive] == [10]
    assert all(r.doc_id != 10 for r in got if not r.positive) and sum(r.qid == 2 for r in got) == 1


def test_hashing_search_finds_the_vector_itself(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, vector array<float>")
    found = encoders.lsh_search(docs.limit(5).withColumnRenamed("doc_id", "qid"), docs, 3, distance=5.0)
    assert {(r.qid, r.doc_id) for r in found.filter("rank = 1").collect()} == {(i, i) for i in range(5)}


def test_stage_times(spark):
    times = encoders.StageTimes()
    for _ in range(2):
        with times.stage("probe"):
            pass
    row = times.per_query(spark, 4).first()
    assert row.stage == "probe" and row.ms_per_query >= 0


def test_task_names(spark):
    tokens = spark.createDataFrame([(1, 0, 1, [1.0, 2.0]), (1, 1, 1, [3.0, 4.0])], "doc_id bigint, pos int, mask int, vector array<double>")
    logits = spark.createDataFrame([(1, 0, "a", 1.0), (1, 1, "a", 2.0)], "doc_id bigint, pos int, term string, logit double")
    out = encoders.task_outputs(" sparse,sent ,sparse", tokens, logits)
    assert list(out) == ["sparse", "sent"] and out["sent"].first().vector == [2.0, 3.0] and out["sparse"].count() == 1
    assert encoders.task_outputs("", tokens, logits) == {}
    with pytest.raises(ValueError, match="unknown task"):
        encoders.task_outputs("dense", tokens, logits)
