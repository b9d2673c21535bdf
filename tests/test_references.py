from datetime import datetime

from pyspark.sql import functions as F

from fusemill.operators import references as R

D = datetime
REFS = "table_name string, row_id bigint, field_name string, target string, key bigint, at timestamp_ntz, extra string"
TARGETS = "target string, key bigint, valid_from timestamp_ntz, valid_to timestamp_ntz, extra int"


def refs(spark, rows):
    return spark.createDataFrame([("t", i, "f", "x", k, at, "e") for i, k, at in rows], REFS)


def targets(spark, rows):
    return spark.createDataFrame([("x", *r, 1) for r in rows], TARGETS)


CASES = [(1, 10, D(2025, 1, 5)), (2, 10, D(2025, 3, 1)), (3, 11, D(2025, 1, 1)), (4, 12, D(2025, 1, 1)), (5, 10, D(2024, 12, 31)), (6, 10, None), (1, 10, D(2025, 1, 5)), (4, 12, D(2025, 1, 1)), (7, 10, D(2025, 4, 1)), (8, 13, D(2025, 6, 1))]
ALIVE = [(10, D(2025, 1, 5), D(2025, 3, 1)), (10, D(2025, 4, 1), None), (11, D(2025, 1, 1), None), (11, D(2025, 2, 1), None), (13, None, None), (None, D(2020, 1, 1), None)]


def brute(cases, alive):
    return {i for i, k, at in cases if not any(k == key and at and start and start <= at and (end is None or at < end) for key, start, end in alive)}


def test_orphans_at_their_time(spark):
    got = R.find_orphans(refs(spark, CASES), targets(spark, ALIVE))
    rows = [r.row_id for r in got.collect()]
    assert sorted(rows) == sorted(brute(CASES, ALIVE)) == [2, 4, 5, 6, 8]


def test_heavy_keys_give_the_same(spark):
    plain = R.find_orphans(refs(spark, CASES), targets(spark, ALIVE)).collect()
    heavy = R.find_orphans(refs(spark, CASES), targets(spark, ALIVE), heavy_share=0.2).collect()
    assert sorted(map(str, plain)) == sorted(map(str, heavy))


def test_months_settled_by_count_and_by_row(spark):
    import random

    rnd = random.Random(5)
    day = lambda: D(2025, rnd.randint(1, 6), rnd.randint(1, 28))
    cases = [(i, rnd.choice([1, 1, 1, 2, 3, 4, 5, 6]), rnd.choice([day(), day(), day(), None])) for i in range(400)]
    alive = []
    for key in (1, 2, 3, 4):
        for _ in range(rnd.randint(1, 4)):
            a, b = sorted((day(), day()))
            alive.append((key, a, rnd.choice([b, b, None])))
    want = brute(cases, alive)
    for share in (0.0025, 0.3, 0.9):
        got = R.find_orphans(refs(spark, cases), targets(spark, alive), share)
        assert {r.row_id for r in got.collect()} == want
        report = R.orphan_report(refs(spark, cases + cases[:50]), targets(spark, alive), share).collect()
        assert sum(r.n_orphans for r in report) == len(want) and sum(r.n_references for r in report) == 400


def test_empty_sides(spark):
    assert R.find_orphans(refs(spark, []), targets(spark, ALIVE)).count() == 0
    assert R.find_orphans(refs(spark, CASES), targets(spark, [])).count() == len({c[0] for c in CASES})


def test_report_counts_per_month(spark):
    r = refs(spark, CASES)
    out = {str(x.period): (x.n_references, x.n_orphans) for x in R.orphan_report(r, targets(spark, ALIVE)).collect()}
    assert out["2025-01-01 00:00:00"] == (3, 1) and out["None"] == (1, 1)


def test_ordinal_spellings(spark):
    df = spark.createDataFrame([(" 007",), ("7 ",), ("7",), ("+7",), ("7.0",), ("0",), ("000",), ("x7",), ("",), (None,), (" 7　",)], "s string")
    assert [r[0] for r in df.select(R.ordinal(F.col("s"))).collect()] == [7, 7, 7, 7, 7, 0, 0, None, None, None, 7]
