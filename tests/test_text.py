import re

from pyspark.sql import functions as F

from fusemill.functions import text as T

DIRTY = ["a#N#b #n#c<sep>d#tab#e#r#f\tg", "  x y　z \x0b", "", None, "\x85a\x1cb"]


def test_clean_text(spark):
    df = spark.createDataFrame([(t,) for t in DIRTY], "t string")
    got = [r[0] for r in df.select(T.clean_text(F.col("t"))).collect()]
    want = [None if t is None else " ".join(re.sub("#n#|#N#|<sep>|#tab#|#r#", " ", t).split()) for t in DIRTY]
    assert got == want


def test_clean_url(spark):
    urls = ["https://www.x.com/a b12345678", "", None, "http://site.org/page", "HTTPS://WWW.A.COM/INDEX.HTML", "abcdefg1", "short1", "   "]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(T.clean_url(F.col("u"))).collect()] == ["://.x./a", "", "", "://site.org/page", "://.a./index.", "", "short1", ""]


def test_budget_and_padding(spark):
    df = spark.createDataFrame([(["u"] * 50, ["t"] * 50, ["b"] * 200), ([], [], []), (["u"], ["t"], ["b"])], "u array<string>, t array<string>, b array<string>")
    out = [r[0] for r in df.select(T.budgeted_tokens(F.col("u"), F.col("t"), F.col("b"))).collect()]
    assert len(out[0]) == 128 and out[0].count("u") == 42 and out[0].count("t") == 41 and out[0].count("b") == 128 - 42 - 41 - 4
    assert out[1] == ["[CLS]", "[SEP]", "[SEP]", "[SEP]"] and out[2] == ["[CLS]", "u", "[SEP]", "t", "[SEP]", "b", "[SEP]"]
    p = df.select(T.padded(F.col("b"), 4).alias("p")).select("p", T.mask(F.col("p")).alias("m")).collect()
    assert p[2].p == ["b", "[PAD]", "[PAD]", "[PAD]"] and p[2].m == [1, 0, 0, 0] and len(p[0].p) == 4


def test_first_words_and_terms(spark):
    df = spark.createDataFrame([("  a b  c d ",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(T.first_words(F.col("t"), 3)).collect()] == ["a b ", None, ""]
    assert [r[0] for r in df.select(T.terms(F.col("t"))).collect()] == [["a", "b", "c", "d"], [], []]
