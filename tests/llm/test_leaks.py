import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from fusemill.llm import fmindex
from fusemill.llm.words import plain_words

ITEMS = "item_id bigint, text string, lang string, view string"
DOCS = "doc_id bigint, text string, item string"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=60), st.lists(st.lists(st.integers(1, 4), min_size=2, max_size=2), min_size=1, max_size=6))
def test_index_finds_and_locates_all(seq, phrases):
    s = np.array([*seq, 0])
    index = fmindex.FMIndex(s, 5, sample_step=4)
    low, high = index.search(np.array(phrases))
    for p, a, b in zip(phrases, low, high):
        want = [i for i in range(len(seq) - 1) if seq[i : i + 2] == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def brute(docs, items):
    out = set()
    for d, t, *_ in docs:
        w = plain_words(t or "")
        c = "".join(w)
        for i, x, lang, *_ in items:
            u = plain_words(x or "")
            if lang in ("zh", "ja"):
                u = "".join(u)
                hit = any(u[k : k + 24] in c for k in range(len(u) - 23))
            else:
                grams = {tuple(w[k : k + 12]) for k in range(len(w) - 11)}
                hit = any(tuple(u[k : k + 12]) in grams for k in range(len(u) - 11))
            if hit:
                out.add((d, i))
    return out


def case():
    rnd = random.Random(1)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rnd.choices(vocab, k=30)), "en", "v") for i in range(8)]
    han = [chr(0x4E00 + i) for i in range(80)]
    items += [(20 + i, "".join(rnd.choices(han, k=40)), "zh", "v") for i in range(4)] + [(30, None, "en", "v"), (31, "too short", "en", "v"), (32, "", None, "v")]
    docs = []
    for d in range(60):
        body = rnd.choices(vocab, k=rnd.choice([0, 5, 40, 300]))
        i, text, lang, _ = rnd.choice(items[:12])
        if lang == "en":
            w = text.split()
            n = rnd.choice([11, 12, 13, 30])
            at = rnd.randrange(len(w) - n + 1)
            body[3:3] = [x.upper() + "," for x in w[at : at + n]]
            docs.append((d, " ".join(body), "i"))
        else:
            n = rnd.choice([23, 24, 40])
            docs.append((d, " ".join(body) + "".join(c + "。" * (rnd.random() < 0.3) for c in text[:n]), "i"))
    return [*docs, (100, None, "i"), (101, "", "i"), (None, docs[0][1], "i"), (7, docs[7][1], "i")], items


def found(spark, docs, items):
    spans = fmindex.leaked_spans(spark.createDataFrame(docs, DOCS).repartition(3), "doc_id", "text", spark.createDataFrame(items, ITEMS), "item_id", "text", "lang")
    return spans.collect()


def test_leaks_against_brute_force(spark, monkeypatch):
    docs, items = case()
    want = brute([d for d in docs if d[0] is not None], items)
    for shard in (50, 300_000):
        monkeypatch.setattr(fmindex, "SHARD_UNITS", shard)
        assert {(r.doc_id, r.item_id) for r in found(spark, docs, items)} == want and want


def test_item_blocks_give_the_same(spark, monkeypatch):
    docs, items = case()
    monkeypatch.setattr(fmindex, "BLOCK_PHRASES", 20)
    assert {(r.doc_id, r.item_id) for r in found(spark, docs, items)} == brute([d for d in docs if d[0] is not None], items)


def test_spans_are_merged(spark):
    text = " ".join(f"u{i}" for i in range(20))
    rows = found(spark, [(1, "pre fix " + text + " gap " + " ".join(text.split()[:12]), "i")], [(5, text, "en", "v")])
    assert sorted((r.start, r.end) for r in rows) == [(2, 22), (23, 35)]


def test_empty_sides(spark):
    docs, items = case()
    assert found(spark, [], items) == [] and found(spark, docs, []) == []
