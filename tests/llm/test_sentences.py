import itertools
import random

import numpy as np
import pytest

from fusemill.llm import sentences as S

MODEL = S.HiddenEventModel()

CASES = [
    ["Dr. Moss met Prof. Lee at 9.30 a.m. and left.", "They spoke for 3.5 hours!", "Who paid?"],
    ["“Is it ready? Then close it!” Moss shouted across the hall.", "Nobody came."],
    ['"We saw it twice. Nobody knew," said Moss.', "It ended."],
    ["(Only the gate was closed.)", "The U.N.D. office moved."],
    ["See www.example.org/a.html for version 2.7.1 of it.", "J. K. Moss wrote it."],
    ["It was ... well, a valley.", "Fine."],
    ["Man nimmt z. B. Filter oder Kessel, d. h. schwere Helme.", "Das reicht."],
    ["В 1917 г. после ремонта и т. д. ушли.", "Никто не знал."],
]


@pytest.mark.parametrize("units", CASES)
def test_clear_cases(units):
    text = " ".join(units)
    assert [text[a:b] for a, b in S.units_of(text, MODEL)] == units


def test_hard_breaks_lists_and_soft_breaks():
    text = "  A heading\n\nOne line\nwraps on. Next#tab#one. #N#1. first entry #n# 2) second<sep>no mark  "
    assert [text[a:b] for a, b in S.units_of(text, MODEL)] == ["A heading", "One line\nwraps on.", "Next#tab#one.", "1. first entry", "2) second", "no mark"]


def test_scripts_without_spaces():
    text = "没有人知道。来了！“我们等。没到。”他说。"
    assert [text[a:b] for a, b in S.units_of(text, MODEL)] == ["没有人知道。", "来了！", "“我们等。没到。”他说。"]
    thai = "ชาวเฟน ราคา 80 บาท ดี"
    assert [thai[a:b] for a, b in S.units_of(thai, MODEL)] == ["ชาวเฟน", "ราคา 80 บาท", "ดี"]


def test_units_cover_all_but_blanks(spark):
    texts = [" ".join(c) for c in CASES] * 30
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(900, None, 1), (901, "", 1), (902, " \n\n #r# ", 1), (903, "x" * 200_000, 1), (904, "\U0001f600 ok. \U0001f600 Then.", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, unit int").repartition(4)
    got = {}
    for r in S.sentence_units(df, "doc_id", "text").collect():
        got.setdefault(r.doc_id, []).append((r.start_char, r.end_char))
    assert set(got) == {*range(len(texts)), 903, 904}
    for i, t, _ in rows:
        last = 0
        for a, b in sorted(got.get(i, [])):
            assert last <= a < b and t[a:b] == t[a:b].strip() and not t[last:a].strip()
            last = b
    right = sum([texts[i][a:b] for a, b in sorted(got[i])] == CASES[i % len(CASES)] for i in range(len(texts)))
    assert right / len(texts) > 0.95


def test_empty(spark):
    assert S.sentence_units(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text").count() == 0


def rows_of(text):
    out = []
    for k, (a, b) in enumerate(S.blocks_of(text)):
        S.sites_of(text, a, b, k, S.Codes(), out)
    return np.array(out, np.int64).reshape(-1, len(S.COLUMNS))


def counted(model, rows):
    f = model.features(rows)
    return S.HiddenEventModel(model.known, model.short, model.ngram_counts(f, model.posteriors(f)).astype(np.float32))


def test_every_site_has_a_posterior_and_chains_agree_with_sums_over_all_events():
    rows = rows_of("We met J. K. Moss there. Yes. No. Nobody came. " * 5)
    model = counted(S.HiddenEventModel(), rows)
    f = model.features(rows)
    p = model.posteriors(f)
    assert len(p) == len(rows) and ((p > 0) & (p < 1)).all() and f["near"].any()
    # brute force over all event sequences of the first linked sites
    first = int(np.flatnonzero(f["near"])[0]) - 1
    last = first + 1
    while last < len(rows) and f["near"][last]:
        last += 1
    alone = {k: v.copy() for k, v in f.items()}
    alone["near"][:] = 0
    e = lambda name, back: np.clip(model._ratio(f[name + "s"], f[name], back, 8.0), 0.002, 0.998)
    e1 = model._ratio(f["e1s"], f["e1"], model._ratio(f["e0s"], f["e0"], f["guess"], 200.0), 20.0)
    plain, again, single = e("e2", e1), e("h2", e1), model.posteriors(alone)
    odds = single / (1 - single) * (1 - plain) / plain
    total = np.zeros(last - first)
    whole = 0.0
    for events in itertools.product((0, 1), repeat=last - first):
        weight = 1.0
        for k, event in enumerate(events):
            q = again[first + k] if k and events[k - 1] else plain[first + k]
            weight *= q * odds[first + k] if event else 1 - q
        whole += weight
        total += weight * np.array(events)
    assert np.allclose(total / whole, p[first:last], atol=1e-6)


def test_training_learns_abbreviations_that_no_list_has(spark):
    rnd = random.Random(2)
    names, verbs = ["Weber", "Moss", "Lindt", "Arno", "Keller", "Tamm"], ["saw", "took", "sold", "left"]
    said, want = [], []
    for _ in range(400):
        units = [f"{rnd.choice(['The', 'Some', 'No'])} boat {rnd.choice(verbs)} blk. {rnd.choice(['seven', '12', 'four', *names])} of {rnd.choice(names)}." for _ in range(3)]
        units.insert(1, f"They {rnd.choice(verbs)} it.")
        said.append(" ".join(units))
        want.append(units)
    df = spark.createDataFrame(list(enumerate(said)), "doc_id bigint, text string")
    got = {}
    for r in S.sentence_units(df, "doc_id", "text").orderBy("doc_id", "unit").collect():
        got.setdefault(r.doc_id, []).append(said[r.doc_id][r.start_char : r.end_char])
    trained = sum(got[i] == w for i, w in enumerate(want))
    untrained = sum([t[a:b] for a, b in S.units_of(t, MODEL)] == w for t, w in zip(said, want))
    assert trained > 390 and untrained < 250


def test_long_blocks_take_linear_time():
    import time

    began = time.perf_counter()
    text = "(((“ " * 20_000 + '"Go on. Stop!" he said. ' * 20_000 + "» ) ”" * 20_000
    units = S.units_of(text, MODEL)
    assert units and time.perf_counter() - began < 30


EVERYWHERE = [
    ["เขาใช้", "Python", "แล้ว", "Moss", "ดี"],
    ["เขามา", "(ดี!)", "ครับ"],
    ["یہ ایک کتاب ہے۔", "وہ آیا۔", "ختم"],
    ["Սա գիրք է։", "Նա եկավ։", "Վերջ։"],
    ["Τι είναι;", "Δεν ξέρω;", "Καλά."],
    ["ይህ መጽሐፍ ነው።", "እሺ።"],
    ["(It was late.", "Nobody came.)", "Then it rained."],
    ["He left (why? Nobody knows) at noon.", "It ended."],
    ["(He said “Go. Now.” and left.", "Then it rained.)", "It ended."],
]


@pytest.mark.parametrize("units", EVERYWHERE)
def test_candidates_in_every_script_and_place(units):
    text = " ".join(units)
    assert [text[a:b] for a, b in S.units_of(text, MODEL)] == units


def test_lost_spaces_and_marks_in_scripts_without_case():
    for units in (["没有人知道.", "来了.", "我们等."], ["价格三.五元。", "来了．", "没到．"], ["これ｡", "それ｡"], ["갔다.", "그는 왔다."], ["वह आया.", "वह जाता.", "डॉ.राम यहाँ।"]):
        text = "".join(units)
        assert [text[a:b] for a, b in S.units_of(text, MODEL)] == units


def test_all_words_are_counted_wherever_they_stand(spark):
    texts = ["The old boat went far beyond every quiet harbour of the north and came back. Nobody saw it.", "No mark in this line at all"] * 20
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    model = S.train(S.written(S.site_table(df), "sites"))
    count = lambda *ngram: float(min(model.counts[S._slots(*[x if i == 0 else np.array([x], np.int64) for i, x in enumerate(ngram)])[:, 0]]))
    codes = S.Codes()
    assert count(7, 0) == 20 * (18 + 7)
    assert [count(8, 0, codes[w]) for w in ("boat", "quiet", "back", "Nobody", "mark", "all")] == [20] * 6
    # neighbours, but not across a site
    assert [count(9, 0, codes[a], codes[b]) for a, b in (("old", "boat"), ("beyond", "every"), ("this", "line"), ("back", "Nobody"))] == [20, 20, 20, 0]


def test_words_of_a_stream_are_counted_alike_in_any_pieces(monkeypatch):
    out, stream = [], []
    text = "We met J. K. Moss there. Yes. No.\n\nเขามา แล้ว\n\nNobody came (why? who knows) at all."
    for k, (a, b) in enumerate(S.blocks_of(text)):
        S.sites_of(text, a, b, k, S.Codes(), out, stream)
    whole = MODEL.word_counts(np.array(stream, np.int64))
    monkeypatch.setattr(S, "PIECE", 3)
    assert whole.sum() > 0 and (whole == MODEL.word_counts(np.array(stream, np.int64))).all()
