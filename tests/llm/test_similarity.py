import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from fusemill import runtime
from fusemill.llm import components, minhash, suffixes, words

WORDS = [f"w{i}" for i in range(400)]


def bags(texts):
    offsets, flat = words.sequences(texts, words.WordHash())
    return offsets, words.multiset(offsets, flat)


def overlap(a, b):
    x, y = Counter(words.words(a)), Counter(words.words(b))
    return sum((x & y).values()) / max(sum(x.values()), sum(y.values()), 1)


def edited(rnd, text, share):
    w = text.split()
    for _ in range(int(len(w) * share)):
        k = rnd.randrange(len(w))
        w[k] = f"new{rnd.random()}" if rnd.random() < 0.5 else w[k]
    if rnd.random() < 0.5:
        rnd.shuffle(w)
    return " ".join(w)


def corpus(seed, n=60):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        if i and rnd.random() < 0.5:
            out.append(edited(rnd, out[rnd.randrange(len(out))], rnd.choice([0, 0.05, 0.1, 0.5])))
        else:
            out.append(" ".join(rnd.choices(WORDS, k=rnd.choice([25, 60, 120]))))
    return out


def test_words():
    assert words.words("Café CAFÉ​#N#x­y 3,5") == ["café", "café", "xy", "3", "5"]
    assert words.words("日本語2024年") == ["日本", "本語", "2024", "年"]
    assert words.words("") == [] and words.words("... #r#") == []


def test_multiset_elements_count_repeats():
    offsets, flat = bags(["a a b", "b a a", "", "a b"])
    sets = [set(flat[x:y].tolist()) for x, y in zip(offsets, offsets[1:])]
    assert sets[0] == sets[1] and len(sets[0]) == 3 and sets[2] == set() and sets[3] < sets[0]


def test_superminhash_estimates_jaccard():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 300).astype(np.uint64)
    for shared in (50, 150, 270):
        a, b = base[:300], np.concatenate([base[:shared], rng.integers(0, 2**63, 300 - shared).astype(np.uint64)])
        s = minhash.superminhash(np.array([0, 300, 600]), np.concatenate([a, b]), 512)
        assert abs((s[0] == s[1]).mean() - shared / (600 - shared)) < 0.07
    long = np.arange(1, 70_001, dtype=np.uint64)
    whole = minhash.superminhash(np.array([0, 70_000, 70_000, 70_003]), np.concatenate([long, long[:3]]), 64)
    assert (whole[0] == minhash.superminhash(np.array([0, 70_000]), long[::-1].copy(), 64)[0]).all()
    assert (whole[2] == minhash.superminhash(np.array([0, 3]), long[:3], 64)[0]).all()
    one = minhash.superminhash(np.array([0, 1]), base[:1], 16)
    assert sorted((one[0] >> np.uint64(32)).tolist()) == list(range(16))


def test_near_duplicates_against_brute_force(spark):
    texts = corpus(2) + ["short text", "", None, "w1 " * 19]
    rows = [(i, t, 5) for i, t in enumerate(texts)] + [(3, texts[4], 5), (0, texts[0], 5), (None, texts[0], 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, body string, n int").repartition(3)
    members, links = minhash.near_duplicates(df, "doc_id", "body")
    got = {(r.a, r.b) for r in minhash.pairs_of_members(members, links, "doc_id").collect()}
    usable = [(i, t) for i, t, _ in rows if i is not None and t and len(words.words(t)) >= 20]
    want = {(i, j) for i, a in usable for j, b in usable if i < j and overlap(a, b) >= 0.8}
    assert got == want and want
    groups = {r.doc_id: r.group_id for r in minhash.groups_of_members(members, links, "doc_id").collect()}
    assert set(groups) == {i for i, _ in usable} and all(groups[a] == groups[b] for a, b in want)


def test_large_buckets_are_split_not_capped(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 5)
    rnd = random.Random(8)
    base = " ".join(rnd.choices(WORDS, k=60))
    rows = [(i, base + f" tail{i}") for i in range(23)]
    members, links = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, body string"), "doc_id", "body")
    assert minhash.pairs_of_members(members, links, "doc_id").count() == 23 * 22 // 2


def test_near_duplicates_empty(spark):
    members, links = minhash.near_duplicates(spark.createDataFrame([], "doc_id bigint, body string"), "doc_id", "body")
    assert members.count() == 0 and links.count() == 0 and minhash.groups_of_members(members, links, "doc_id").count() == 0


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 30)]
    links = [(a.to_bytes(4), b.to_bytes(4)) for a, b in [*chain, *star, (5, 5), (1, 0)]]
    got = components.connected_components(spark.createDataFrame(links, "a binary, b binary").repartition(5), "a", "b")
    roots = {int.from_bytes(r.node): int.from_bytes(r.root) for r in got.collect()}
    assert roots == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


def split_rows(seed):
    rnd = random.Random(seed)
    texts = corpus(seed, 80)
    return [(i, t, rnd.choice(["train", " TRAIN", "dev", "Test ", None]), rnd.choice(["s1", "s2", None]), 1) for i, t in enumerate(texts)]


SPLIT = "id bigint, text string, data_split string, source string, at int"


def brute_cross(rows, least):
    norm = lambda s: s.strip().lower() if s else None
    out = set()
    for i, a, sa, *_ in rows:
        for j, b, sb, *_ in rows:
            if i != j and norm(sa) == "train" and norm(sb) in ("dev", "test") and a and b and min(len(words.words(a)), len(words.words(b))) >= least and overlap(a, b) >= 0.8:
                out.add((i, j))
    return out


def records_of(spark, rows, least):
    return suffixes.split_records(spark.createDataFrame(rows, SPLIT).repartition(3), "passage", "id", "text", least)


def cross(spark, rows, least):
    return suffixes.cross_split(records_of(spark, rows, least))


def coverage(spark, rows, least):
    written, classes = suffixes.split_classes(records_of(spark, rows, least))
    return suffixes.span_coverage(written, suffixes.closed_spans(runtime.written(suffixes.shared_spans(suffixes.suffix_rows(classes)), "found")))


def brute_coverage(rows, least):
    usable = [(i, words.words(t), s.strip().lower() == "train") for i, t, s, *_ in rows if t and s and s.strip().lower() in ("train", "dev", "test") and len(words.words(t)) >= least]
    grams = lambda w: [tuple(w[k : k + 5]) + (() if len(w) >= 5 else ("end",)) for k in range(max(1, len(w) - 4))]
    sides = {side: {g for _, w, t in usable if t == side for g in grams(w)} for side in (True, False)}
    return sorted((i, len(w), len({k + j for k, g in enumerate(grams(w)) if g in sides[not t] for j in range(min(5, len(w)))})) for i, w, t in usable)


def test_cross_split_against_brute_force(spark):
    rows = [*split_rows(5), (900, "", "train", "s", 1), (901, None, "dev", "s", 1), (902, "few words", "train", "s", 1), (0, split_rows(5)[0][1], "dev", "s", 1)]
    written, links = cross(spark, rows, 20)
    got = {(r.t, r.h) for r in suffixes.overlapping_pairs(written, links).collect()}
    assert got == brute_cross(rows, 20) and got
    assert sorted((r.id, r.n_words, r.covered) for r in coverage(spark, rows, 20).collect()) == brute_coverage(rows, 20)


def test_coverage_across_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rnd = random.Random(11)
        few = [f"c{i}" for i in range(3)]
        rows = [(i, " ".join(rnd.choices(few, k=rnd.choice([1, 3, 4, 5, 9, 14]))), rnd.choice(["train"] * 5 + ["dev"]), "s", 1) for i in range(120)]
        assert sorted((r.id, r.n_words, r.covered) for r in coverage(spark, rows, 1).collect()) == brute_coverage(rows, 1)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_filter_of_held_out_keys(spark):
    keys = [-(2**63), -1, 0, 1, 2**63 - 1, 987654321987654321]
    bits = suffixes.held_filter(spark.createDataFrame([(k,) for k in keys], "key bigint"), spark)
    assert suffixes._in_filter(bits, np.array(keys).view(np.uint64)).all()
    assert not suffixes._in_filter(bits, np.arange(1000, 2000, dtype=np.uint64)).any()


def test_coverage_counts_whole_records(spark):
    rnd = random.Random(4)
    whole, long = (" ".join(rnd.choices(WORDS, k=k)) for k in (60, 150))
    half = " ".join(f"t{i}" for i in range(40))
    rows = [(1, whole, "train", "s", 1), (2, whole, "dev", "s", 1), (3, long, "train", "s", 1), (4, long, "test", "s", 1), (5, f"{half} {' '.join(f'u{i}' for i in range(40))}", "train", "s", 1), (6, half, "dev", "s", 1), (7, "alone " * 30, "dev", "s", 1)]
    # ten copies of a word run make two texts of one split alike as well: equal contexts on both sides
    rows += [(10 + i, " ".join(f"v{j}" for j in range(20)) + f" z{i}", "train" if i % 2 else "dev", "s", 1) for i in range(10)]
    cover = {r.id: (r.covered, r.n_words) for r in coverage(spark, rows, 20).collect()}
    assert [cover[i] for i in (1, 2, 3, 4)] == [(60, 60)] * 2 + [(150, 150)] * 2
    assert cover[5][0] == cover[6][0] == 40 and cover[7][0] == 0
    assert all(cover[10 + i] == (20, 21) for i in range(10))


def test_short_records(spark):
    rows = [(1, "a b c d e", "train", "s", 1), (2, "a b c d x", "dev", "s", 1), (3, "e d c b a", "test", "s", 1), (4, "q", "train", "s", 1), (5, "q", "dev", "s", 1), (6, "a b c", "dev", "s", 1)]
    written, links = cross(spark, rows, 1)
    assert {(r.t, r.h) for r in suffixes.overlapping_pairs(written, links).collect()} == brute_cross(rows, 1) == {(1, 2), (1, 3), (4, 5)}


def test_candidates_do_not_depend_on_frequency():
    rnd = random.Random(6)
    texts = []
    for n in [4, 5, 5, 6, 7, 9, 10, 13, 18, 24, 30, 45, 60] * 25:
        base = rnd.sample(WORDS, n)
        other = list(base)
        for k in rnd.sample(range(n), n // 5):
            other[k] = rnd.choice(WORDS)
        texts += [" ".join(base), " ".join(other[: n - rnd.choice([0, 0, 1]) * (n % 5 > 0)])]
    offsets, flat = bags(texts)
    single = np.bincount((flat % np.uint64(suffixes.COUNTERS)).astype(np.int64), minlength=suffixes.COUNTERS)
    close = [i for i in range(0, len(texts), 2) if overlap(texts[i], texts[i + 1]) >= 0.8 and set(texts[i].split()) != set(texts[i + 1].split())]
    assert len(close) > 200
    for times in (1, 100, 10_000, 1_000_000):
        rec, key, own = suffixes.prefix_keys(offsets, flat, np.minimum(single.astype(np.int64) * times, 2**31 - 1).astype(np.int32))
        held = [{} for _ in texts]
        for r, k, o in zip(rec.tolist(), key.tolist(), own.tolist()):
            held[r][k] = held[r].get(k, False) or o
        assert all(any(o or held[i + 1][k] for k, o in held[i].items() if k in held[i + 1]) for i in close)


def test_pairs_of_frequent_words(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK", 3)
    monkeypatch.setattr(suffixes, "HOT", 1)
    monkeypatch.setattr(suffixes, "HOT_GROWTH", 2)
    rnd = random.Random(7)
    few = [f"c{i}" for i in range(9)]
    rows = [(i, " ".join(rnd.sample(few, rnd.choice([4, 5, 5, 6, 7]))), rnd.choice(["train", "dev", "test"]), "s", 1) for i in range(150)]
    written, links = cross(spark, rows, 1)
    assert {(r.t, r.h) for r in suffixes.overlapping_pairs(written, links).collect()} == brute_cross(rows, 1)


def test_cross_split_empty(spark):
    written, links = cross(spark, [], 1)
    assert suffixes.overlapping_pairs(written, links).count() == 0 and coverage(spark, [], 1).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), min_size=0, max_size=8), min_size=1, max_size=5))
def test_class_digest_ignores_order(texts):
    joined = [" ".join(t) for t in texts] + [" ".join(reversed(t)) for t in texts]
    n = len(texts)
    offsets, flat = words.sequences(joined, words.WordHash())
    free, fixed = (words.digests_of(offsets, flat, ordered).to_pylist() for ordered in (False, True))
    assert free[:n] == free[n:]
    assert all((free[i] == free[j]) == (Counter(texts[i]) == Counter(texts[j])) and (fixed[i] == fixed[j]) == (texts[i] == texts[j]) for i in range(n) for j in range(n))
    parts = [set(bags(joined)[1][a:b].tolist()) for a, b in zip(offsets, offsets[1:])]
    assert parts[:n] == parts[n:] and [len(p) for p in parts] == np.diff(offsets).tolist()
