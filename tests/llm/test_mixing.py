import itertools
import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from fusemill.llm import mixing

DOCS = "doc_id bigint, text string, source string, n_tokens string, repeats int"
TARGETS = "source string, target_share double, max_repeats int"


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 60), st.dictionaries(st.integers(1, 12), st.integers(1, 4), max_size=4))
def test_subset_sum_is_best(target, counts):
    got = mixing.fit_subset_sum(target, counts)
    assert all(got[k] <= counts[k] for k in got)
    best = max(s for c in itertools.product(*[range(n + 1) for n in counts.values()]) if (s := sum(a * b for a, b in zip(counts, c))) <= target)
    assert sum(k * n for k, n in got.items()) == best


def test_budget_keeps_caps_and_base():
    assert mixing.fit_budget(100, {10: 2}, 3) == (3, {})
    base, extra = mixing.fit_budget(50, {10: 2}, 3)
    assert base == 2 and extra == {10: 1}
    assert mixing.fit_budget(0, {10: 2}, 3) == (0, {}) and mixing.fit_budget(10, {}, 3) == (0, {})


def sample():
    rnd = random.Random(3)
    rows = []
    for i in range(300):
        source = rnd.choice(["web", "Web ", " NEWS", "wiki", None, "other"])
        rows.append((i, " ".join(rnd.choices(["alpha", "beta", "gamma", "delta"], k=rnd.randint(1, 40))), source, "x", 1))
    return rows + [(900, None, "web", "x", 1), (901, "", "web", "x", 1), (902, rows[0][1], "web", "x", 1), (903, "only text of poems", "poems", "x", 1)]


def test_mix_meets_shares_and_caps(spark):
    rows = sample()
    targets = spark.createDataFrame([("web", 0.5, 1), ("news", 0.3, 2), ("poems", 0.1, 4), ("lecture", 0.1, 2)], TARGETS)
    df = spark.createDataFrame(rows, DOCS)
    chosen, shares = mixing.mix(df.repartition(4), "doc_id", "text", "source", targets, budget=4000)
    got, by = chosen.collect(), {r.source: r for r in shares.collect()}
    text = {i: t for i, t, *_ in rows}
    used = Counter()
    for r in got:
        used[text[r.doc_id]] += r.repeats
    cap = {"web": 1, "news": 2, "poems": 4}
    assert all(r.repeats <= cap[r.source] for r in got) and len({text[r.doc_id] for r in got}) == len(got) == len({r.doc_id for r in got})
    assert by["web"].n_tokens == 2000 and by["news"].n_tokens == 1200
    assert by["poems"].most_repeats == 4 and by["poems"].n_tokens < 400 and by["lecture"].n_tokens == 0
    assert sum(r.n_tokens for r in by.values()) == sum(r.n_tokens * r.repeats for r in got)
    again = mixing.mix(df.repartition(7), "doc_id", "text", "source", targets, budget=4000)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got))


def test_exact_mix_meets_every_share_that_can_be_met(spark):
    rows = sample()
    targets = spark.createDataFrame([("web", 0.4, 1), ("news", 0.3, 2), ("wiki", 0.2, 3), ("lecture", 0.1, 2)], TARGETS)
    chosen, shares = mixing.mix(spark.createDataFrame(rows, DOCS).repartition(3), "doc_id", "text", "source", targets)
    by = {r.source: r for r in shares.collect()}
    size = sum(r.n_tokens for r in by.values())
    assert all(abs(by[s].actual_share - share / 0.9) < 2 / size + 1e-9 for s, share in (("web", 0.4), ("news", 0.3), ("wiki", 0.2)))
    assert all(r.repeats <= {"web": 1, "news": 2, "wiki": 3}[r.source] for r in chosen.collect())
    # no larger mix keeps the shares: some source is used up
    texts = {s: {t for _, t, x, *_ in rows if t and x and x.strip().lower() == s} for s in ("web", "news", "wiki")}
    assert any(by[s].n_docs == len(texts[s]) and by[s].most_repeats == by[s].max_repeats for s in texts)
    assert mixing.exact_budgets({"a": (0.5, 1), "b": (0.5, 2)}, {"a": 100, "b": 30}) == {"a": 60, "b": 60}
    assert mixing.exact_budgets({"a": (0.5, 1)}, {}) == {"a": 0}


def test_mix_of_nothing(spark):
    targets = spark.createDataFrame([("web", 0.5, 1)], TARGETS)
    chosen, shares = mixing.mix(spark.createDataFrame([], DOCS), "doc_id", "text", "source", targets)
    assert chosen.count() == 0 and shares.first().n_tokens == 0
    chosen, shares = mixing.mix(spark.createDataFrame(sample(), DOCS), "doc_id", "text", "source", targets.limit(0))
    assert chosen.count() == 0 and shares.count() == 0


def test_token_sizes_match_the_library(spark):
    import base64

    import tiktoken

    with open(mixing.TOKENIZER, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=mixing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["plain words", "日本語", "", None, "<|endoftext|>", "x" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.n_tokens for r in mixing.token_sizes(df, "text").collect()}
    assert got == {i: len(encoding.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
