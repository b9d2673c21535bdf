"""Mixing sources to target weights by subset-sum budget fitting (problem 8)."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fusemill.operators.ranking import running_total
from fusemill.runtime import dropped, spread, table, written

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the word pattern of the public byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
SEED = 42
#: Rows of a broadcast quota table (one per source and token length), at most; a longer one is joined by a shuffle.
BROADCAST_QUOTAS = 500_000
#: What is left of a budget when dynamic programming takes over.
FIT_TOKENS = 32_768


def token_sizes(df: DataFrame, text: str, tokenizer: str = TOKENIZER, out: str = "n_tokens") -> DataFrame:
    """Replace ``text`` by ``out`` bigint, its tokens under a public byte-level vocabulary (rank file at ``tokenizer``).

    The driver reads the file once and broadcasts it. Special tokens in a text are ordinary text; null and empty
    texts have 0 tokens; whole texts are counted, however long.
    """
    with open(tokenizer, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())
    kept = [f for f in df.schema.fields if f.name != text]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.value.splitlines())}
        encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})
        for batch in batches:
            texts = batch.column(len(names)).to_pylist()
            sizes = [len(encoding.encode_ordinary(t)) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(names))], pa.array(sizes, pa.int64())], names=[*names, out])

    return df.select(*names, text).mapInArrow(run, T.StructType([*kept, T.StructField(out, T.LongType())]))


def fit_subset_sum(target: int, counts: dict[int, int]) -> dict[int, int]:
    """How many of each length to take so that the sum is as near below ``target`` as any choice can be.

    Bounded knapsack by bit sets: bit s of ``reach[i]`` says that the first i bundles can sum up to s. A length with
    many documents is bundled in powers of two.
    """
    bundles: list[tuple[int, int]] = []
    for length, count in sorted(counts.items(), reverse=True):
        left, size = min(count, target // length if length else 0), 1
        while left > 0:
            take = min(size, left)
            bundles.append((length, take))
            left, size = left - take, size * 2
    mask = (1 << (target + 1)) - 1
    reach = [1]
    for length, take in bundles:
        reach.append((reach[-1] | (reach[-1] << (length * take))) & mask)
        if reach[-1] >> target & 1:
            break
    at = reach[-1].bit_length() - 1
    out: dict[int, int] = {}
    for i in range(len(reach) - 1, 0, -1):
        if not reach[i - 1] >> at & 1:
            length, take = bundles[i - 1]
            out[length] = out.get(length, 0) + take
            at -= length * take
    return out


def fit_budget(budget: int, counts: dict[int, int], most: int) -> tuple[int, dict[int, int]]:
    """(base, extra): every text ``base`` times and of each length ``extra`` texts once more, ``most`` times at most.

    Lengths are drawn in proportion to their counts until ``FIT_TOKENS`` of the budget are left at most, unless a
    source has too few texts of some length; the rest is fitted exactly.
    """
    total = sum(length * n for length, n in counts.items())
    if not total or budget <= 0 or most <= 0:
        return 0, {}
    base = min(most, budget // total)
    if base == most:
        return base, {}
    rest = budget - base * total
    extra = {length: n * rest // total for length, n in counts.items()}
    left = rest - sum(length * n for length, n in extra.items())
    for length in sorted(counts, reverse=True):
        if left > FIT_TOKENS:
            more = min(counts[length] - extra[length], (left - FIT_TOKENS) // length)
            extra[length] += more
            left -= more * length
    for length, n in fit_subset_sum(left, {length: n - extra[length] for length, n in counts.items()}).items():
        extra[length] += n
    return base, {length: n for length, n in extra.items() if n}


def _name(source: str) -> Column:
    return F.lower(F.regexp_replace(source, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def wanted_shares(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """Source -> (target share, most repeats); null shares or caps count as 0, a source named twice has its greatest share."""
    out: dict[str, tuple[float, int]] = {}
    for row in targets.select(_name("source").alias("source"), "target_share", "max_repeats").filter("source is not null").orderBy("source", F.desc("target_share")).collect():
        out.setdefault(row["source"], (float(row["target_share"] or 0), int(row["max_repeats"] or 0)))
    return out


def usable_texts(df: DataFrame, key: str, text: str, source: str, sources: list[str], tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens): one row per text, under its least id with a target source; written."""
    rows = df.select(F.col(key).alias("doc_id"), _name(source).alias("source"), F.col(text).alias("text")).filter(F.col("doc_id").isNotNull() & (F.length("text") > 0) & F.col("source").isin(*sources))
    rows = token_sizes(spread(rows.withColumn("digest", F.unhex(F.sha2("text", 256)))), "text", tokenizer)
    one = rows.groupBy("digest").agg(F.min(F.struct("doc_id", "source", "n_tokens")).alias("d")).select("d.*")
    return written(one.filter("n_tokens > 0"), "sized")


def exact_budgets(wanted: dict[str, tuple[float, int]], tokens: dict[str, int]) -> dict[str, int]:
    """Budgets of the largest mix in which every source that has texts keeps its share.

    The shares of sources without texts, which nothing can fill, are spread over the others in proportion.
    """
    given = {s: share for s, (share, most) in wanted.items() if share > 0 and most > 0 and tokens.get(s)}
    whole = sum(given.values())
    if not given:
        return dict.fromkeys(wanted, 0)
    size = min(wanted[s][1] * tokens[s] * whole / share for s, share in given.items())
    return {s: int(given[s] / whole * size + 1e-6) if s in given else 0 for s in wanted}


def mix(df: DataFrame, key: str, text: str, source: str, targets: DataFrame, budget: int | str = "exact", seed: int = SEED, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares) of a mix to target shares.

    ``targets``: (source, target_share, max_repeats); names are compared without case and padding. chosen: (doc_id,
    source, n_tokens, repeats) with repeats >= 1; shares: one row per target with the share wanted and reached.
    ``budget``: "exact" is the largest mix that meets every share that can be met (see :func:`exact_budgets`); "all" is as many
    tokens as all usable texts have; a number is the mix's size in tokens. With the latter two a source that cannot fill its
    part is repeated to its cap and falls short, which the report shows; the others keep their parts.

    The same text under several ids is one text (that of its least id with a target source), so no text goes beyond
    its cap. Null and empty texts, null keys and sources without a target are left out; null shares or caps count as
    0; a source named twice has its greatest share. Only the histogram of token lengths per source reaches the driver.
    Documents of one length are chosen in the order of a seeded hash, by running totals, not by a sort in one task.
    """
    spark = df.sparkSession
    wanted = wanted_shares(targets)
    one = usable_texts(df, key, text, source, list(wanted), tokenizer)
    histogram: dict[str, dict[int, int]] = {s: {} for s in wanted}
    for row in one.groupBy("source", "n_tokens").agg(F.count("*").alias("n")).toLocalIterator():
        histogram[row["source"]][row["n_tokens"]] = row["n"]
    tokens = {s: sum(length * n for length, n in counts.items()) for s, counts in histogram.items()}
    total = budget if isinstance(budget, int) else sum(tokens.values())
    budgets = exact_budgets(wanted, tokens) if budget == "exact" else {s: int(share * total) for s, (share, _) in wanted.items()}
    bases, quotas = [], []
    for s, (_, most) in wanted.items():
        base, extra = fit_budget(budgets[s], histogram[s], most)
        bases.append((s, base))
        quotas += [(s, length, n, histogram[s][length]) for length, n in extra.items()]
    base = spark.createDataFrame(bases, "source string, base bigint") if bases else spark.createDataFrame([], "source string, base bigint")
    quota = spark.createDataFrame(quotas, "source string, n_tokens bigint, take bigint, have bigint")
    if len(quotas) <= BROADCAST_QUOTAS:
        quota = F.broadcast(quota)
    drawn = one.join(F.broadcast(base), "source").join(quota, ["source", "n_tokens"], "left")
    contested = drawn.filter("take < have").withColumn("draw", F.struct(F.xxhash64("doc_id", F.lit(seed)).alias("h"), F.col("doc_id").alias("d")))
    placed = running_total(contested.select("doc_id", "source", "n_tokens", "take", "base", "draw"), ["source", "n_tokens"], "draw", F.lit(1), "place")
    repeats = F.col("base") + F.when(F.col("take").isNotNull(), 1).otherwise(0)
    settled = drawn.filter("take is null or take >= have").select("doc_id", "source", "n_tokens", repeats.alias("repeats"))
    ranked = placed.select("doc_id", "source", "n_tokens", (F.col("base") + F.when(F.col("place") <= F.col("take"), 1).otherwise(0)).alias("repeats"))
    chosen = written(settled.unionByName(ranked).filter("repeats > 0").select("doc_id", "source", "n_tokens", F.col("repeats").cast("long").alias("repeats")), "mix")
    dropped(one)
    sums = {r["source"]: r for r in chosen.groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most")).collect()}
    size = sum(r["tokens"] for r in sums.values())
    report = []
    for s, (share, most) in wanted.items():
        r = sums.get(s)
        reached = r["tokens"] if r else 0
        report.append((s, share, most, r["docs"] if r else 0, r["most"] if r else 0, reached, budgets[s], reached / size if size else 0.0))
    shares = spark.createDataFrame(report, "source string, target_share double, max_repeats bigint, n_docs bigint, most_repeats bigint, n_tokens bigint, budget_tokens bigint, actual_share double")
    return chosen, shares


def _mixed(spark, folder: str, budget: int | str = "exact") -> tuple[DataFrame, DataFrame]:
    return mix(table(spark, folder, "documents"), "doc_id", "text", "source", table(spark, folder, "source_targets"), budget)


def p8_mix(spark, folder: str) -> DataFrame:
    return _mixed(spark, folder)[0]


def p8_shares(spark, folder: str) -> DataFrame:
    return _mixed(spark, folder)[1]


def p8_shares_all(spark, folder: str) -> DataFrame:
    return _mixed(spark, folder, "all")[1]


def p8_invariants(spark, folder: str) -> DataFrame:
    """Per source: its texts, and whether the chosen documents are real, different texts of it, keep the cap, add up to the report and meet the share.

    The share wanted is that of the sources that have texts; it is met if it is less than one in a thousand off.
    """
    documents, targets = table(spark, folder, "documents"), table(spark, folder, "source_targets")
    chosen, shares = _mixed(spark, folder)
    named = documents.select("doc_id", _name("source").alias("source"), "text").filter("doc_id is not null and text <> ''").join(F.broadcast(shares.select("source")), "source", "left_semi")
    texts = named.groupBy("text").agg(F.min(F.struct("doc_id", "source")).alias("d")).select("d.*")
    per = texts.join(chosen.select(F.col("doc_id"), F.col("source").alias("as_source"), "n_tokens", "repeats"), "doc_id", "left")
    sums = per.groupBy("source").agg(F.count("*").alias("n_texts"), F.count("repeats").alias("taken"), F.coalesce(F.max("repeats"), F.lit(0)).alias("most"), F.coalesce(F.sum(F.col("n_tokens") * F.col("repeats")), F.lit(0)).alias("tokens"), F.coalesce(F.bool_and(F.col("source") == F.col("as_source")), F.lit(True)).alias("own"))
    whole = shares.filter("n_docs > 0").agg(F.sum("target_share").alias("whole"))
    joined = shares.join(sums, "source", "left").crossJoin(F.broadcast(whole))
    none = F.coalesce("n_texts", F.lit(0)) == 0
    return joined.select(
        "source",
        F.coalesce("n_texts", F.lit(0)).alias("n_texts"),
        (none | (F.col("own") & (F.col("taken") == F.col("n_docs")))).alias("own_texts"),
        (none | (F.col("most") <= F.col("max_repeats"))).alias("caps_kept"),
        (none | (F.col("tokens") == F.col("n_tokens"))).alias("sums_agree"),
        (none | (F.abs(F.col("actual_share") - F.col("target_share") / F.col("whole")) < 0.001)).alias("share_met"),
    )


QUERIES = {"p8_mix": p8_mix, "p8_shares": p8_shares, "p8_shares_all": p8_shares_all, "p8_invariants": p8_invariants}
_TARGETS = "(select distinct lower(trim(source)) as source from source_targets where source is not null)"
ORACLES: dict[str, str] = {
    "p8_invariants": f"""with d as (select doc_id, lower(trim(source)) as source, text from documents where doc_id is not null and text <> '' and lower(trim(source)) in (select source from {_TARGETS})),
one as (select text, arg_min(source, doc_id) as source from d group by 1), n as (select source, count(*) as n from one group by 1)
select source, coalesce(n, 0) as n_texts, true as own_texts, true as caps_kept, true as sums_agree, true as share_met from {_TARGETS} left join n using (source)""",
}
