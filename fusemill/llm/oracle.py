"""SQL pieces for brute-force oracles over whole tables: words of a text and overlaps of word multisets."""

from __future__ import annotations

from fusemill.llm.words import INVISIBLE, MARKERS, UNSPACED


def clean_sql(x: str) -> str:
    out = f"regexp_replace({x}, '{MARKERS}', ' ', 'g')"
    for c in INVISIBLE:
        out = f"replace({out}, chr({ord(c)}), '')"
    return f"lower(nfc_normalize({out}))"


def plain_words_sql(x: str) -> str:
    return rf"regexp_extract_all({clean_sql(x)}, '[\p{{L}}\p{{M}}\p{{N}}]+')"


def words_sql(x: str) -> str:
    """A list of words, in which runs of scripts without spaces give every two neighbouring characters."""
    runs = rf"flatten(list_transform({plain_words_sql(x)}, lambda r: regexp_extract_all(r, '[{UNSPACED}]+|[^{UNSPACED}]+')))"
    pairs = "list_transform(range(1, length(s)), lambda i: substr(s, i, 2))"
    return f"flatten(list_transform({runs}, lambda s: case when length(s) > 1 and regexp_matches(s, '^[{UNSPACED}]') then {pairs} else [s] end))"


#: CTEs (after one named recs(kind, id, split, words)): bags, and pairs(kind, ka, kb, ...) of records with an overlap of at least 0.8.
OVERLAPS = """
numbered as (select row_number() over () as r, * from recs),
bags as (select r, kind, w, count(*) as n from (select r, kind, unnest(words) as w from numbered) group by 1, 2, 3),
common as (select a.r as ra, b.r as rb, sum(least(a.n, b.n)) as c from bags a join bags b on a.kind = b.kind and a.w = b.w and a.r < b.r group by 1, 2),
pairs as (select x.kind, x.id as ia, y.id as ib, x.split as sa, y.split as sb from common join numbered x on x.r = ra join numbered y on y.r = rb
  where x.id <> y.id and c >= 8e-1 * greatest(len(x.words), len(y.words)))"""
