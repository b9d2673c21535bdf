"""Text cleaning, analysis and token budgets as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Line-break markers of the corpus, white space as Unicode sees it, words of the analyser, parts deleted from URLs.
MARKERS = "#n#|#N#|<sep>|#tab#|#r#"
SPACE = r"[\t\n\x0B\f\r \x1c-\x1f\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}]+"
URL_PARTS = ("https", "http", "www", "com", "html", "htm")
BODY_WORDS, URL_BUDGET, TITLE_BUDGET, MAX_TOKENS = 500, 42, 41, 128


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def clean_text(text: Column) -> Column:
    """Markers become spaces, runs of white space one space, ends are trimmed; null stays null."""
    return _squeezed(F.regexp_replace(text, MARKERS, " "))


def clean_light(text: Column) -> Column:
    """Only ``#N#`` becomes a space."""
    return F.replace(text, F.lit("#N#"), F.lit(" "))


def clean_url(url: Column) -> Column:
    """Lower case without scheme and host parts; a last piece of 8 or more characters with a digit is dropped. Null and empty give ''."""
    out = F.lower(url)
    for part in URL_PARTS:
        out = F.replace(out, F.lit(part), F.lit(""))
    pieces = F.split(_squeezed(out), " ")
    last = F.element_at(pieces, -1)
    drop = (F.length(last) >= 8) & last.rlike("[0-9]")
    kept = F.when(drop, F.slice(pieces, F.lit(1), F.size(pieces) - 1)).otherwise(pieces)
    return F.when(url.isNull() | (url == ""), "").otherwise(F.array_join(kept, " "))


def first_words(text: Column, n: int = BODY_WORDS) -> Column:
    """The first ``n`` pieces between single spaces, after trimming white space at both ends."""
    trimmed = F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")
    return F.array_join(F.slice(F.split(trimmed, " "), 1, n), " ")


def joined_fields(*fields: Column) -> Column:
    """``a [SEP] b [SEP] c``; nulls count as empty."""
    return F.concat_ws(" [SEP] ", *[F.coalesce(f, F.lit("")) for f in fields])


def terms(text: Column) -> Column:
    """The default analyser: lower-cased runs of letters and digits; null gives an empty array."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def budgeted_tokens(url: Column, title: Column, body: Column, most: int = MAX_TOKENS) -> Column:
    """``[CLS] url [SEP] title [SEP] body [SEP]``: url and title cut to their budgets, the body to what is left of ``most``."""
    cls, sep = F.array(F.lit("[CLS]")), F.array(F.lit("[SEP]"))
    head = F.concat(cls, F.slice(url, 1, URL_BUDGET), sep, F.slice(title, 1, TITLE_BUDGET), sep)
    return F.concat(head, F.slice(body, F.lit(1), F.greatest(F.lit(most) - F.size(head) - 1, F.lit(0))), sep)


def padded(tokens: Column, length: int, pad: str = "[PAD]") -> Column:
    """Cut or right-pad to ``length`` tokens."""
    return F.slice(F.concat(tokens, F.array_repeat(F.lit(pad), length)), 1, length)


def mask(tokens: Column, pad: str = "[PAD]") -> Column:
    return F.transform(tokens, lambda t: F.when(t == pad, 0).otherwise(1))
