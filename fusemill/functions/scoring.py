"""BM25 components, score transforms and schedules as column builders (all in double precision)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B, DELTA = 1.2, 0.75, 0.5


def _half_odds(df: Column, n: Column) -> Column:
    return (n - df + F.lit(0.5)) / (df + F.lit(0.5))


#: Inverse document frequency of the five variants, from document frequency and corpus size.
IDF: dict[str, Callable[[Column, Column], Column]] = {
    "robertson": lambda df, n: F.log(F.greatest(F.lit(1.0), _half_odds(df, n))),
    "lucene": lambda df, n: F.log(F.lit(1.0) + _half_odds(df, n)),
    "atire": lambda df, n: F.log(n / df),
    "bm25l": lambda df, n: F.log((n + F.lit(1.0)) / (df + F.lit(0.5))),
    "bm25+": lambda df, n: F.log((n + F.lit(1.0)) / df),
}


def robertson_idf_signed(df: Column, n: Column) -> Column:
    """The robertson variant without its floor; negative for terms of more than half of the documents."""
    return F.log(_half_odds(df, n))


def _length_norm(dl: Column, avg: Column, b: float) -> Column:
    return F.lit(1.0 - b) + F.lit(b) * dl / avg


def _tf_plain(tf, dl, avg, k1, b, delta):
    return tf / (F.lit(k1) * _length_norm(dl, avg, b) + tf)


def _tf_atire(tf, dl, avg, k1, b, delta):
    return tf * F.lit(k1 + 1) / (tf + F.lit(k1) * _length_norm(dl, avg, b))


def _tf_l(tf, dl, avg, k1, b, delta):
    c = tf / _length_norm(dl, avg, b) + F.lit(delta)
    return F.lit(k1 + 1) * c / (F.lit(k1) + c)


#: Term-frequency component of the five variants, from (tf, doc length, average length, k1, b, delta).
TF: dict[str, Callable[..., Column]] = {
    "robertson": _tf_plain,
    "lucene": _tf_plain,
    "atire": _tf_atire,
    "bm25l": _tf_l,
    "bm25+": lambda tf, dl, avg, k1, b, delta: _tf_atire(tf, dl, avg, k1, b, delta) + F.lit(delta),
}


def term_weight(method: str, tf: Column, df: Column, dl: Column, n: Column, avg: Column, k1: float = K1, b: float = B, delta: float = DELTA, allow_negative: bool = False) -> Column:
    """The weight of a posting; an unknown method is an error. ``allow_negative`` takes the floor off the robertson variant."""
    if method not in IDF:
        raise ValueError(f"unknown method {method!r}; choose from {', '.join(IDF)}")
    d = [c.cast("double") for c in (tf, df, dl, n, avg)]
    idf = robertson_idf_signed if allow_negative and method == "robertson" else IDF[method]
    return idf(d[1], d[3]) * TF[method](d[0], d[2], d[4], k1, b, delta)


def saturated(logit: Column, mask: Column | None = None) -> Column:
    """ln(1 + max(x, 0)), times the mask."""
    out = F.log1p(F.greatest(logit, F.lit(0.0)))
    return out if mask is None else out * mask


def fused(sparse: Column, dense: Column, sparse_weight: Column | float, dense_weight: Column | float) -> Column:
    return (F.lit(sparse_weight) if isinstance(sparse_weight, (int, float)) else sparse_weight) * sparse + (F.lit(dense_weight) if isinstance(dense_weight, (int, float)) else dense_weight) * dense


def quadratic_schedule(step: Column, full: float, steps: int) -> Column:
    """full * (t / steps)^2 until ``steps``, then full."""
    share = F.least(step, F.lit(steps)) / F.lit(float(steps))
    return F.lit(full) * share * share
