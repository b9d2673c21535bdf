"""Words of a text and their multiset as 64-bit elements, shared by the similarity operators."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fusemill.functions.text import MARKERS

# The characters that are invisible.
INVISIBLE = "\u200b\u00ad"
# Scripts written without spaces, in which two neighbouring characters count as a word.
UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}ー"

_MARKER = regex.compile(MARKERS)
_WORD = regex.compile(rf"(?V1)[[{UNSPACED}]&&[\p{{L}}\p{{M}}\p{{N}}]]+|[[\p{{L}}\p{{M}}\p{{N}}]--[{UNSPACED}]]+")
_LETTER = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_PLAIN = re.compile(r"[a-z0-9]+")
_UNSPACED = regex.compile(f"[{UNSPACED}]")
#: Blocks that hold all letters of the scripts without spaces (and others): a quick look before the exact patterns.
_MAYBE_UNSPACED = re.compile("[\u0e00-\u0e7f\u2e80-\uabff\uf900-\U0010ffff]")

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Texts handled at once inside a task, so that intermediate arrays stay small.
SLICE = 1000


def clean(text: str) -> str:
    """Markers to spaces, invisible characters dropped, accents composed, lower case."""
    if "#" in text or "<" in text:
        text = _MARKER.sub(" ", text)
    if not text.isascii():
        for c in INVISIBLE:
            text = text.replace(c, "")
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
    return text.lower()


def words(text: str) -> list[str]:
    """Runs of letters and digits; runs of Chinese, Japanese or Thai characters give every two neighbouring characters."""
    text = clean(text)
    if text.isascii():
        return _PLAIN.findall(text)
    if _MAYBE_UNSPACED.search(text) is None:
        return _LETTER.findall(text)
    out: list[str] = []
    for run in _WORD.findall(text):
        if len(run) > 1 and _UNSPACED.match(run):
            out.extend(map(str.__add__, run, run[1:]))
        else:
            out.append(run)
    return out


def plain_words(text: str) -> list[str]:
    """Runs of letters and digits of any script."""
    text = clean(text)
    return _PLAIN.findall(text) if text.isascii() else _LETTER.findall(text)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on arrays of uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    """word -> 64-bit hash; forgets all it knows at a million words, so that a worker's memory stays bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def sequences(texts: list[str], known: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): each text's words in their order as uint64."""
    found = [words(t) for t in texts]
    offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))])
    return offsets, np.fromiter(map(known.__getitem__, chain.from_iterable(found)), np.uint64, int(offsets[-1]))


def multiset(offsets: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Distinct elements of every sequence: the i-th repeat of a word is an element of its own."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.argsort(flat)
    if len(offsets) <= 1 << 15:  # small integers are sorted by radix
        order = order[np.argsort(doc[order].astype(np.int16), kind="stable")]
    else:
        order = order[np.argsort(doc[order], kind="stable")]
    flat = flat[order]
    fresh = np.ones(len(flat), bool)
    fresh[1:] = (flat[1:] != flat[:-1]) | (doc[1:] != doc[:-1])
    start = np.maximum.accumulate(np.where(fresh, np.arange(len(flat)), 0))
    repeat = (np.arange(len(flat)) - start).astype(np.uint64)
    return np.where(repeat == 0, flat, mix(flat + repeat * _GOLDEN))


def digests_of(offsets: np.ndarray, flat: np.ndarray, ordered: bool) -> pa.Array:
    """128-bit digests of the sequences; without ``ordered`` the same for every order of the words."""
    size = np.diff(offsets)
    if ordered:
        flat = flat + (np.arange(len(flat)) - np.repeat(offsets[:-1], size)).astype(np.uint64) * _GOLDEN
    parts = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(flat + salt))]) for salt in (_GOLDEN, np.uint64(0xD1342543DE82EF95))]
    both = np.stack([mix(p[offsets[1:]] - p[offsets[:-1]] + size.astype(np.uint64)) for p in parts], axis=1)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(size), [None, pa.py_buffer(np.ascontiguousarray(both).tobytes())]).cast(pa.binary())


def parity_sketch(offsets: np.ndarray, elements: np.ndarray) -> np.ndarray:
    """(texts, 4) int64: 256 bits, each the parity of the elements that fall on it.

    One element flips one bit, so two sketches never differ in more bits than the texts have elements that only
    one of them holds: a bound that loses no pair.
    """
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    fell = np.bincount(doc * 256 + (mix(elements) & np.uint64(255)).astype(np.int64), minlength=n * 256)
    return np.packbits((fell & 1).astype(np.uint8).reshape(n, 256), axis=1).view(np.int64)


def lists_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, elements) of a slice of a list column."""
    offsets = np.asarray(column.offsets, dtype=np.int64)
    return offsets - offsets[0], np.asarray(column.values)[offsets[0] : offsets[-1]].view(np.uint64)


def digested(df: DataFrame, text: str, least_words: int = 1, ordered: bool = False) -> DataFrame:
    """Add (cls binary, n int) and drop rows of fewer than ``least_words`` words.

    ``cls`` is a 128-bit digest of the words, with ``ordered`` in their order, else of their multiset. Null and empty
    texts have no words; whole texts are read, however long.
    """
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for whole in batches:
            for begin in range(0, whole.num_rows, SLICE):
                batch = whole.slice(begin, SLICE)
                offsets, flat = sequences([t or "" for t in batch.column(at).to_pylist()], known)
                size = np.diff(offsets)
                out = pa.RecordBatch.from_arrays([*batch.columns, digests_of(offsets, flat, ordered), pa.array(size, pa.int32())], names=[*batch.schema.names, "cls", "n"])
                yield out.filter(pa.array(size >= least_words))

    schema = T.StructType([*df.schema.fields, T.StructField("cls", T.BinaryType()), T.StructField("n", T.IntegerType())])
    return df.mapInArrow(run, schema)


def class_table(digests: DataFrame, text: str, kept: list[str], aggregates: list[Column], ordered: bool = False) -> DataFrame:
    """One row per class: num bigint, the ``kept`` group columns, cls, n, the aggregates, s0..s3 (:func:`parity_sketch`), elements and, if ``ordered``, sequence.

    Texts, which compress well, are shuffled once with map-side combination, never their hashes, so a group of copies of any
    size costs a row per task. ``num`` numbers the classes; write the table before using it twice.
    """
    grouped = digests.groupBy(*kept, "cls").agg(F.first("n").alias("n"), *aggregates, F.first(text).alias("_text"))
    grouped = grouped.withColumn("num", F.monotonically_increasing_id())
    names = ["num", *[c for c in grouped.columns if c not in ("num", "_text")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for whole in batches:
            for begin in range(0, whole.num_rows, SLICE):
                batch = whole.slice(begin, SLICE)
                offsets, flat = sequences(batch.column(len(names)).to_pylist(), known)
                elements = multiset(offsets, flat)
                sketch = parity_sketch(offsets, elements)
                arrays = [*batch.columns[: len(names)], *[pa.array(sketch[:, i]) for i in range(4)]]
                arrays += [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x.view(np.int64))) for x in ([elements, flat] if ordered else [elements])]
                yield pa.RecordBatch.from_arrays(arrays, names=out_names)

    fields = [grouped.schema[c] for c in names] + [T.StructField(f"s{i}", T.LongType()) for i in range(4)]
    fields += [T.StructField(c, T.ArrayType(T.LongType())) for c in (["elements", "sequence"] if ordered else ["elements"])]
    out_names = [f.name for f in fields]
    return grouped.select(*names, "_text").mapInArrow(run, T.StructType(fields))
