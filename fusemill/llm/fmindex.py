"""Evaluation texts leaking into training text, found by one FM-index per shard of documents (problem 7).

A shard is a run of documents of one task, about ``SHARD_UNITS`` units long; a unit is a word, or a letter or digit in
the view for texts written without spaces. Each shard is indexed once, over its own vocabulary of hashed units, and written; any
number of test phrases is then found by backward search through wavelet-matrix ranks, occurrences are located by
sampled suffix positions, and overlapping occurrences are merged into removal spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fusemill.llm.oracle import plain_words_sql
from fusemill.llm.words import UNSPACED, WordHash, plain_words
from fusemill.runtime import dropped, spread, table, written

WORDS, LETTERS = 12, 24
SHARD_UNITS = 300_000
SAMPLE_STEP = 16
#: Phrases searched for at once (20 MB at most); a larger set is taken in blocks, each against the written index.
BLOCK_PHRASES = 100_000
# Languages whose items are compared by letters and digits.
LETTER_LANGUAGES = ("zh", "ja")
_END, _SEPARATOR = 0, 1
_UNSPACED = regex.compile(f"[{UNSPACED}]")


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling, from the ranks of the first three symbols on."""
    n = len(s)
    width = max(1, int(s.max(initial=0) + 1).bit_length())
    step = 3 if 3 * width < 63 else 1
    key = np.zeros(n, np.int64)
    for i in range(step):
        key <<= width
        key[: n - i] |= s[i:].astype(np.int64) + 1
    while True:
        order = np.argsort(key)
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], (sorted_key[1:] != sorted_key[:-1]).astype(np.int64)]))
        if rank[order[-1]] == n - 1 or step >= n:
            return order
        key = rank * np.int64(n + 1)
        key[: n - step] += rank[step:] + 1
        step *= 2


class FMIndex:
    """Backward search and location over one sequence of symbols below ``alphabet`` that ends with its only 0."""

    def __init__(self, s: np.ndarray | None = None, alphabet: int = 0, sample_step: int = SAMPLE_STEP, packed: dict | None = None):
        if packed is None:
            sa = suffix_array(s)
            self.n, self.alphabet = len(s), alphabet
            self.depth = max(1, int(alphabet - 1).bit_length())
            self.counts = np.bincount(s, minlength=alphabet).astype(np.int32)
            current = s[sa - 1]
            self.bits = np.zeros((self.depth, self.n), bool)
            for k, level in enumerate(reversed(range(self.depth))):
                bit = ((current >> level) & 1).astype(bool)
                self.bits[k] = bit
                current = np.concatenate([current[~bit], current[bit]])
            self.sampled = (sa % sample_step) == 0
            self.positions = sa[self.sampled].astype(np.int32)
        else:
            self.n, self.alphabet, self.depth = packed["n"], packed["alphabet"], packed["depth"]
            self.counts = np.frombuffer(packed["counts"], np.int32)
            self.bits = np.unpackbits(np.frombuffer(packed["bits"], np.uint8).reshape(self.depth, -1), axis=1, count=self.n).astype(bool)
            self.sampled = np.unpackbits(np.frombuffer(packed["sampled"], np.uint8), count=self.n).astype(bool)
            self.positions = np.frombuffer(packed["positions"], np.int32)
        self.before = np.concatenate([[0], np.cumsum(self.counts, dtype=np.int64)[:-1]])
        self.ones = np.zeros((self.depth, self.n + 1), np.int32)
        np.cumsum(self.bits, axis=1, out=self.ones[:, 1:])
        self.zeros = (self.n - self.ones[:, -1]).astype(np.int64)
        self.first = self._descend(np.arange(self.alphabet), np.zeros(self.alphabet, np.int64))
        self.sampled_rank = np.cumsum(self.sampled) - 1

    def packed(self) -> dict:
        """The index as bytes: bits of the wavelet matrix, symbol counts and sampled positions."""
        return {
            "n": self.n, "alphabet": self.alphabet, "depth": self.depth, "counts": self.counts.tobytes(), "bits": np.packbits(self.bits, axis=1).tobytes(),
            "sampled": np.packbits(self.sampled).tobytes(), "positions": self.positions.tobytes(),
        }

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, level in enumerate(reversed(range(self.depth))):
            one = ((symbol >> level) & 1).astype(bool)
            ones = self.ones[k][at]
            at = np.where(one, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol among the first ``at`` of the transform."""
        return self._descend(symbol, at) - self.first[symbol]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Half-open row ranges of the suffixes that begin with each phrase; -1 is a symbol that occurs nowhere."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        absent = (phrases < 0).any(axis=1)
        high[absent] = 0
        live = np.flatnonzero(~absent)
        for j in reversed(range(phrases.shape[1])):
            symbol = phrases[live, j]
            low[live] = self.before[symbol] + self.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.rank(symbol, high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back through the text until a sampled suffix is met."""
        out, row, steps = np.zeros(len(rows), np.int64), rows.copy(), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            hit = self.sampled[row[live]]
            done = live[hit]
            out[done] = self.positions[self.sampled_rank[row[done]]] + steps[done]
            live = live[~hit]
            at, symbol = row[live], np.zeros(len(live), np.int64)
            for k in range(self.depth):
                bit = self.ones[k][at + 1] - self.ones[k][at]
                symbol = (symbol << 1) | bit
                ones = self.ones[k][at]
                at = np.where(bit.astype(bool), self.zeros[k] + ones, at - ones)
            row[live] = self.before[symbol] + at - self.first[symbol]
            steps[live] += 1
        return out % self.n


def _units(words: list[str], view: str, known: WordHash) -> np.ndarray:
    if view == "letters":
        return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


_INDEX = "view string, docs binary, offsets binary, starts binary, vocabulary binary, n int, alphabet int, depth int, counts binary, bits binary, sampled binary, positions binary"


def shard_indexes(documents: DataFrame, lengths: dict[str, int], least_unspaced: int = 0) -> DataFrame:
    """One row per shard and view: its FM-index with documents, piece starts and vocabulary, as bytes.

    ``lengths`` names the views and their phrase lengths. A text with fewer than ``least_unspaced`` characters of scripts without
    spaces stays out of the view of letters. A text longer than a shard is cut into pieces that overlap by one phrase.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        held: dict[str, list] = {v: [] for v in lengths}
        size = dict.fromkeys(lengths, 0)

        def flush(view: str) -> pa.RecordBatch:
            parts, held[view], size[view] = held[view], [], 0
            sizes = np.array([len(p[2]) for p in parts])
            vocabulary, inverse = np.unique(np.concatenate([p[2] for p in parts]), return_inverse=True)
            starts = np.concatenate([[0], np.cumsum(sizes + 1)])
            s = np.full(int(starts[-1]) + 1, _SEPARATOR, np.int64)
            s[np.arange(len(inverse)) + np.repeat(np.arange(len(parts)), sizes)] = inverse + 2
            s[-1] = _END
            row = {"view": view, "docs": np.array([p[0] for p in parts], np.int64).tobytes(), "offsets": np.array([p[1] for p in parts], np.int64).tobytes(), "starts": starts.astype(np.int64).tobytes(), "vocabulary": vocabulary.tobytes()}
            row |= FMIndex(s, len(vocabulary) + 2).packed()
            kinds = {"string": pa.string(), "binary": pa.binary(), "int": pa.int32()}
            fields = [x.split() for x in _INDEX.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([row[n]], kinds[k]) for n, k in fields], names=[n for n, _ in fields])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = plain_words(text)
                for view, length in lengths.items():
                    if view == "letters" and least_unspaced and len(_UNSPACED.findall(text)) < least_unspaced:
                        continue
                    units = _units(found, view, known)
                    for begin in range(0, max(1, len(units) - length + 1), SHARD_UNITS):
                        piece = units[begin : begin + SHARD_UNITS + length - 1]
                        if len(piece) >= length:
                            held[view].append((doc, begin, piece))
                            size[view] += len(piece) + 1
                        if size[view] >= SHARD_UNITS:
                            yield flush(view)
        for view in lengths:
            if held[view]:
                yield flush(view)

    return spread(documents).mapInArrow(run, _INDEX)


def phrases_of(items: DataFrame, lengths: dict[str, int]) -> DataFrame:
    """(item, view, phrase binary, unspaced int): the phrases of every item, repeats once; ``phrase`` holds the units as 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for batch in batches:
            for item, text, lang in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                view = "letters" if (lang or "").strip().lower()[:2] in LETTER_LANGUAGES else "words"
                length, words = lengths[view], plain_words(text)
                units = _units(words, view, known)
                if len(units) < length:
                    continue
                single = "".join(words) if view == "letters" else ""
                inside = np.cumsum([0, *[bool(_UNSPACED.match(c)) for c in single]]) if single else np.zeros(len(units) + 1, np.int64)
                windows = np.lib.stride_tricks.sliding_window_view(units, length)
                n = len(windows)
                phrase = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * length), n, [None, pa.py_buffer(np.ascontiguousarray(windows).tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, item, np.int64)), pa.array([view] * n, pa.string()), phrase.cast(pa.binary()), pa.array((inside[length:] - inside[: n]).astype(np.int32))], names=["item", "view", "phrase", "unspaced"])

    return items.mapInArrow(run, "item bigint, view string, phrase binary, unspaced int").distinct()


def _occurrences(indexes: DataFrame, phrases: dict[str, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(doc, item, view, at) of all occurrences of the phrases of one block; ``phrases``: view -> (units by phrase, items)."""
    shared = indexes.sparkSession.sparkContext.broadcast(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if row["view"] not in shared.value:
                    continue
                units, items = shared.value[row["view"]]
                vocabulary = np.frombuffer(row["vocabulary"], np.uint64)
                slot = np.minimum(np.searchsorted(vocabulary, units), len(vocabulary) - 1)
                index = FMIndex(packed=row)
                low, high = index.search(np.where(vocabulary[slot] == units, slot + 2, -1))
                count = high - low
                hit = np.flatnonzero(count)
                if not len(hit):
                    continue
                phrase = np.repeat(hit, count[hit])
                rows = np.repeat(low[hit], count[hit]) + np.arange(len(phrase)) - np.repeat(np.cumsum(count[hit]) - count[hit], count[hit])
                position, starts = index.locate(rows), np.frombuffer(row["starts"], np.int64)
                piece = np.searchsorted(starts, position, side="right") - 1
                at = position - starts[piece] + np.frombuffer(row["offsets"], np.int64)[piece]
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row["docs"], np.int64)[piece]), pa.array(items[phrase]), pa.array([row["view"]] * len(at), pa.string()), pa.array(at)], names=["doc", "item", "view", "at"])

    return indexes.mapInArrow(run, "doc bigint, item bigint, view string, at bigint")


def leaked_spans(documents: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, lang: str, words: int = WORDS, letters: int = LETTERS) -> DataFrame:
    """(doc_id, item_id, view, start, end): merged spans of a document's words (or letters and digits) that stand in an item.

    A span is a run of phrases of ``words`` consecutive words of the item, or of ``letters`` consecutive letters and
    digits where the item's language is written without spaces. Null or empty texts and null ids hold nothing;
    repeated documents each report; an item that is too short has no phrase. Phrases are taken in blocks of bounded
    size, so neither the broadcast phrases nor the driver grow with the set; the documents are read and indexed once. No items or no documents: no rows.
    """
    spark = documents.sparkSession
    lengths = {"words": words, "letters": letters}
    texts = documents.select(F.col(doc).alias("doc"), F.col(text).alias("text")).filter(F.col("doc").isNotNull() & (F.length("text") > 0))
    usable = items.select(F.col(item).cast("long").alias("item"), F.col(item_text).alias("text"), F.col(lang).alias("lang")).filter("item is not null and text is not null")
    phrases = written(phrases_of(usable, lengths), "phrases")
    views = {r["view"]: r for r in phrases.groupBy("view").agg(F.count("*").alias("n"), F.min("unspaced").alias("least")).collect()}
    if not views:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint, view string, start bigint, end bigint")
    indexes = written(shard_indexes(texts, {v: lengths[v] for v in lengths if v in views}, views["letters"]["least"] if "letters" in views else 0), "fm_indexes")
    blocks = -(-sum(r["n"] for r in views.values()) // BLOCK_PHRASES)
    found = None
    for block in range(blocks):
        part = phrases.filter(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == block).select("view", "phrase", "item").toArrow().to_pandas()
        wanted = {v: (np.frombuffer(b"".join(g["phrase"]), np.uint64).reshape(-1, lengths[v]), g["item"].to_numpy(np.int64)) for v, g in part.groupby("view")}
        here = written(_occurrences(indexes, wanted), "occurrences")
        found = here if found is None else found.unionByName(here)
    dropped(indexes, phrases)
    length = F.when(F.col("view") == "words", words).otherwise(letters)
    order = Window.partitionBy("doc", "item", "view").orderBy("at")
    new = F.when(F.col("at") <= F.coalesce(F.lag("at").over(order) + length, F.lit(-1)), 0).otherwise(1)
    runs = found.distinct().withColumn("new", new).withColumn("run", F.sum("new").over(order))
    return runs.groupBy("doc", "item", "view", "run").agg(F.min("at").alias("start"), F.max(F.col("at") + length).alias("end")).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "view", "start", "end")


def p7_spans(spark, folder: str) -> DataFrame:
    return leaked_spans(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "text", "lang")


def p7_found(spark, folder: str) -> DataFrame:
    return p7_spans(spark, folder).select("doc_id", "item_id").distinct()


QUERIES = {"p7_found": p7_found, "p7_spans": p7_spans}
_D = f"d as (select distinct doc_id, {plain_words_sql('text')} as w from documents where text <> '' and doc_id is not null), dc as (select doc_id, array_to_string(w, '') as c from d)"
_I = f"i as (select item_id, coalesce(lower(left(trim(lang), 2)) in ({', '.join(repr(x) for x in LETTER_LANGUAGES)}), false) as letters, {plain_words_sql('text')} as w from eval_items where text is not null and item_id is not null), ic as (select item_id, array_to_string(w, '') as c from i where letters)"


def _grams_sql(key: str, source: str, column: str, length: int) -> str:
    size, gram = (f"len({column})", f"array_to_string({column}[pos + 1:pos + {length}], ' ')") if column == "w" else (f"length({column})", f"substr({column}, pos + 1, {length})")
    return f"(select {key}, pos, {gram} as g from (select *, unnest(range({size} - {length} + 1)) as pos from {source}))"


_HITS = f"""{_D}, {_I},
hits as (select distinct doc_id, item_id, 'words' as view, x.pos, {WORDS} as n from {_grams_sql('doc_id', 'd', 'w', WORDS)} x join {_grams_sql('item_id', '(from i where not letters)', 'w', WORDS)} y using (g)
  union all select distinct doc_id, item_id, 'letters', x.pos, {LETTERS} from {_grams_sql('doc_id', 'dc', 'c', LETTERS)} x join {_grams_sql('item_id', 'ic', 'c', LETTERS)} y using (g))"""
ORACLES = {
    "p7_found": f"with {_HITS} select distinct doc_id, item_id from hits",
    "p7_spans": f"""with {_HITS},
flagged as (select *, case when pos <= lag(pos) over w + n then 0 else 1 end as new from hits window w as (partition by doc_id, item_id, view order by pos)),
runs as (select *, sum(new) over (partition by doc_id, item_id, view order by pos) as run from flagged)
select doc_id, item_id, view, min(pos) as start, max(pos + n) as "end" from runs group by doc_id, item_id, view, run""",
}
