"""Sentence boundaries across languages and scripts, by a hidden-event n-gram language model (problem 9).

A text is a stream of words with a hidden event, boundary or none, at every place where a sentence could close (a
site): after a final mark, and between words in the script that writes none. The model gives P(event | the two words before it) and
P(next two words | event, word before); forward-backward posteriors over the sites of a block decide. Breaks
that always end a unit cut a text into blocks beforehand. No sites are, by rule, places inside a quotation, marks before a comma, Thai spaces beside a digit, and
dots without a space after them in what looks like a number, an address or an abbreviation; places inside a bracket are sites.

The texts are read once: their sites and all their words are written as numbers. The model is trained on all of them without labels. What stands
at the start is one guess per kind of site, shifted by some known abbreviations; others are learnt from counts (a short word that hardly
ever stands without its dot, after which a sentence often goes on), and rounds of expectation maximisation add up fractional n-gram counts. Words that make up less
than ``LEAST_SHARE`` of all words count as their shape. All n-grams are counted, those of words in every place of every block, in hashed
tables of fixed size, so neither the driver nor a broadcast grows with the corpus.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fusemill.functions.text import MARKERS
from fusemill.llm.words import mix
from fusemill.runtime import dropped, spread, table, written

#: A word of the vocabulary makes up at least this share of all words, so there are at most 6,666 of them.
LEAST_SHARE = 1.5e-4
#: An abbreviation makes up at least this share of all short words with a dot, so there are at most 100,000 of them.
LEAST_DOTTED = 1e-5
ROUNDS = 2
#: A word before a dot makes up at least this share of all sites to count as itself, so there are at most 50,000 of them.
LEAST_LEFT = 2e-5
#: Slots of each of the two hashed tables of n-gram counts at sites, and of the two for words anywhere (16 MB together); an n-gram's count is the lesser of its two.
SLOTS = 1 << 20
#: Features of words anywhere: how many there are, each word, each pair.
ANY, WORD, PAIR = 7, 8, 9
#: Letters of a short word, and the least score of an abbreviation.
SHORT, ABBREVIATION = 6, 0.3
#: Distinct words held by a task before it passes their counts on.
HELD_COUNTS = 200_000
#: Documents whose sites are computed at once, fewer if they have this many words; words of a stream counted at once.
SLICE, HELD_WORDS, PIECE = 4000, 1_000_000, 1 << 20

_LINE = r"(?:\r\n|[\n\r\x0b\x0c\x85 ])"
_HARD = regex.compile(rf"#N#|#n#|<sep>| |{_LINE}(?:[^\S\r\n\x0b\x0c\x85  ]*{_LINE})+")
_BLANK = r"(?:[\s\p{Z}\p{Cc}​­⁠﻿]|\#tab\#|\#r\#)"
_TRIM_LEFT = regex.compile(rf"{_BLANK}+")
_TRIM_RIGHT = regex.compile(rf"{_BLANK}+\Z", regex.REVERSE)
_OPEN, _CLOSE = "“„«‹‘「『（([【《〈", "”“»›’」』）)]】》〉"
_PAIRS = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "【": "】", "《": "》", "〈": "〉", '"': '"'}
_OPENERS = {c: [o for o, closers in _PAIRS.items() if c in closers] for c in _CLOSE}
_NO_WORD = frozenset("“„«‹「『（([\"—–-")
_BRACKETS = set(_OPEN + _CLOSE + '"')
_QUOTES = set("“„«‹「『\"《〈")
_BRACKET = regex.compile(r"[“„«‹「『（(\[【《〈\"”»›」』）)\]】》〉]")
#: Final marks of all scripts (U+104A parts clauses only); a Greek question mark looks like a semicolon. Only the tight ones also stand inside numbers, addresses and names.
_ENDS = r"\p{STerm}…‥．--\u104a"
_END = regex.compile(rf"(?V1)[{_ENDS}]")
_TIGHT = ".!?…‥．"
_MARK = regex.compile(rf"(?V1)(?P<mark>\.{{2,}}|[{_ENDS}]+|(?<=\p{{Greek}}\p{{M}}*)[;;]+)(?P<close>(?:(?:{_BLANK}(?=[»›]))?[”“»›’」』）)\]】》〉\"'])*)")
_THAI = regex.compile(r"\p{Thai}")
_BLANKS = regex.compile(rf"(?<=\S){_BLANK}+(?=\S)")
_SPACE = regex.compile(r"[\s\p{Z}]|\#tab\#|\#r\#")
#: Letters without case, and those of them whose script writes words without spaces or sentences without abbreviations of two letters.
_CASELESS, _DENSE = regex.compile(r"[\p{Lo}\p{M}]"), regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー\p{Hangul}]")
_BEFORE = regex.compile(r"[\p{L}\p{M}\p{N}.\-’'/@:_​­]{1,60}\Z", regex.REVERSE)
_LIST = regex.compile(rf"{_BLANK}*[(]?\d{{1,3}}[.)、](?={_BLANK})")
_UNSPACED_CHAR = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}ー"
_CHARS = r"\p{Han}{1,2}|\p{Hiragana}|[\p{Katakana}ー]{1,2}|\p{Thai}{1,2}"
_TOKEN = regex.compile(rf"(?V1){_CHARS}|\p{{N}}+(?:[.,:]\p{{N}}+)*|[[\p{{L}}\p{{M}}’'​­]--[{_UNSPACED_CHAR}]]+|[“„«‹「『（(\[\"—–-]")
#: A short word, its dot, and what tells that the sentence goes on after it.
_SHORT_WORD = regex.compile(rf"(?<![\p{{L}}\p{{M}}\p{{N}}.’'\-])([\p{{L}}\p{{M}}]{{2,{SHORT}}})(?![\p{{L}}\p{{M}}\p{{N}}’'\-])(?:(\.)(?!\p{{L}})([,;:]|[\s\p{{Z}}][\p{{Ll}}\p{{N}}])?)?")
_ACRONYM = regex.compile(r"(?:\p{L}\p{M}*\.)+\p{L}\p{M}*")
_DROP = {0x200B: None, 0xAD: None}
_SCRIPT = regex.compile(r"(?P<han>[\p{Han}\p{Hiragana}\p{Katakana}])|(?P<thai>\p{Thai})|(?P<deva>\p{Devanagari})|(?P<cyrl>\p{Cyrillic})|(?P<hang>\p{Hangul})|(?P<arab>\p{Arabic})|(?P<grek>\p{Greek})")
_SCRIPTS = {name: i + 1 for i, name in enumerate(("han", "thai", "deva", "cyrl", "hang", "arab", "grek"))}

#: Shapes of words; a word of the vocabulary is a hash above them.
SHAPES = ("", "<num>", "<Cap>", "<low>", "<open>", "<dash>", "<other>", "</b>", "<s>", "<none>", "<initial>", "<acronym>", "<day>")
NUM, CAP, LOW, OPEN, DASH, OTHER, END, BEGIN, NONE, INITIAL, ACRONYM, DAY = range(1, 13)
# Abbreviations that stand before what they belong to, and abbreviations that may close a sentence. They only shift the first guess.
LEADING = """dr prof mr mrs ms st sr sra srta mme mlle hr fr frau ing dipl
e.g i.e vs cf approx ca aprox env bzw z.b d.h u.a u.u p.ex p.ej fig no nr nº art pág pag vol cap ch sec eq bd ed hrsg gen col lt sgt capt
p pp s ss z d h b t m k
проф им ул г-н г-жа акад доц стр рис гл см ср напр т т.е т.н пл пр
डॉ श्री प्रो प्रा लि ดร ศ นพ รศ ผศ พ.ศ""".split()
TRAILING = """etc usw a.m p.m inc ltd co corp jr bros u.s u.k г гг в вв т.д т.п др руб коп тыс млн co.ltd ฯลฯ u.s.a""".split()
_LEADING, _TRAILING = frozenset(LEADING), frozenset(TRAILING)

#: Kinds of sites with the first guess of a boundary; a dot's guess depends on its word, see :func:`first_guess`.
GUESSES = {
    "dot": 0.97, "abbreviation": 0.5, "leading": 0.03, "trailing": 0.97, "initial": 0.04, "acronym": 0.4, "day": 0.5, "bang": 0.99, "bracket": 0.99, "danda": 0.99, "thai": 0.99, "quote": 0.05,
    "ellipsis caseless": 0.3, "ellipsis cased": 0.85, "inner colon": 0.9, "inner caseless": 0.2, "inner cased": 0.8, "goes on": 0.02, "dash": 0.02, "inside": 0.02,
}
KINDS = {name: i for i, name in enumerate(GUESSES)}
_GUESS = np.array(list(GUESSES.values()))
COLUMNS = ("block", "end", "follow", "kind", "left", "before", "right", "second", "near", "script")


class Codes(dict):
    """word -> code: a hash of 36 bits with the word's shape in 4 bits below it; forgets all it knows at a million words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        w = word.translate(_DROP) if "​" in word or "\xad" in word else word
        c = w[:1]
        if c.isdigit():
            code = NUM
        elif not c or c in "“„«‹「『（([\"":
            code = OPEN
        elif c in "—–-":
            code = DASH
        else:
            shape = CAP if c.isupper() else LOW if c.islower() else OTHER
            if len(w) > 1 and w.isupper():
                w = w.capitalize()
            code = (xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) >> 28 | 1) << 4 | shape
        self[word] = code
        return code


def _ahead(text: str, start: int, at: int) -> str:
    """What stands before a place, without the blanks between."""
    while at > start and text[at - 1].isspace():
        at -= 1
    return text[max(start, at - 5) : at]


def _enclosed(text: str, start: int, end: int) -> tuple[list[tuple[int, int, bool]], list[tuple[int, int, bool]]]:
    """(open, close, at the start of its block or sentence) of the outermost quotations of a block, and of its outermost brackets outside of quotations."""
    stack: list[tuple[str, int]] = []
    waiting: Counter = Counter()  # openers on the stack, so that a closer without one costs nothing
    quotations, brackets = [], []

    def pop_to(k: int) -> tuple[str, int]:
        top = stack[k]
        for o, _ in stack[k:]:
            waiting[o] -= 1
        del stack[k:]
        return top

    for m in _BRACKET.finditer(text, start, end):
        c, i = m.group(), m.start()
        if c == '"':
            tight_left = i > start and not text[i - 1].isspace() and text[i - 1] not in _OPEN
            if waiting['"'] and tight_left:
                o, at = pop_to(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == '"'))
            elif not tight_left:
                stack.append((c, i))
                waiting[c] += 1
                continue
            else:
                continue
        else:
            if not any(waiting[o] for o in _OPENERS.get(c, "")):
                if c in _PAIRS:
                    stack.append((c, i))
                    waiting[c] += 1
                continue
            o, at = pop_to(next(k for k in range(len(stack) - 1, -1, -1) if c in _PAIRS[stack[k][0]]))
        for found in (quotations, brackets) if o in _QUOTES else (brackets,):
            while found and found[-1][0] > at:
                found.pop()
        ahead = _ahead(text, start, at)
        (quotations if o in _QUOTES else brackets).append((at, i, not ahead or _END.match(ahead, len(ahead) - 1) is not None or ahead[-1] in _CLOSE or ahead.endswith(("#tab#", "#r#"))))
    return quotations, brackets


def _side(text: str, at: int, step: int, stop: int) -> str:
    """The character at a place, or the next one beyond quotes and brackets."""
    while at != stop and text[at] in _BRACKETS:
        at += step
    return text[at] if at != stop else ""


def _thai(c: str) -> bool:
    return "\u0e00" <= c <= "\u0e7f"


def sites_of(text: str, start: int, end: int, number: int, codes: Codes, out: list[int], stream: list[int] | None = None) -> None:
    """Append the sites of one block, from left to right, ``COLUMNS`` numbers each; and to ``stream`` the codes of all its words.

    In the stream a block begins with -1 - script, and 0 stands between two words that a site parts.
    """
    block = text[start:end]
    other = _SCRIPT.search(text, start, end)
    script = _SCRIPTS[other.lastgroup] if other else 0
    tokens = [m.span() for m in _TOKEN.finditer(text, start, end)]
    coded = [codes[text[a:b]] for a, b in tokens]
    shouted = block.upper() == block or block.lower() == block
    if shouted:
        coded = [c if c & 15 != LOW else c & ~15 | CAP for c in coded]
    parted = _sites_in(text, start, end, number, script, shouted, tokens, coded, codes, out)
    if stream is not None:
        stream.append(-1 - script)
        at = 0
        for k in parted:
            stream += coded[at:k]
            stream.append(0)
            at = k
        stream += coded[at:]


def _sites_in(text: str, start: int, end: int, number: int, script: int, shouted: bool, tokens: list[tuple[int, int]], coded: list[int], codes: Codes, out: list[int]) -> list[int]:
    """Append the sites of a block with these tokens; the number of the token after each."""
    spans = [(m.start(), m.start("mark"), m.end(), m.group("mark"), m.group("close")) for m in _MARK.finditer(text, start, end)]
    if script == _SCRIPTS["thai"] or _THAI.search(text, start, end):
        thai = [(m.start(), m.start(), m.start(), "", "") for m in _BLANKS.finditer(text, start, end) if m.start() > start and _SPACE.search(m.group())]
        spans = sorted(spans + thai)
    parted: list[int] = []
    if not spans:
        return parted
    quotations, brackets = _enclosed(text, start, end)
    closers = {x[1] for x in (*quotations, *brackets)}
    opens, closes = [x[0] for x in quotations], [x[1] for x in quotations]
    bracket_opens, bracket_closes = [x[0] for x in brackets], [x[1] for x in brackets]
    first = _LIST.match(text, start, end)
    skip = first.end() if first else start
    begins = [a for a, _ in tokens]
    words = [k for k, a in enumerate(begins) if text[a] not in _NO_WORD]
    word_ends = [tokens[k][1] for k in words]

    last_k, last_follow = -1, -1
    for _, at, stop, mark, close in spans:
        if stop <= skip:
            continue
        for i in range(stop - len(close), stop):
            # “ closes in some languages and opens in others, " does both: the pairs tell
            if text[i] in '“"' and i not in closers:
                stop, close = i, close[: i - stop]
                break
        rest = _TRIM_LEFT.match(text, stop, end)
        follow = rest.end() if rest else stop
        if follow >= end:
            continue  # the block ends here anyway
        last = bisect_left(opens, stop) - 1
        if last >= 0 and stop <= closes[last]:
            continue  # a quotation stays inside the sentence that quotes it
        last = bisect_left(bracket_opens, stop) - 1
        inside = last >= 0 and stop <= bracket_closes[last] and not brackets[last][2]
        nxt, gap = text[follow], rest is not None
        k = bisect_left(begins, follow)
        raw_right = text[tokens[k][0] : tokens[k][1]] if k < len(tokens) else ""
        if raw_right and raw_right in "“„«‹「『（([\"":
            # a quotation or bracket opens: its first word tells more
            right, second = OPEN, coded[k + 1] if k + 1 < len(tokens) else END
        else:
            right, second = coded[k] if raw_right else END, coded[k + 1] if k + 1 < len(tokens) else END
        w = bisect_right(word_ends, at)
        before = coded[words[w - 2]] if w > 1 else BEGIN
        left = NONE
        if not mark:
            prior = text[at - 1]
            if prior.isdigit() or nxt.isdigit() or prior in _OPEN or nxt in ",;:" or _END.match(prior) or _END.match(nxt):
                continue  # beside a digit nothing ends, nor after what opens; beside a mark the mark's own site tells
            if not _thai(_side(text, at - 1, -1, start - 1)) and not _thai(_side(text, follow, 1, end)):
                continue  # a space of another script
            if follow == last_follow:  # the site of a mark before closing quotes or brackets: the space decides
                del out[-len(COLUMNS) :], parted[-1:]
            kind, left = "thai", coded[words[w - 1]] if w else NONE
        else:
            if nxt in ",;:" or (_END.match(nxt) and gap is False):
                continue
            single, dots = mark in (".", "．"), mark[0] in "…‥" or mark.startswith("..")
            m = _BEFORE.search(text, start, at) if single else None
            raw = m.group().translate(_DROP) if m else ""
            key = raw.lower().strip("'’-")
            brief = False
            if not gap and not close and mark[0] in _TIGHT:
                # nothing between mark and next word: numbers, addresses, abbreviations; or a lost space
                prev = text[at - 1] if at > start else " "
                if dots:
                    pass
                elif single:
                    if _CASELESS.match(prev) and _CASELESS.match(nxt):
                        dense, address = _DENSE.match(prev) is not None, "@" in key or "//" in key
                        raw, key = raw.rpartition(".")[2], key.rpartition(".")[2]
                        if address or _thai(prev) or prev.isnumeric() and nxt.isnumeric() or len(key) < 2 and not dense:
                            continue
                        brief = len(key) == 2 and not dense
                    elif "." in key or "/" in key or "@" in key or len(key) < 3 or not prev.islower() or not nxt.isupper():
                        continue
                elif nxt.islower() or nxt.isdigit():
                    continue
            closing = sorted(quotations[bisect_right(closes, at) : bisect_left(closes, stop)] + brackets[bisect_right(bracket_closes, at) : bisect_left(bracket_closes, stop)], key=lambda x: x[1])
            quote = next((x for x in closing if text[x[0]] in _QUOTES), None)
            cased = "caseless" if raw_right and not raw_right[0].islower() and not raw_right[0].isupper() and right not in (OPEN, NUM, DASH) else "cased"
            lower = raw_right[:1].islower() and not shouted
            if quote and not quote[2]:
                kind = "inner colon" if _ahead(text, start, quote[0])[-1:] in (":", "：") else f"inner {cased}"
            elif quote:
                kind = "quote"
            elif closing:
                kind = "bracket"
            elif single:
                kind, left = "dot", codes[key + "."]
                joined = f"{text[tokens[words[w - 2]][0] : tokens[words[w - 2]][1]].translate(_DROP).lower()}.{key}" if w > 1 and len(key) <= 2 else key
                if key in _TRAILING or joined in _TRAILING:
                    kind, left = "trailing", codes[joined + "."] if joined in _TRAILING else left
                elif key in _LEADING or joined in _LEADING:
                    kind = "leading"
                elif len(key) == 1 and key.isalpha() and not _DENSE.match(key):
                    kind, left = "initial", codes[key + "."]
                elif brief or "." in key and _ACRONYM.fullmatch(key):
                    kind, left = "acronym", codes[key + "."]
                elif key.isdigit() and len(key) <= 2 and 1 <= int(key) <= 31:
                    kind, left = "day", DAY
                elif key:
                    left = NUM if key[0].isdigit() else codes[key + "."] & ~15 | (codes[raw.rstrip("'’-")] & 15 or OTHER)
            elif dots:
                kind = f"ellipsis {cased}"
            else:
                kind = "danda" if mark[0] in "।॥" else "bang"
            if right == DASH:
                kind = "dash"
            elif lower:
                left = left if single else NONE
                kind = "goes on"
        if inside:
            kind = "inside"
        near = int(w > 1 and last_k == words[w - 2])
        out += (number, stop if mark else at, follow, KINDS[kind], left, before, right, second, near, script)
        parted.append(k)
        last_k, last_follow = k, follow
    return parted


def blocks_of(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the blocks that are not empty, without surrounding blanks."""
    at = 0
    for a, b in [*((m.start(), m.end()) for m in _HARD.finditer(text)), (len(text), len(text))]:
        left = _TRIM_LEFT.match(text, at, a)
        begin = left.end() if left else at
        right = _TRIM_RIGHT.search(text, begin, a)
        stop = right.start() if right else a
        if stop > begin:
            yield begin, stop
        at = b


def _slots(feature: int, *parts: np.ndarray) -> np.ndarray:
    """(2, n): the slots of n-grams in both tables, which lie one after the other; those for words anywhere lie behind the others."""
    at = np.uint64(2 * SLOTS if feature in (ANY, WORD, PAIR) else 0)
    h = np.full(len(parts[0]), feature, np.uint64)
    for p in parts:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + p.view(np.uint64))
    return np.stack([at + h % np.uint64(SLOTS), at + np.uint64(SLOTS) + (h >> np.uint64(40)) % np.uint64(SLOTS)]).astype(np.int64)


class HiddenEventModel:
    """Smoothed n-gram estimates from fractional counts; without counts the first guesses stand.

    ``known`` and ``short`` are sorted codes: the vocabulary, and the abbreviations among the words before a dot. Counts are those
    of a count-min sketch, so they are never too low, and two n-grams must meet in both tables to disturb each other.
    """

    def __init__(self, known: np.ndarray | None = None, short: np.ndarray | None = None, counts: np.ndarray | None = None):
        self.known = np.zeros(0, np.int64) if known is None else known
        self.short = np.zeros(0, np.int64) if short is None else short
        self.counts = counts

    def _known_or_shape(self, codes: np.ndarray) -> np.ndarray:
        return np.where((codes < 16) | _among(self.known, codes), codes, codes & 15)

    def features(self, sites: np.ndarray) -> dict[str, np.ndarray]:
        """Slots of all n-grams of the sites (rows of ``COLUMNS``), and their first guesses."""
        c = {name: np.ascontiguousarray(sites[:, i]) for i, name in enumerate(COLUMNS)}
        raw_left = c["left"]
        for name in ("left", "before", "right", "second"):
            c[name] = self._known_or_shape(c[name])
        dot = (c["kind"] == KINDS["dot"]) & _among(self.short, raw_left >> 4)
        kind = np.where(dot, KINDS["abbreviation"], c["kind"])
        shape = np.where(raw_left > 15, raw_left & 15, raw_left)
        cue = kind * 16 + shape
        g, left = c["script"], c["left"]
        f = {
            "e0": _slots(1, cue), "e0s": _slots(2, cue), "e1": _slots(3, kind, left), "e1s": _slots(4, kind, left), "e2": _slots(5, kind, c["before"], left), "e2s": _slots(6, kind, c["before"], left),
            "m": _slots(ANY, g), "m1": _slots(WORD, g, c["right"]), "m2": _slots(PAIR, g, c["right"], c["second"]), "s": _slots(10, g), "s1": _slots(11, g, c["right"]), "s2": _slots(12, g, c["right"], c["second"]),
            "x": _slots(13, kind, g), "x1": _slots(14, kind, g, c["right"]), "x2": _slots(15, kind, g, c["right"], c["second"]),
        }
        begin = np.full(len(sites), BEGIN, np.int64)
        f |= {"h2": _slots(5, kind, begin, left), "h2s": _slots(6, kind, begin, left), "guess": _GUESS[kind], "near": c["near"]}
        return f

    def _ratio(self, part: np.ndarray, whole: np.ndarray, back, strength: float) -> np.ndarray:
        a, b = (np.minimum(*self.counts[x]).astype(np.float64) for x in (part, whole))
        return (np.minimum(a, b) + strength * back) / (b + strength)

    def posteriors(self, f: dict[str, np.ndarray]) -> np.ndarray:
        """P(boundary) of every site by forward-backward; a site right after another one's word sees that one's event as history."""
        if self.counts is None:
            return f["guess"]
        e0 = self._ratio(f["e0s"], f["e0"], f["guess"], 200.0)
        e1 = self._ratio(f["e1s"], f["e1"], e0, 20.0)
        event = np.clip(self._ratio(f["e2s"], f["e2"], e1, 8.0), 0.002, 0.998)
        base = self._ratio(f["m1"], f["m"], 1e-4, 20.0)
        two = self._ratio(f["m2"], f["m1"], 1e-3, 5.0)
        yes = self._ratio(f["s1"], f["s"], 1e-4, 20.0) * self._ratio(f["s2"], f["s1"], two, 5.0)
        no = self._ratio(f["x1"], f["x"], base, 50.0) * self._ratio(f["x2"], f["x1"], two, 5.0)
        yes, no = np.sqrt(yes), np.sqrt(no)  # words are not independent of each other: their evidence is tempered
        out = event * yes / (event * yes + (1 - event) * no)
        near = np.flatnonzero(f["near"])
        if len(near):
            again = np.clip(self._ratio(f["h2s"], f["h2"], e1, 8.0), 0.002, 0.998)
            for first in near[np.flatnonzero(np.diff(near, prepend=-5) > 1)]:
                last = first
                while last + 1 < len(out) and f["near"][last + 1]:
                    last += 1
                self._chain(out, event, again, yes, no, first - 1, last + 1)
        return out

    @staticmethod
    def _chain(out, event, again, yes, no, a: int, b: int) -> None:
        """Forward-backward over sites a..b-1, each of which but the first has the event before it as history."""
        steps = [np.array([[1 - event[i], event[i]], [1 - again[i], again[i]]]) * np.array([no[i], yes[i]]) for i in range(a, b)]
        forward, state = [], np.array([1.0, 0.0])
        for m in steps:
            state = state @ m
            state = state / (state.sum() or 1.0)
            forward.append(state)
        back = np.ones(2)
        for i in range(b - 1, a - 1, -1):
            both = forward[i - a] * back
            out[i] = both[1] / (both.sum() or 1.0)
            back = steps[i - a] @ back
            back = back / (back.sum() or 1.0)

    def ngram_counts(self, f: dict[str, np.ndarray], p: np.ndarray) -> np.ndarray:
        """The fractional n-gram counts around the sites, by slot."""
        one, no = np.ones(len(p)), 1 - p
        weights = {"e0": one, "e0s": p, "e1": one, "e1s": p, "e2": one, "e2s": p, "s": p, "s1": p, "s2": p, "x": no, "x1": no, "x2": no}
        return np.bincount(np.concatenate([f[name].ravel() for name in weights]), np.concatenate([np.tile(w, 2) for w in weights.values()]), 4 * SLOTS)

    def word_counts(self, stream: np.ndarray) -> np.ndarray:
        """By slot, how often every word stands in whole blocks and follows another without a site between them; ``stream`` as in :func:`sites_of`."""
        begins = stream < 0
        scripts = -1 - stream[begins]
        number = np.cumsum(begins) - 1
        sums = np.zeros(4 * SLOTS)
        for at in range(0, len(stream), PIECE):
            part = stream[at : at + PIECE + 1]  # one word more, for its pair
            g, code, word = scripts[number[at : at + PIECE + 1]], self._known_or_shape(part), part > 0
            pair = word[1:] & word[:-1]
            alone = word[:PIECE]
            slots = (_slots(ANY, g[:PIECE][alone]), _slots(WORD, g[:PIECE][alone], code[:PIECE][alone]), _slots(PAIR, g[1:][pair], code[:-1][pair], code[1:][pair]))
            sums += np.bincount(np.concatenate([x.ravel() for x in slots]), minlength=4 * SLOTS)
        return sums


def _among(sorted_codes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    if not len(sorted_codes):
        return np.zeros(len(codes), bool)
    return sorted_codes[np.minimum(np.searchsorted(sorted_codes, codes), len(sorted_codes) - 1)] == codes


def abbreviation_score(dotted: float, plain: float, letters: int, all_dotted: float, total: float) -> float:
    """How much a short word looks like an abbreviation: log likelihood that it takes a dot more often than words do, less for letters and for uses without a dot.

    (Kiss and Strunk, Unsupervised Multilingual Sentence Boundary Detection, 2006.)
    """
    n, p = dotted + plain, min(max(all_dotted / total, 1e-9), 1 - 1e-9)
    if dotted / n <= p:
        return 0.0
    ratio = 2 * (dotted * math.log(0.99 / p) + plain * math.log(0.01 / (1 - p)))
    return ratio * math.exp(-letters) * float(max(letters, 1)) ** -plain


def short_words(text: str, counts: Counter) -> None:
    """Count the short words of a text by (word, dot, what shows that the sentence goes on)."""
    counts.update(_SHORT_WORD.findall(text))


def abbreviations(words: pa.Table) -> np.ndarray:
    """Sorted codes (without shape) of the abbreviations among (word, plain, dotted, on, all_dotted, total)."""
    codes, out = Codes(), []
    for r in words.to_pylist():
        if abbreviation_score(r["dotted"], r["plain"], len(r["word"]), r["all_dotted"], r["total"]) >= ABBREVIATION:
            out.append(codes[r["word"] + "."] >> 4)
    return np.unique(np.array(out, np.int64))


_SITES = "doc_id {}, word string, how int, n bigint, starts array<bigint>, ends array<bigint>, words array<bigint>, " + ", ".join(f"{c} array<bigint>" for c in COLUMNS)


def site_table(texts: DataFrame) -> DataFrame:
    """A row per document of (doc_id, text): bounds of its blocks, the stream of all its words, and its sites as columns of numbers; and rows (word, how, n) with the counts of short words."""
    schema = _SITES.format(texts.schema["doc_id"].dataType.simpleString())
    names = [c.split()[0] for c in schema.split(", ")]

    def lists(values: np.ndarray, sizes: list[int]) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, held, key_type = Codes(), Counter(), None

        def flush() -> pa.RecordBatch:
            # how: 0 without a dot, 1 with one, 2 with one after which the sentence goes on
            n = len(held)
            empty = pa.nulls(n, pa.list_(pa.int64()))
            out = [pa.nulls(n, key_type), pa.array([k[0] for k in held], pa.string()), pa.array([bool(k[1]) + bool(k[2]) for k in held], pa.int32()), pa.array(list(held.values()), pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays([*out, *[empty] * (len(names) - 4)], names=names)

        for whole in batches:
            key_type = whole.schema.types[0]
            at = 0
            while at < whole.num_rows:
                starts, ends, sites, sizes, blocks, stream, lengths = [], [], [], [], [], [], []
                for text in whole.column(1).slice(at, SLICE).to_pylist():
                    before, known, number = len(sites), len(stream), 0
                    for number, (a, b) in enumerate(blocks_of(text), 1):
                        starts.append(a)
                        ends.append(b)
                        sites_of(text, a, b, number, codes, sites, stream)
                    blocks.append(number)
                    sizes.append((len(sites) - before) // len(COLUMNS))
                    lengths.append(len(stream) - known)
                    short_words(text, held)
                    if len(stream) >= HELD_WORDS:
                        break
                columns = np.array(sites, np.int64).reshape(-1, len(COLUMNS))
                n = len(blocks)
                yield pa.RecordBatch.from_arrays(
                    [whole.column(0).slice(at, n), pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), lists(np.array(starts), blocks), lists(np.array(ends), blocks), lists(np.array(stream), lengths), *[lists(np.ascontiguousarray(columns[:, i]), sizes) for i in range(len(COLUMNS))]],
                    names=names,
                )
                at += n
                if len(held) >= HELD_COUNTS:
                    yield flush()
        if held:
            yield flush()

    return texts.select("doc_id", "text").mapInArrow(run, schema)


def _sites(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([np.asarray(batch.column(c).flatten(), np.int64) for c in COLUMNS], axis=1)


def train(sites: DataFrame, rounds: int = ROUNDS) -> HiddenEventModel:
    """The model of all sites of a written :func:`site_table`."""
    spark = sites.sparkSession
    words = sites.filter("word is not null").groupBy(F.lower("word").alias("word")).agg(*[F.sum(F.when(F.col("how").isin(*how), F.col("n")).otherwise(0)).alias(name) for name, how in (("plain", (0,)), ("dotted", (1, 2)), ("on", (2,)))])
    words = written(words, "short_words")
    sums = words.agg(F.sum("dotted"), F.sum(F.col("dotted") + F.col("plain"))).first()
    all_dotted, total = sums[0] or 0, sums[1] or 0
    some = words.filter((F.col("dotted") >= max(3.0, LEAST_DOTTED * all_dotted)) & (F.col("on") >= F.col("dotted") * 0.1))
    short = abbreviations(some.select("word", "plain", "dotted", F.lit(all_dotted).alias("all_dotted"), F.lit(total).alias("total")).toArrow())
    around = [sites.filter("word is null").select(F.lit(k).alias("kind"), F.explode(c).alias("code")) for k, c in (("all", "words"), ("left", "left"))]
    around = written(around[0].filter("code > 15").unionByName(around[1]).groupBy("kind", "code").agg(F.count("*").alias("n")), "site_words")
    sums = dict(around.groupBy("kind").agg(F.sum(F.when((F.col("kind") == "left") | (F.col("code") > 15), F.col("n")))).collect())
    least = F.when(F.col("kind") == "left", max(5.0, LEAST_LEFT * (sums.get("left") or 0))).otherwise(max(5.0, LEAST_SHARE * (sums.get("all") or 0)))
    known = np.unique(np.asarray(around.filter((F.col("code") > 15) & (F.col("n") >= least)).select("code").toArrow().column(0), np.int64))
    dropped(words, around)
    model = HiddenEventModel(known, short)

    def summed(columns: tuple[str, ...], counts_of) -> np.ndarray:
        """Sums by slot of what ``counts_of`` gives for each batch of these columns."""
        shared = spark.sparkContext.broadcast((model.known, model.short, model.counts))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m, sums = HiddenEventModel(*shared.value), np.zeros(4 * SLOTS)
            for batch in batches:
                sums += counts_of(m, batch)
            slots = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(sums[slots])], names=["slot", "n"])

        got = sites.filter("word is null").select(*columns).mapInArrow(run, "slot int, n double").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
        shared.destroy()
        counts = np.zeros(4 * SLOTS)
        counts[np.asarray(got.column("slot"))] = np.asarray(got.column("n"))
        return counts

    def of_sites(m: HiddenEventModel, batch: pa.RecordBatch):
        if not len(rows := _sites(batch)):
            return 0.0
        f = m.features(rows)
        return m.ngram_counts(f, m.posteriors(f))

    words_alone = summed(("words",), lambda m, batch: m.word_counts(np.asarray(batch.column("words").flatten(), np.int64)))
    for _ in range(rounds):
        model = HiddenEventModel(known, short, (words_alone + summed(COLUMNS, of_sites)).astype(np.float32))
    return model


def _units(starts: np.ndarray, ends: np.ndarray, blocks: np.ndarray, rows: np.ndarray, owner: np.ndarray, model: HiddenEventModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of all units: units do not overlap, so sorted starts and sorted ends belong together."""
    cut = np.flatnonzero(model.posteriors(model.features(rows)) >= 0.5) if len(rows) else np.zeros(0, np.int64)
    doc = np.concatenate([blocks, owner[cut]])
    begin, stop = np.concatenate([starts, rows[cut, 2]]), np.concatenate([ends, rows[cut, 1]])
    by_start, by_end = np.lexsort((begin, doc)), np.lexsort((stop, doc))
    return doc[by_start], begin[by_start], stop[by_end]


def units_of(text: str, model: HiddenEventModel) -> list[tuple[int, int]]:
    """(start, end) of the sentence units of one text, in code points, without surrounding blanks and breaks."""
    bounds, sites = list(blocks_of(text)), []
    for number, (a, b) in enumerate(bounds, 1):
        sites_of(text, a, b, number, Codes(), sites)
    rows = np.array(sites, np.int64).reshape(-1, len(COLUMNS))
    zero = np.zeros(len(bounds), np.int64)
    _, starts, ends = _units(np.array([a for a, _ in bounds], np.int64), np.array([b for _, b in bounds], np.int64), zero, rows, np.zeros(len(rows), np.int64), model)
    return list(zip(starts.tolist(), ends.tolist()))


def sentence_units(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, start_char, end_char, unit): the sentence units of every document, numbered from 0.

    Offsets are code points, 0-based, end exclusive. Null and empty texts and texts of blanks give no units; a text
    without any final mark is one unit per block; repeated rows give repeated units; a null key is kept as null. The
    model is trained on the same texts, so an empty table gives an empty result. The texts themselves are read once.
    """
    texts = spread(df.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).filter(F.length("text") > 0))
    kind = texts.schema["doc_id"].dataType.simpleString()
    sites = written(site_table(texts), "sites")
    model = train(sites)
    shared = df.sparkSession.sparkContext.broadcast((model.known, model.short, model.counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = HiddenEventModel(*shared.value)
        for batch in batches:
            owners = [np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(batch.column(c).offsets))) for c in ("starts", "end")]
            doc, starts, ends = _units(*[np.asarray(batch.column(c).flatten(), np.int64) for c in ("starts", "ends")], owners[0], _sites(batch), owners[1], m)
            number = np.arange(len(doc)) - np.searchsorted(doc, doc)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(starts), pa.array(ends), pa.array(number)], names=["doc_id", "start_char", "end_char", "unit"])

    return sites.filter("word is null").drop("word", "how", "n", "words").mapInArrow(run, f"doc_id {kind}, start_char bigint, end_char bigint, unit bigint")


def p9_found(spark, folder: str) -> DataFrame:
    return sentence_units(table(spark, folder, "documents"), "doc_id", "text").select("doc_id", "start_char", "end_char")


_LETTER = r"[^\p{L}\p{N}]"


def p9_letters(spark, folder: str) -> DataFrame:
    """Per document: letters and digits inside its units, and whether the units follow each other without overlap; so no word is lost and none stands twice."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    units = sentence_units(documents, "doc_id", "text")
    before = F.lag("end_char").over(Window.partitionBy("doc_id").orderBy("unit"))
    units = units.withColumn("apart", F.coalesce(F.col("start_char") >= before, F.lit(True)) & (F.col("start_char") < F.col("end_char")))
    inside = units.join(documents, "doc_id").withColumn("part", F.expr("substring(text, cast(start_char + 1 as int), cast(end_char - start_char as int))"))
    letters = F.length(F.regexp_replace(F.regexp_replace("part", MARKERS, ""), _LETTER, ""))
    return inside.groupBy("doc_id").agg(F.sum(letters).alias("n_letters"), F.bool_and("apart").alias("apart"))


QUERIES = {"p9_found": p9_found, "p9_letters": p9_letters}
ORACLES: dict[str, str] = {
    "p9_letters": f"select doc_id, length(regexp_replace(regexp_replace(text, '{MARKERS}', '', 'g'), '{_LETTER}', '', 'g')) as n_letters, true as apart from documents where regexp_matches(regexp_replace(text, '{MARKERS}', '', 'g'), '[^\\s\\p{{Z}}\\p{{Cc}}]')",
}
