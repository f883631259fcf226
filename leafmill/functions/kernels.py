"""The few text functions that Spark lacks, as Arrow-batched kernels behind native shortcuts."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from leafmill.tables import strip


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often a lambda in it refers to it."""
    return F.transform(F.array(value), body)[0]


#: Characters that NFKC leaves alone beside each other: of Latin, Cyrillic, Kana and Han, Hangul syllables, and punctuation.
INERT = "\x00-\x7f¡-§©«-®°±¶·»¿-ıĴ-ľŁ-ňŊ-žЀ-҂‐‒-‖‘-„†-•、-〩ぁ-ゖァ-ヾ一-鿿가-힣"


def nfkc(c: Column) -> Column:
    """NFKC; texts of characters that it leaves alone do not leave the JVM's expression."""
    plain = ~c.rlike(rf"[[^\x00-\x7f]&&[^{INERT}]]")  # ASCII is told by one range, before the many of the others
    return F.when(plain, c).otherwise(_nfkc(F.when(~plain, c)))


def norm_diff(c: Column) -> Column:
    """For comparing readings: NFKC, leading marks removed, cell borders and white space as single spaces."""
    bare = F.replace(F.regexp_replace(nfkc(c), r"^(?U)[#>*_\-\s]+", ""), F.lit("|"), F.lit(" "))
    return strip(F.regexp_replace(bare, r"(?U)\s+", " "))


def squash(c: Column) -> Column:
    """For finding text in a page: NFKC without Markdown marks, leader dots and white space."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(nfkc(c), r"[|*_`#>~]", ""), r"\.{2,}", ""), r"(?U)\s+", "")


def squash_diff(c: Column) -> Column:
    """For similarity: as norm_diff, without leader dots and then white space (with the cell borders that norm_diff makes spaces)."""
    bare = F.regexp_replace(nfkc(c), r"^(?U)[#>*_\-\s]+", "")
    return F.regexp_replace(F.regexp_replace(bare, r"\.{2,}", ""), r"(?U)[\s|]+", "")


#: Products of lengths up to which two sequences are compared item by item.
_SMALL = 1 << 14
_BASE = 0x9E3779B97F4A7C15 | 1


def _prefix_sums(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial hashes of all prefixes as sums of item * base ** place, and the powers, in 64-bit arithmetic."""
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(len(x) + 1, _BASE, dtype=np.uint64))
        mixed = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)
        mixed ^= mixed >> np.uint64(29)
        return np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mixed * powers[:-1], dtype=np.uint64)]), powers


class _Windows:
    """Hashes of all windows of a length in a sequence, comparable between sequences: shifted to one common place."""

    def __init__(self, x: np.ndarray, places: int):
        self.sums, self.powers = _prefix_sums(x)
        with np.errstate(over="ignore"):
            # base ** (places - i): what brings a window that begins at i to the place ``places``
            up = np.cumprod(np.full(places + 1, _BASE, dtype=np.uint64))
        self.shift = up[places - np.arange(len(x) + 1)]

    def of(self, start: int, stop: int, length: int) -> np.ndarray:
        at = np.arange(start, stop - length + 1)
        return (self.sums[at + length] - self.sums[at]) * self.shift[at]


def matching_blocks(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int]]:
    """The blocks (a, b, size) that Ratcliff-Obershelp matching finds in two integer sequences, in order.

    In each range the longest common run counts, of several the first in x, of those the first in y, and
    then what is before and after it. The longest run is found by bisection over its length with hashes of all
    windows, so repeated items cost no more than others; small ranges go to difflib.
    """
    places = max(len(x), len(y))
    wx, wy = _Windows(x, places), _Windows(y, places)
    found, todo = [], [(0, len(x), 0, len(y))]

    def longest(a, a_end, b, b_end):
        low, high, at = 0, min(a_end - a, b_end - b), None
        step = 1
        while low < high:  # lengths double until one is not found, then are bisected
            n = min(high, low + step)
            ha, hb = wx.of(a, a_end, n), wy.of(b, b_end, n)
            hit = np.flatnonzero(np.isin(ha, hb))
            if len(hit):
                low, at = n, (a + int(hit[0]), b + int(np.flatnonzero(hb == ha[hit[0]])[0]))
                step *= 2
            else:
                high, step = n - 1, max(1, min(step // 2, (n - 1 - low + 1) // 2))
        return None if at is None else (*at, low)

    while todo:
        a, a_end, b, b_end = todo.pop()
        if a == a_end or b == b_end:
            continue
        if (a_end - a) * (b_end - b) <= _SMALL:
            blocks = SequenceMatcher(None, x[a:a_end].tolist(), y[b:b_end].tolist(), autojunk=False).get_matching_blocks()
            found += [(a + i, b + j, n) for i, j, n in blocks if n]
            continue
        run = longest(a, a_end, b, b_end)
        if run is None:
            continue
        i, j, n = run
        found.append(run)
        todo += [(a, i, b, j), (i + n, a_end, j + n, b_end)]
    merged: list[tuple[int, int, int]] = []
    for i, j, n in sorted(found):
        if merged and merged[-1][0] + merged[-1][2] == i and merged[-1][1] + merged[-1][2] == j:
            merged[-1] = (*merged[-1][:2], merged[-1][2] + n)
        else:
            merged.append((i, j, n))
    return merged


def ratio(x: str, y: str) -> float:
    """Twice the matched characters by all characters; 1 for two empty texts."""
    if not x and not y:
        return 1.0
    points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64) for t in (x, y)]
    return 2 * sum(n for _, _, n in matching_blocks(*points)) / (len(x) + len(y))


def bounded_ratio(x: str, y: str, least: float) -> float:
    """``ratio``, or 0 where the lengths rule ``least`` out; a text that lies in the other is matched whole, so its ratio is what the lengths allow."""
    if x == y:
        return 1.0
    most = 2 * min(len(x), len(y)) / (len(x) + len(y))
    if most < least:
        return 0.0
    return most if x in y or y in x else ratio(x, y)


def nearest(a: Column, others: list[Column], least: float = 0.0) -> Column:
    """The greatest similarity (see ``similarity``) of a text to others, of those up to the first that reaches ``least``."""

    @F.pandas_udf(DoubleType())
    def best(texts: pd.Series, readings: pd.Series) -> pd.Series:
        def of(x, ys):
            found = None
            for y in ys:
                if y is not None:
                    found = max(found or 0.0, bounded_ratio(x, y, least))
                    if found >= least:
                        break
            return found

        return pd.Series([None if x is None else of(x, ys) for x, ys in zip(texts, readings)], dtype=float)

    return best(squash_diff(a), F.array(*[squash_diff(F.when(a.isNotNull(), b)) for b in others]))


def similarity(a: Column, b: Column, least: float = 0.0) -> Column:
    """Ratcliff-Obershelp ratio of squashed texts, each squashed once; pairs whose lengths rule ``least`` out are 0."""
    return nearest(a, [b], least)


def comparable(word: Column) -> Column:
    """A word after NFKC as it is compared: without the marks before it, cell borders as spaces."""
    return strip(F.regexp_replace(F.replace(F.regexp_replace(word, r"^(?U)[#>*_\-\s]+", ""), F.lit("|"), F.lit(" ")), r"(?U)\s+", " "))


def word_pieces(text: Column) -> Column:
    """The text cut before each of its words; the pieces joined are the text, unless it has no word."""
    return F.regexp_extract_all(text, F.lit(r"(?U)^\s*\S+\s*|\S+\s*"), 0)


def listed_words(text: Column) -> Column:
    """The words of a text, one to a line."""
    return F.regexp_replace(strip(text), r"(?U)\s+", "\n")


def compared_words(words: Column) -> Column:
    """What each word is compared by (see ``comparable``), empty for marks alone; ``words`` after NFKC, one to a line, and rewritten all at once."""
    bare = F.replace(F.regexp_replace(words, r"(?dmU)^[#>*_\-\s&&[^\n]]+", ""), F.lit("|"), F.lit(" "))
    plain = F.regexp_replace(F.regexp_replace(bare, r"(?U)[\s&&[^\n]]+", " "), r"(?dm)^ | $", "")
    return F.when(words != "", F.split(plain, "\n", -1)).otherwise(F.array().cast("array<string>"))


def spans_and_words(pieces: Column, words: Column) -> Column:
    """struct(spans, words): the words that are not empty, and the text of each.

    Pieces without a word go to the word after them, the last ones to the last word.
    """

    def spans(pieces: Column, at: Column) -> Column:
        def span(i, k):
            begin = F.when(k == 0, F.lit(0)).otherwise(F.get(at, k - 1) + 1)
            end = F.when(k == F.size(at) - 1, F.size(pieces)).otherwise(i + 1)
            return F.array_join(F.slice(pieces, begin + 1, end - begin), "")

        return F.transform(at, span)

    places = lambda ws: F.filter(F.transform(ws, lambda w, i: F.when(w != "", i)), lambda i: i.isNotNull())
    both = lambda ps, ws: let(places(ws), lambda at: F.struct(spans(ps, at).alias("spans"), F.filter(ws, lambda w: w != "").alias("words")))
    return let(pieces, lambda ps: let(words, lambda ws: both(ps, ws)))


def _ranges(x: np.ndarray, y: np.ndarray) -> list[tuple[bool, int, int, int, int]]:
    out, a, b = [], 0, 0
    for i, j, n in [*matching_blocks(x, y), (len(x), len(y), 0)]:
        if a < i or b < j:
            out.append((False, a, i, b, j))
        a, b = i + n, j + n
        if n:
            out.append((True, i, a, j, b))
    return out


def differences(x: list[str], y: list[str]) -> list[dict]:
    """Ranges of two lists of words, in order, that are alike or differ (Ratcliff-Obershelp)."""
    ids: dict[str, int] = {}
    numbered = [np.array([ids.setdefault(w, len(ids)) for w in side], dtype=np.int64) for side in (x, y)]
    return [dict(zip(RANGE, r)) for r in _ranges(*numbered)]


RANGE = ("alike", "a", "a_end", "b", "b_end")
_RANGES = ArrayType(StructType([StructField(n, BooleanType() if n == "alike" else IntegerType()) for n in RANGE]))


@F.arrow_udf(_RANGES)
def difference_ranges(x: pa.Array, y: pa.Array) -> pa.Array:
    """``differences`` of two columns of lists of words, null where the first is. Words are numbered in Arrow, a few rows at a time, and never become Python's texts."""
    offsets, found = [0], []
    for first in range(0, len(x), 64):
        sides = [side.slice(first, 64) for side in (x, y)]
        words = [side.flatten() for side in sides]
        ids = pa.concat_arrays(words).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = [np.nan_to_num(side.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(int) for side in sides]
        ends = [np.cumsum(s) for s in sizes]
        for k, known in enumerate(sides[0].is_valid().to_pylist()):
            if known:
                own = [ids[base + end[k] - size[k] : base + end[k]] for base, end, size in zip((0, len(words[0])), ends, sizes)]
                found += _ranges(*own)
            offsets.append(len(found))
    columns = zip(*found) if found else ((),) * len(RANGE)
    parts = pa.StructArray.from_arrays([pa.array(list(c), pa.bool_() if n == "alike" else pa.int32()) for n, c in zip(RANGE, columns)], names=list(RANGE))
    known = x.is_valid().to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), parts, mask=pa.array(~known))
