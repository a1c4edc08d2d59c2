"""String similarity as vectorised Python: what SQL functions do not offer.

``ratio`` is 200 * LCS / (len a + len b), the indel similarity; Levenshtein
distance is not the same, as a substitution costs two there.
"""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel addition (Hyyro)."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """0 to 100; two empty strings are equal."""
    total = len(a) + len(b)
    return 200.0 * lcs_length(a, b) / total if total else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with any window of the longer one, windows cut at its ends included."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long else 0.0
    if short in long:
        return 100.0
    n, best = len(short), 0.0
    letters = set(short)
    for stop in range(1, len(long) + n):
        start = max(0, stop - n)
        window = long[start : min(stop, len(long))]
        # A best window begins and ends in a letter of the short string.
        if (window[-1] if stop <= len(long) else window[0]) not in letters:
            continue
        if 200.0 * min(len(window), n) / (n + len(window)) > best:
            best = max(best, ratio(short, window))
    return best


@lru_cache(100_000)
def _letters(word: str) -> int:
    """A bit for each kind of letter (folded to 64)."""
    out = 0
    for c in word:
        out |= 1 << (ord(c) & 63)
    return out


def alike(a: str, b: str, least: float) -> bool:
    """Is the ratio of two words at least so much?  Letters that only one of them has rule most pairs out."""
    total = len(a) + len(b)
    if 200 * min(len(a), len(b)) < least * total or (_letters(a) ^ _letters(b)).bit_count() > total * (100 - least) / 100 + 1e-9:
        return False
    return ratio(a, b) >= least


def coverage(query: list[str], reference: list[str], least: float = 80.0, enough: float = 0.0) -> float:
    """The share of query words that some reference word resembles; 0 once it cannot reach ``enough``."""
    if not query:
        return 0.0
    exact, hits = set(reference), 0
    for i, w in enumerate(query):
        if hits + len(query) - i < enough * len(query):
            return 0.0
        hits += w in exact or any(alike(w, r, least) for r in reference)
    return hits / len(query)


def combined(query: str, references: list[str], reference_words: list[str], least: float = 80.0, enough: float = 0.0) -> float:
    """0 to 1: the best over the reference's forms; a query much longer than a form is measured whole, without coverage.

    Scores below ``enough`` come out as 0: coverage, which bounds the score, is
    worked out first.
    """
    words, best = query.split(), 0.0
    share = None
    for form in references:
        if form is None:
            continue
        if len(query) > 1.3 * len(form):
            score = ratio(query, form)
        else:
            share = coverage(words, reference_words, least, enough) if share is None else share
            score = partial_ratio(query, form) * share if share else 0.0
        best = max(best, score)
    return best / 100 if best >= 100 * enough else 0.0


def matching_blocks(a: str, b: str) -> float:
    """Ratcliff and Obershelp's ratio, 0 to 1."""
    return SequenceMatcher(None, a, b).ratio()


#: Letters that a hamza may sit on, and that itself.
SEATS = frozenset("اويء")


def cosmetic_pair(a: str, b: str) -> bool:
    """Do two words differ only in the seat of one hamza?

    Another seat in its place, or one letter more: the hamza itself, or a waw or
    yeh beside an alef.
    """
    if a == b:
        return True
    if len(a) < len(b):
        a, b = b, a
    head = next((i for i, c in enumerate(b) if a[i] != c), len(b))
    if len(a) == len(b):
        return a[head + 1 :] == b[head + 1 :] and a[head] in SEATS and b[head] in SEATS
    if len(a) != len(b) + 1 or a[head + 1 :] != b[head:]:
        return False
    return a[head] == "ء" or a[head] in "وي" and "ا" in a[max(0, head - 1) : head] + a[head + 1 : head + 2]


def real_difference(missing: list[str], extra: list[str]) -> tuple[list[str], list[str]]:
    """What is missing and extra after words that differ only in looks are paired off."""
    missing, left = list((Counter(missing) - Counter(extra)).elements()), list((Counter(extra) - Counter(missing)).elements())
    kept = []
    for word in missing:
        twin = next((w for w in left if cosmetic_pair(word, w)), None)
        if twin is None:
            kept.append(word)
        else:
            left.remove(twin)
    return kept, left


@F.pandas_udf(DoubleType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    cached = lru_cache(50_000)(ratio)
    return pd.Series([None if x is None or y is None else cached(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def partial_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    cached = lru_cache(50_000)(partial_ratio)
    return pd.Series([None if x is None or y is None else cached(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def matching_blocks_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else matching_blocks(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def coverage_udf(query: pd.Series, reference: pd.Series) -> pd.Series:
    return pd.Series([None if q is None or r is None else coverage(list(q), list(r)) for q, r in zip(query, reference)], dtype="float64")


def combined_udf(enough: float = 0.0):
    """Score of a normalised query against a reference's normal forms and words."""

    @F.pandas_udf(DoubleType())
    def score(query: pd.Series, forms: pd.Series, words: pd.Series) -> pd.Series:
        return pd.Series([None if q is None else combined(q, list(f), list(w), enough=enough) for q, f, w in zip(query, forms, words)], dtype="float64")

    return score
