"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over consecutive tokens whose zeros are ignored, so that
a hit survives substituted tokens at those positions.  Hashes of all masked
windows of the benchmark and of the training texts are joined; around each hit
the item is laid along the document and the best overlap that tolerates
substitutions is verified token by token.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import TOKENS, Words, mix, slices, text_buffer

#: 1 is compared, 0 is ignored.  Weight 6; every mask has its own spacing.
MASKS = ("111111", "1101100101", "10110001101", "1100101000111")
#: Tokens of the benchmark that one pass over the documents holds (about 60 bytes each with its seeds).
BLOCK_TOKENS = 400_000
MIN_TOKENS, MIN_IDENTITY = 12, 0.8
#: Tokens of diagonals that are compared at once.
DIAGONAL_TOKENS = 1 << 20


def seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the masked window at each start."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, np.uint64(len(mask)))
    for j, bit in enumerate(mask):
        if bit == "1":
            total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[j : n + j]
    return mix(total)


class SeedIndex:
    """Sorted seed hashes of a block of benchmark items, for each mask, and the items' tokens."""

    def __init__(self, ids: list, texts: list, masks: tuple[str, ...] = MASKS):
        self.ids, self.masks = ids, masks
        words = Words(*text_buffer(pa.array(texts, pa.string())), True, TOKENS)
        self.hash, self.first = words.hash, words.first
        of = words.text_of()
        self.keys, self.at, self.maybe = [], [], []
        for mask in masks:
            key = seeds(words.hash, mask)
            inside = np.flatnonzero(np.arange(len(key)) + len(mask) <= words.first[1:][of[: len(key)]]) if len(key) else np.zeros(0, np.int64)
            order = inside[np.argsort(key[inside], kind="stable")]
            self.keys.append(key[order])
            self.at.append(order)
            maybe = np.zeros(1 << 20, bool)
            maybe[key[order] & np.uint64((1 << 20) - 1)] = True
            self.maybe.append(maybe)
        self.of = of

    def overlaps(self, words: Words, min_tokens: int, min_identity: float) -> list[tuple]:
        """(text, item, first token, tokens, matched) of the best verified overlap of each text and item.

        Of equally good ones the first diagonal counts.
        """
        of, found = words.text_of(), []
        for mask, keys, at, maybe in zip(self.masks, self.keys, self.at, self.maybe):
            if not len(keys):
                continue
            key = seeds(words.hash, mask)
            here = np.flatnonzero(maybe[key & np.uint64((1 << 20) - 1)])
            lo = np.searchsorted(keys, key[here], "left")
            n = np.searchsorted(keys, key[here], "right") - lo
            here, lo, n = here[n > 0], lo[n > 0], n[n > 0]
            found.append(self._diagonals(words, of, here, at, lo, n))
        if not found:
            return []
        text, item, shift = (np.concatenate([f[i] for f in found]) for i in range(3))
        order = np.lexsort((shift, item, text))
        text, item, shift = text[order], item[order], shift[order]
        new = np.ones(len(order), bool)
        new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (shift[1:] != shift[:-1])
        text, item, shift = text[new], item[new], shift[new]
        pair = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (item[1:] != item[:-1])])) if len(text) else np.zeros(0, np.int64)
        out = []
        for a, b in zip(pair, np.append(pair[1:], len(text))):
            best = self._best(words, int(text[a]), int(item[a]), shift[a:b], min_tokens, min_identity)
            if best:
                out.append(best)
        return out

    def _diagonals(self, words: Words, of: np.ndarray, here: np.ndarray, at: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, item, shift) of the hits of seeds at ``here`` with the index's entries lo .. lo + n.

        Hits of seeds that a text and an item repeat are the product of both
        counts.  Beyond their two lengths all diagonals of the pair stand for
        them, so that work is bounded by the lengths; those without a seed are
        passed over later, as they are for any other pair.
        """
        # Distinct (text, seed) with how often the text has it, then (text, item) with the hits between them.
        order = np.lexsort((lo, of[here]))
        t, seed, length = of[here][order], lo[order], n[order]
        new = np.ones(len(order), bool)
        new[1:] = (t[1:] != t[:-1]) | (seed[1:] != seed[:-1])
        first = np.flatnonzero(new)
        often = np.diff(np.append(first, len(order)))
        t, seed, length = t[first], seed[first], length[first]
        each = np.repeat(seed, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        pair = np.repeat(t, length) * np.int64(len(self.ids)) + self.of[at[each]]
        keys, inverse = np.unique(pair, return_inverse=True)
        hits = np.bincount(inverse, np.repeat(often, length), len(keys))
        texts, items = keys // len(self.ids), keys % len(self.ids)
        sizes = np.diff(words.first)[texts] + np.diff(self.first)[items]
        dense = keys[hits > 2 * sizes]
        every = []
        for k in dense.tolist():
            x, i = divmod(k, len(self.ids))
            shifts = self._all_shifts(words, x, i)
            every.append((np.full(len(shifts), x), np.full(len(shifts), i), shifts))
        # The others one by one: only seeds of which some pair is not dense.
        is_dense = np.isin(pair, dense)
        open_ = np.flatnonzero(~is_dense)
        group = np.repeat(np.arange(len(first)), length)[open_]
        times = often[group]
        spots = here[order][np.repeat(first[group], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
        places = np.repeat(at[each[open_]], times)
        every.append((of[spots], self.of[places], spots - places))
        return tuple(np.concatenate([e[i] for e in every]) for i in range(3))

    def _all_shifts(self, words: Words, text: int, item: int) -> np.ndarray:
        return np.arange(words.first[text] - self.first[item + 1] + 1, words.first[text + 1] - self.first[item])

    def _equal(self, words: Words, a: np.ndarray, n: np.ndarray, shifts: np.ndarray) -> np.ndarray:
        """Equal tokens on each diagonal, whose n tokens begin at a; all are compared at once, in parts of bounded size."""
        out = np.zeros(len(n), np.int64)
        part = np.cumsum(n) // DIAGONAL_TOKENS
        bounds = np.append(np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])), len(n)) if len(n) else []
        for x, y in zip(bounds, bounds[1:]):
            m = n[x:y]
            at = np.repeat(a[x:y] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            hits = self.hash[at] == words.hash[at + np.repeat(shifts[x:y], m)]
            out[x:y] = np.bincount(np.repeat(np.arange(y - x), m)[hits], minlength=y - x)
        return out

    def _seeded(self, same: np.ndarray) -> bool:
        """Is there a mask all of whose compared places are equal somewhere on the diagonal?"""
        for mask in self.masks:
            places = [j for j, bit in enumerate(mask) if bit == "1"]
            n = len(same) - len(mask) + 1
            if n > 0 and np.logical_and.reduce([same[j : j + n] for j in places]).any():
                return True
        return False

    def _best(self, words: Words, text: int, item: int, shifts: np.ndarray, min_tokens: int, min_identity: float) -> tuple | None:
        """Diagonals with the most equal tokens first, as long as they may beat the best one; one counts if a seed lies on it."""
        lo, hi = self.first[item], self.first[item + 1]
        least, begin, end = min(min_tokens, hi - lo), words.first[text], words.first[text + 1]
        a, b = np.maximum(lo, begin - shifts), np.minimum(hi, end - shifts)
        same = lambda k: self.hash[a[k] : b[k]] == words.hash[a[k] + shifts[k] : b[k] + shifts[k]]
        equal = self._equal(words, a, np.maximum(b - a, 0), shifts)
        # Most diagonals have too few equal tokens for any overlap.
        some = equal >= max(least * min_identity, 1)
        shifts, a, b, equal = shifts[some], a[some], b[some], equal[some]
        best, matched, at = None, 0, 0
        for k in np.lexsort((shifts, -equal)):
            if equal[k] < max(least * min_identity, matched, 1) or best and equal[k] == matched and shifts[k] > at:
                break
            here = same(k)
            span = best_overlap(here, least, min_identity) if self._seeded(here) else None
            if span and (span[2] > matched or span[2] == matched and shifts[k] < at):
                best, matched, at = (text, item, int(a[k] + shifts[k] + span[0] - begin), span[1] - span[0], span[2]), span[2], shifts[k]
        return best


def best_overlap(same: np.ndarray, least: int, identity: float) -> tuple[int, int, int] | None:
    """(from, to, matched) of the stretch with the most matches whose share of matches is at least ``identity``.

    A match earns 1 - identity and a mismatch costs identity, so that a stretch
    qualifies when its sum is not negative.  Stretches begin and end in matches.
    """
    hits = np.flatnonzero(same)
    if len(hits) < least * identity:
        return None
    gain = np.concatenate([[0.0], np.cumsum(np.where(same, 1 - identity, -identity))])
    before, behind = gain[hits], gain[hits + 1]
    # For each start, the last end with a sum that is no lower: starts matter only at new minima of gain.
    starts = np.flatnonzero(before < np.concatenate([[np.inf], np.minimum.accumulate(before)[:-1]]))
    most = np.maximum.accumulate(behind[::-1])[::-1]  # of this end and all behind it; falls
    ends = np.searchsorted(-most, -(before[starts] - 1e-9), "right") - 1
    fits = (ends >= starts) & (hits[ends] + 1 - hits[starts] >= least)
    if not fits.any():
        return None
    starts, ends = starts[fits], ends[fits]
    k = int(np.argmax(ends - starts))
    return int(hits[starts[k]]), int(hits[ends[k]] + 1), int(ends[k] - starts[k] + 1)


def _blocks(benchmark: DataFrame, block_tokens: int):
    """Items in blocks of a bounded number of tokens; the plan over all blocks holds the index of each."""
    ids, texts, size = [], [], 0
    for row in benchmark.select("item_id", "text").filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).toLocalIterator():
        n = row["text"].count(" ") + row["text"].count("\n") + 1
        if ids and size + n > block_tokens:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row["item_id"])
        texts.append(row["text"])
        size += n
    if ids:
        yield ids, texts


def contaminated(docs: DataFrame, benchmark: DataFrame, min_tokens: int = MIN_TOKENS, min_identity: float = MIN_IDENTITY, masks: tuple[str, ...] = MASKS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, item_id, start_token, n_tokens, n_matched): the best overlap of each document with each item.

    Tokens are runs of letters and digits in lower case (ASCII; other
    characters as they are).  An overlap counts from ``min_tokens`` tokens (or
    the whole of a shorter item) with at least ``min_identity`` of them equal.
    An overlap is looked for where a
    seed lies on its diagonal, in the text and in the item.  A benchmark beyond ``block_tokens`` is worked off in blocks, each against
    all documents: the benchmark has to be small, at about 60 bytes a token.  Defined cases: null and empty texts and items, and items
    shorter than the shortest mask, overlap nothing; repeated rows give repeated
    results; empty tables give no rows; other columns are ignored.
    """
    kinds = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, start_token long, n_tokens long, n_matched long"
    out = None
    for ids, texts in _blocks(benchmark, block_tokens):
        index = SeedIndex(ids, texts, masks)
        part = docs.select("doc_id", "text").mapInArrow(_search(index, min_tokens, min_identity, schema), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def _search(index: SeedIndex, min_tokens: int, min_identity: float, schema: str):
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for at, n in slices(batch.column(1)):
                part = batch.slice(at, n)
                found = index.overlaps(Words(*text_buffer(part.column(1)), True, TOKENS), min_tokens, min_identity)
                if found:
                    texts, items, *rest = zip(*found)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(texts)), pa.array([index.ids[i] for i in items]), *(pa.array(x, pa.int64()) for x in rest)], names=names)

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_tokens: int = MIN_TOKENS, min_identity: float = MIN_IDENTITY, masks: tuple[str, ...] = MASKS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``docs`` without the rows whose text overlaps a benchmark item; columns stay as they are."""
    blocks = list(_blocks(benchmark, block_tokens))
    return docs.mapInArrow(_cleaner(blocks, docs.columns.index("text"), min_tokens, min_identity, masks), docs.schema) if blocks else docs


def _cleaner(blocks: list[tuple[list, list]], at: int, min_tokens: int, min_identity: float, masks: tuple[str, ...] = MASKS):
    """All blocks in one pass, so that a task has one Python worker; it holds one index at a time, and beside that the items' texts."""

    def run(batches):
        index = None
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for block in blocks:
                if index is None or len(blocks) > 1:
                    index = SeedIndex(*block, masks)
                for start, n in slices(batch.column(at)):
                    left = np.flatnonzero(keep[start : start + n])
                    words = Words(*text_buffer(batch.column(at).slice(start, n).take(pa.array(left))), True, TOKENS)
                    keep[start + left[[f[0] for f in index.overlaps(words, min_tokens, min_identity)]]] = False
            for start, n in slices(batch.column(at)):
                yield batch.slice(start, n).filter(pa.array(keep[start : start + n]))

    return run
