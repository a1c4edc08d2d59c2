"""Vectorised word hashing on UTF-8 bytes.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``; in UTF-8 those
bytes never occur inside a multi-byte character, so byte work equals character
work.  Every function here is pure numpy and works on a whole Arrow batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: Bytes hashed at a time; temporaries take about 40 bytes for each of them.
SLICE = 1 << 19

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_MULT = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULT2 = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Another split into words: all ASCII but letters and digits parts them.
TOKENS = np.ones(256, bool)
TOKENS[[c for c in range(128) if chr(c).isalnum()]] = False
TOKENS[128:] = False
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE + 1), base, np.uint64)
        have[0] = 1
        _powers[str(base)] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8, hi - lo, lo) if raw is not None and hi > lo else np.zeros(0, np.uint8)
    return data, offsets - lo


class Words:
    """The words of a batch of texts: hashes, byte spans and the texts they are in."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool, apart: np.ndarray = _SPACE):
        self.data, self.offsets = data, offsets
        n = len(data)
        space = apart[data]
        before = np.empty(n, bool)
        if n:
            before[0] = True
            before[1:] = space[:-1]
            before[offsets[:-1][offsets[:-1] < n]] = True
            self.start = np.flatnonzero(before & ~space)
            after = np.empty(n, bool)
            after[-1] = True
            after[:-1] = space[1:]
            inner = offsets[1:-1]
            after[inner[inner > 0] - 1] = True
            self.end = np.flatnonzero(after & ~space) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        #: Words of text i are first[i]:first[i+1].
        self.first = np.searchsorted(self.start, offsets)
        self.hash = self._hash(lower)

    def _hash(self, lower: bool) -> np.ndarray:
        """A slice ends at a word's end, so that no word is cut."""
        out = np.empty(len(self.start), np.uint64)
        table = _BYTE_LOWER if lower else _BYTE
        i = 0
        while i < len(self.start):
            at = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.end, at + SLICE, "right")))
            stop = self.end[j - 1]
            total = np.zeros(stop - at + 1, np.uint64)
            np.cumsum(table[self.data[at:stop]] * _power(_BASE, stop - at), out=total[1:])
            s, e = self.start[i:j] - at, self.end[i:j] - at
            inverse = _power(_BASE_INV, stop - at)[s]
            out[i:j] = mix((total[e] - total[s]) * inverse + (e - s).astype(np.uint64))
            i = j
        return out

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """For each word, the index of its text."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def words_of(column: pa.Array, lower: bool = False) -> Words:
    return Words(*text_buffer(column), lower)


def grams(hashes: np.ndarray, k: int, second: bool = False) -> np.ndarray:
    """Hash of each run of k consecutive words (len - k + 1 of them)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    mult = _MULT2 if second else _MULT
    total = hashes[:n] * mult[0]
    for j in range(1, k):
        total += hashes[j : n + j] * mult[j % 64]
    return mix(total)


def gram_starts(words: Words, k: int) -> np.ndarray:
    """Word positions at which a run of k words of one text starts."""
    counts = words.counts
    n = int(words.first[-1])
    ok = np.ones(n, bool)
    if k > 1:
        last = np.repeat(words.first[1:], counts)
        ok = np.arange(n) + k <= last
    return np.flatnonzero(ok)


def slices(column: pa.Array, most_bytes: int = 2 << 20, most_rows: int = 2048):
    """Ranges (start, length) of a text column with about so many bytes each; a longer text stands alone."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and (total + size > most_bytes or i - start >= most_rows):
            yield start, i - start
            start, total = i, 0
        total += int(size)
    if len(sizes) > start:
        yield start, len(sizes) - start
