"""Elias-Fano sequences and a two-level n-gram trie, as flat buffers that can be memory-mapped and are searched as they lie there."""

from __future__ import annotations

import numpy as np

_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: Position of the k-th set bit of a byte (bits from the lowest).
_SELECT = np.full((256, 8), 8, np.uint8)
for _b in range(256):
    for _k, _p in enumerate(i for i in range(8) if _b >> i & 1):
        _SELECT[_b, _k] = _p


#: Bytes of a unary part for each stored count of the bits before it.
STRIDE = 16


def _select(bits: np.ndarray, before: np.ndarray, k: np.ndarray, flip: bool) -> np.ndarray:
    """Position of the k-th (from 0) set bit, or unset one; before[i]: such bits in the bytes before byte i * STRIDE."""
    block = np.searchsorted(before, k, "right") - 1
    left, byte = k - before[block].astype(np.int64), block * STRIDE
    open_ = np.arange(len(k))
    for _ in range(STRIDE):  # on to the byte that has the bit
        here = _ONES[bits[byte[open_]] ^ np.uint8(255 * flip)]
        more = left[open_] >= here
        if not more.any():
            break
        open_, here = open_[more], here[more]
        left[open_] -= here
        byte[open_] += 1
    return byte * 8 + _SELECT[bits[byte] ^ np.uint8(255 * flip), left]


class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits in unary with a count every STRIDE bytes.

    Takes about 2.6 + log2(universe / n) bits a value; all of it is views of one
    buffer, which may be a memory map.
    """

    def __init__(self, n: int, low: int, lows: np.ndarray, highs: np.ndarray, ones: np.ndarray):
        self.n, self.low, self.lows, self.highs, self.ones = n, low, lows, highs, ones

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low = max(0, (top // max(n, 1)).bit_length() - 1)
        if low > 16:  # whole bytes: at most seven bits a value more, and quick to pack and read
            low = -(-low // 8) * 8
        lows = np.zeros((n * low + 7) // 8 + 8, np.uint8)
        if low % 8 == 0 and n:
            lows[: n * low // 8] = values.view(np.uint8).reshape(n, 8)[:, : low // 8].ravel()
        elif low and n:
            part = values & np.uint64((1 << low) - 1)
            bits = ((part[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
            packed = np.packbits(bits, bitorder="little")
            lows[: len(packed)] = packed
        high = (values >> np.uint64(low)).astype(np.int64)
        size = n + (int(high[-1]) if n else 0) + 2
        unary = np.zeros(-(-size // (8 * STRIDE)) * 8 * STRIDE, np.uint8)
        unary[high + np.arange(n)] = 1
        highs = np.packbits(unary, bitorder="little")
        ones = np.concatenate([[0], np.cumsum(_ONES[highs].reshape(-1, STRIDE).sum(1))]).astype(np.uint32)
        return cls(n, low, lows, highs, ones)

    def _zeros(self) -> np.ndarray:
        return np.arange(len(self.ones)) * (8 * STRIDE) - self.ones

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.uint64)
        bit = i * self.low
        at = bit >> 3
        word = np.zeros(len(i), np.uint64)
        for k in range(-(-self.low // 8) + (self.low % 8 > 0)):
            word |= self.lows[np.minimum(at + k, len(self.lows) - 1)].astype(np.uint64) << np.uint64(8 * k)
        word >>= (bit & 7).astype(np.uint64)
        return word & np.uint64((1 << self.low) - 1)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        high = _select(self.highs, self.ones, i, False) - i
        return high.astype(np.uint64) << np.uint64(self.low) | self._lows(i)

    def successor(self, x: np.ndarray, first: np.ndarray | None = None, stop: np.ndarray | None = None) -> np.ndarray:
        """Index of the first value that is not below x, of all or of those in [first, stop); stop if there is none."""
        high = (x >> np.uint64(self.low)).astype(np.int64)
        zeros = self._zeros()
        over = high >= int(zeros[-1])
        h = np.where(over, 0, high)
        # Values with high part h lie between the zeros h - 1 and h.
        lo = np.where(h > 0, _select(self.highs, zeros, np.maximum(h - 1, 0), True) + 1 - h, 0)
        hi = np.maximum(np.minimum(_select(self.highs, zeros, h, True) - h, self.n), lo)
        lo, hi = np.where(over, self.n, lo), np.where(over, self.n, hi)
        if first is not None:
            lo, hi = np.clip(lo, first, stop), np.clip(hi, first, stop)
        want = x & np.uint64((1 << self.low) - 1) if self.low else np.zeros(len(x), np.uint64)
        while True:  # binary search in each bucket
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._lows(mid) < want[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        return lo

    def to_bytes(self) -> bytes:
        return np.array([self.n, self.low, len(self.lows), len(self.highs), len(self.ones)], np.int64).tobytes() + self.lows.tobytes() + self.highs.tobytes() + self.ones.tobytes()

    @classmethod
    def open(cls, buffer, at: int = 0) -> tuple[EliasFano, int]:
        n, low, a, b, c = np.frombuffer(buffer, np.int64, 5, at).tolist()
        at += 40
        return cls(n, low, np.frombuffer(buffer, np.uint8, a, at), np.frombuffer(buffer, np.uint8, b, at + a), np.frombuffer(buffer, np.uint32, c, at + a + b)), at + a + b + 4 * c


#: Bits of a word's id among the successors of one context.
ID_BITS = 40
#: Levels of a quantised probability, evenly spaced in log10 from LEAST to 0.
LEVELS, LEAST = 255, -8.0


def quantise(p: np.ndarray) -> np.ndarray:
    """Codes 1..255 of probabilities; 0 stands for none."""
    return np.clip(np.rint((np.log10(np.maximum(p, 1e-12)) - LEAST) / -LEAST * (LEVELS - 1)) + 1, 1, LEVELS).astype(np.uint8)


VALUES = np.concatenate([[0.0], 10 ** (LEAST + np.arange(LEVELS) / (LEVELS - 1) * -LEAST)])


class Trie:
    """Two levels and the pointers between them, each an Elias-Fano sequence: contexts, and the successors of each.

    The ids of a context's successors are stored on top of the last value of the
    context before it, which makes the level one non-decreasing sequence.  A
    query finds its context, takes from the pointers where that context's
    successors begin and end, and looks there for the successor of its id,
    relative to what comes before.  A byte for each context has its weight, one
    for each successor its probability.
    """

    def __init__(self, contexts: EliasFano, backs: np.ndarray, pointers: EliasFano, successors: EliasFano, codes: np.ndarray):
        self.contexts, self.backs, self.pointers, self.successors, self.codes = contexts, backs, pointers, successors, codes

    @classmethod
    def of(cls, context: np.ndarray, word: np.ndarray, codes: np.ndarray, backs: np.ndarray) -> Trie:
        """From distinct (context, word id) sorted in that order; backs has the code of each one's context."""
        new = np.ones(len(context), bool)
        new[1:] = context[1:] != context[:-1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(context))[: len(first)] - 1
        base = np.concatenate([[0], np.cumsum(word[last])[:-1]]).astype(np.uint64) if len(first) else np.zeros(0, np.uint64)
        successors = word + np.repeat(base, last - first + 1)
        return cls(EliasFano.of(context[new]), backs[new], EliasFano.of(np.append(first, len(context))), EliasFano.of(successors), codes)

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Rows of two: the code of each (context, word id) and that of its context, 0 where the trie has none; fast where equal contexts stand together."""
        out = np.zeros((len(context), 2), np.uint8)
        if not self.contexts.n or not len(context):
            return out
        new = np.ones(len(context), bool)
        new[1:] = context[1:] != context[:-1]
        asked = context[new]
        r = np.minimum(self.contexts.successor(asked), self.contexts.n - 1)
        known = self.contexts[r] == asked
        of = np.cumsum(new) - 1
        mine = np.flatnonzero(known[of])
        begin, end = self.pointers[r].astype(np.int64), self.pointers[r + 1].astype(np.int64)
        base = np.where(begin > 0, self.successors[np.maximum(begin - 1, 0)], np.uint64(0))
        of = of[mine]
        out[mine, 1] = self.backs[r[of]]
        key = base[of] + word[mine]
        at = self.successors.successor(key, begin[of], end[of])
        inside = np.flatnonzero(at < end[of])
        found = inside[self.successors[at[inside]] == key[inside]]
        out[mine[found], 0] = self.codes[at[found]]
        return out

    def to_bytes(self) -> bytes:
        head = np.array([len(self.backs), len(self.codes)], np.int64).tobytes()
        pad = bytes(-(len(self.backs) + len(self.codes)) % 8)
        return head + self.backs.tobytes() + self.codes.tobytes() + pad + b"".join(level.to_bytes() for level in (self.contexts, self.pointers, self.successors))

    @classmethod
    def open(cls, buffer) -> Trie:
        """From bytes, a memory map or any other buffer: all levels are views of it, nothing is copied or rebuilt."""
        n, m = np.frombuffer(buffer, np.int64, 2).tolist()
        backs, codes, at, levels = np.frombuffer(buffer, np.uint8, n, 16), np.frombuffer(buffer, np.uint8, m, 16 + n), 16 + n + m + -(n + m) % 8, []
        for _ in range(3):
            level, at = EliasFano.open(buffer, at)
            levels.append(level)
        return cls(levels[0], backs, levels[1], levels[2], codes)
