"""A learned sentence splitter: logistic regression over hashed features of each gap, from left to right."""

from __future__ import annotations

import math
import re
import zlib

from ..functions import text as T

# Signs, threshold and size of the feature space.
ENDS, OPENS, CLOSES = ".!؟?،؛;:»”\")…", "«﴿“\"(", "»﴾”\")"
THRESHOLD, BITS = 0.4, 20
_diacritics = re.compile(T.DIACRITICS)


def hashed(feature: str) -> int:
    return zlib.crc32(feature.encode()) & (1 << BITS) - 1


def _size(n: int) -> str:
    return str(n) if n < 6 else "6-10" if n <= 10 else "11-20" if n <= 20 else "20+"


def features(words: list[str], i: int, last: int, depth: int, tag: str) -> list[str]:
    """Of the gap before word i: its neighbours, their signs and how far the last cut and the end are."""
    bare = lambda w: _diacritics.sub("", w).strip(ENDS + OPENS)
    before, behind = words[i - 1], words[i]
    b, n, c, o = bare(before), bare(behind), before[-1], behind[0]
    named = {
        "pc": c, "nc": o, "pc_nc": f"{c}|{o}", "pw": b, "nw": n, "pw_pc": f"{b}|{c}", "plen": _size(len(b)), "since": _size(i - last), "left": _size(len(words) - i), "depth": min(depth, 2), "tag": tag,
        "plen_all": _size(len(words)), "abbrev": int(len(b) <= 1 and c == "."), "ellipsis": int(before.endswith("..") or c == "…"), "digit": int(b[:1].isdigit()),
    }
    if i >= 2:
        named["pp"] = bare(words[i - 2])
    if i + 1 < len(words):
        named["nn"] = bare(words[i + 1])
    return [f"{k}={v}" for k, v in named.items()]


def splitter(weights: dict[int | str, float], tag: str = "p"):
    """A function from a text to its units, for ``segment.split_units``; without weights it gives none.

    A weight belongs to a bucket of :func:`hashed` features, as a trained model
    has it, or to one feature by its name, which no other feature shares.
    """

    def split(text: str) -> list[str]:
        words = text.split()
        if not weights or not words:
            return []
        cuts, depth = [0], 0
        for i in range(1, len(words)):
            depth = max(0, depth + sum(c in OPENS for c in words[i - 1]) - sum(c in CLOSES for c in words[i - 1]))
            if words[i - 1][-1] in ENDS or words[i][0] in OPENS:
                z = sum(weights.get(hashed(f), 0.0) + weights.get(f, 0.0) for f in features(words, i, cuts[-1], depth, tag))
                if 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) >= THRESHOLD:
                    cuts.append(i)
        return [" ".join(words[a:b]) for a, b in zip(cuts, [*cuts[1:], len(words)])]

    return split
