"""Collocations against a plain count of all phrases, and the parts of their method."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from glosstream.llm import collocations as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, score string, shard string, phrase string"


def brute(rows, min_count, longest=5, top=2000):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: n for p, n in f.items() if len(p) > 1 and n >= min_count}
        covered = {}
        for p, n in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    covered[p[i : i + k]] = max(covered.get(p[i : i + k], 0), n)
        rows = []
        for p, a in found.items():
            if covered.get(p, -1) < a:
                score, _, left, right = min(((1000 * a * totals[lang]) // (f[p[:c]] * f[p[c:]]), c, f[p[:c]], f[p[c:]]) for c in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, rank, p.decode(), -a, left, right, totals[lang], -score) for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def some(seed, n=150):
    rng = random.Random(seed)
    words = ["the", "The", "of", "a", "über", "née", "x y", "new", "york", "b\x00c", "🎉"]
    out = []
    for i in range(n):
        parts = [rng.choice([rng.choice(words), "in New York city", "la la la la", ".", ",\t", "\n", "\r\n", "  ", "!?"]) for _ in range(rng.randint(0, 60))]
        out.append((rng.choice(["en", "fr", None, "und"]), rng.choice([" ".join(parts), " ".join(parts), None, ""])))
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, t, lang, "s", "s", "p") for i, (lang, t) in enumerate(rows)], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in C.collocations(df, **options).collect())


@pytest.mark.parametrize("seed, longest", [(1, 5), (2, 3)])
def test_against_brute_force(spark, seed, longest):
    rows = some(seed)
    want = brute(rows, 7, longest)
    assert len(want) > 20
    assert run(spark, rows, min_count=7, longest=longest, batch_text=2000) == want


def test_top_and_ties(spark):
    rows = [("en", "a b. c d. e f.")] * 30
    assert run(spark, rows, min_count=5, top=2) == brute(rows, 5, top=2)
    assert [r[2] for r in run(spark, rows, min_count=5, top=2)] == ["a b", "c d"]


def test_edges(spark):
    assert run(spark, []) == [] and run(spark, [(None, None), ("en", ""), ("en", " .,\n"), ("en", "word")]) == []
    long = "alpha beta " * 60_000
    assert run(spark, [("en", long)]) == brute([("en", long)], 100)


def test_sketch_counts_too_much_only():
    """Requests survive packing, with gaps of every width, and no cell of enough counts is missed."""
    rng = np.random.default_rng(3)
    s = C.Sketch(3, 100)
    total, asked = Counter(), []
    for batch in range(5):
        cells = np.unique(np.concatenate([rng.integers(0, 3 * C.CELLS, 500), np.arange(90), np.array([0, 65535, 131070, 3 * C.CELLS - 1])])).astype(np.uint64)
        counts = rng.integers(1, 60, len(cells))
        for c, n in zip(cells.tolist(), counts.tolist()):
            total[c] += n
        asked.append((cells, s.request(batch, cells, counts)))
    for shard in range(3):
        blobs = [b for _, t in asked for k, b in zip(t["shard"].to_pylist(), t["blob"].to_pylist()) if k == shard]
        for (cells, _), bits in zip(asked, s.answer(blobs)):
            mine = cells[cells // np.uint64(C.CELLS) == shard]
            reply = pa.table({"shard": pa.array([shard], pa.int32()), "blob": [bits]})
            assert s.frequent(reply, mine).tolist() == [total[c] >= 100 for c in mine.tolist()]


def test_guards():
    assert C.guarded([b"New  York\t, a.B", b"", b"\n x "]) == b" \n new york \n a \n b \n x \n "
