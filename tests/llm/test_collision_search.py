"""Collision counting against all cosines."""

import math
import random

import numpy as np
import pytest

from glosstream.llm import collision_search as N

SCHEMA = "vec_id long, embedding array<float>, shard string, queries string, score string, version string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "s", "q", "x", "v") for i, v in rows], SCHEMA).repartition(3)


def brute(ids, x, queries, k=5):
    out = {}
    size = np.sqrt((x * x).sum(1))
    for q in queries:
        cosine = (x * x[q]).sum(1) / (size * size[q])
        order = [int(i) for i in np.lexsort((ids, -cosine)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[i]), float(cosine[i])) for i in order]
    return out


@pytest.mark.parametrize("spread_of", [0.0, 3.0])
def test_recall(spark, spread_of):
    """Vectors at random, and in clusters: recall of 0.95 and more, scores exact, order right."""
    rng = np.random.default_rng(4)
    n = 3000
    x = (rng.standard_normal((n, 32)) + spread_of * rng.standard_normal((20, 32))[rng.integers(0, 20, n)]).astype(np.float32)
    ids = np.arange(n) * 7
    got = {}
    for r in N.nearest_to_fiftieths(frame(spark, [(int(i), v.tolist()) for i, v in zip(ids, x)])).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = brute(ids, x.astype(float), np.flatnonzero(ids % 50 == 0))
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 5 * len(want)
    known = {q: dict(brute(ids, x.astype(float), [int(np.flatnonzero(ids == q)[0])], n)[q]) for q in list(want)[:5]}
    for q, each in known.items():
        assert [s for _, s in got[q]] == sorted((each[i] for i, _ in got[q]), reverse=True)
        assert all(each[i] == s for i, s in got[q])


def test_copies_are_ties(spark):
    """A vector that very many rows share: equal scores, smallest ids first; rows that repeat count once."""
    rng = np.random.default_rng(5)
    hot = rng.standard_normal(16).astype(np.float32).tolist()
    rows = [(i, hot) for i in range(0, 900)] + [(50, hot)] * 300 + [(i, rng.standard_normal(16).astype(np.float32).tolist()) for i in range(900, 1000)]
    got = [tuple(r) for r in N.nearest_to_fiftieths(frame(spark, rows)).filter("query_id = 50").orderBy("rank").collect()]
    assert [r[2] for r in got] == [0, 1, 2, 3, 4] and len({r[3] for r in got}) == 1 and abs(got[0][3] - 1) < 1e-12


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (None, [1.0, 1.0]), (50, [1.0, 2.0, 3.0]), (100, [nan, 1.0]), (150, None), (9, [-1.0, 0.0])]
    got = [tuple(r) for r in N.nearest_to_fiftieths(frame(spark, rows)).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 0.0), (0, 3, 9, -1.0)]  # 50 has no other vector of its size
    assert N.nearest_to_fiftieths(frame(spark, [])).count() == 0
    big = spark.createDataFrame([(0, [1e200, 1e200]), (1, [1e-200, 0.0]), (2, [3e200, 3e200])], "vec_id int, embedding array<double>")
    got = [(r["vec_id"], round(r["score"], 12)) for r in N.nearest_to_fiftieths(big).orderBy("rank").collect()]
    assert got == [(2, 1.0), (1, round(math.sqrt(0.5), 12))]


def test_threshold_misses_little():
    s, rng = N.Search(), random.Random(6)
    hits = [sum(abs(rng.gauss(0, 1)) <= s.width for _ in range(s.lines)) for _ in range(3000)]
    assert sum(h >= s.threshold for h in hits) / len(hits) > 0.96
    assert s.directions(8).tolist() == s.directions(8).tolist()
