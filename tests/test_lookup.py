"""Phrase lookup, heavy grams and anchors against brute force."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glosstream.operators import ngram, phrases


def some(seed):
    rng = random.Random(seed)
    letters = ["a", "b", "ab", "ba", "aab", "", "abc", "ü\n", "x" * 30]
    text = lambda n: " ".join(rng.choice(letters) for _ in range(rng.randint(0, n)))
    texts = [(i, text(12)) for i in range(80)] + [(80, None), (81, "")]
    needles = [(i, t[rng.randint(0, 3) :][: rng.randint(0, 12)]) for i, t in enumerate(text(9) for _ in range(80))] + [(80, None), (81, " "), (82, "  "), (83, "a  b"), (84, "zz"), (85, "ab a"), (86, " a")]
    return texts, needles


@pytest.mark.parametrize("seed", [1, 2])
def test_containing(spark, seed):
    texts, needles = some(seed)
    got = phrases.containing(spark.createDataFrame(texts, "k int, text string").repartition(3), spark.createDataFrame(needles, "i int, needle string"), "k", "i")
    assert sorted(map(tuple, got.collect())) == sorted((k, i) for k, t in texts for i, n in needles if t is not None and n and n in t)


def test_occurrences_and_scopes(spark):
    texts = spark.createDataFrame([("x", 1, "one two three one two three"), ("y", 1, "one two three"), ("x", 2, "phone two threesome")], "scope string, k int, text string")
    needles = spark.createDataFrame([("x", "one two three"), ("y", "two"), ("x", "e t"), ("z", "one")], "scope string, needle string")
    got = sorted(map(tuple, phrases.occurrences(texts, needles, ["k"]).collect()))
    assert got == [("x", "e t", 1, 0), ("x", "e t", 1, 3), ("x", "e t", 2, 0), ("x", "one two three", 1, 0), ("x", "one two three", 1, 3), ("x", "one two three", 2, 0), ("y", "two", 1, 1)]
    assert phrases.occurrences(texts, needles.limit(0), ["k"]).count() == 0


def test_no_nested_loop(spark):
    texts, needles = some(3)
    df = phrases.containing(spark.createDataFrame(texts, "k int, text string"), spark.createDataFrame([n for n in needles if n[1] != " "], "i int, needle string"), "k", "i")
    plan = df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().sparkPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def brute_hits(grams, index, top):
    out = []
    for q in sorted({q for q, _ in grams}):
        mine = {g for k, g in grams if k == q}
        hits = Counter(i for i, g in index if g in mine)
        out += [(q, i, n, r) for r, (n, i) in enumerate(sorted(((n, i) for i, n in hits.items()), key=lambda x: (-x[0], x[1]))[:top], 1)]
    return out


@pytest.mark.parametrize("least", [0, 3, 20, 10_000])
def test_heavy_grams_change_nothing(spark, monkeypatch, least):
    """One gram in every record, others in many: the same rows whatever counts as heavy."""
    monkeypatch.setattr(ngram, "HEAVY_SHARE", 50)
    rng = random.Random(least)
    index = sorted({(i, g) for i in range(60) for g in ["hot", *(rng.choice("abcdefgh") for _ in range(3)), f"r{rng.randint(0, 40)}"] if g != "hot" or i != 7})
    grams = sorted({(q, g) for q in range(70) for g in (["hot"] if q % 3 else []) + [rng.choice("abcdefghz") for _ in range(rng.randint(0, 4))] + [f"r{rng.randint(0, 60)}"]})
    got = ngram.top_hits(spark.createDataFrame(grams, "q int, gram string").repartition(3), spark.createDataFrame(index, "i int, gram string"), ["q"], "i", 4, least=least)
    assert sorted(map(tuple, got.collect())) == sorted(brute_hits(grams, index, 4))


def test_heaviest_task_is_bounded(spark):
    """A gram that every record and every query has: what is joined are lists of grams, not records."""
    n = 3000
    index = spark.range(n).select(F.col("id").alias("i"), F.explode(F.array(F.lit("hot"), F.concat(F.lit("g"), (F.col("id") % 700).cast("string")))).alias("gram"))
    grams = spark.range(n).select(F.col("id").alias("q"), F.explode(F.array(F.lit("hot"), F.concat(F.lit("g"), (F.col("id") % 900).cast("string")))).alias("gram"))
    found = ngram.top_hits(grams, index, ["q"], "i", 2, least=100)
    assert found.count() == 2 * n
    got = {r["q"]: (r["i"], r["hits"]) for r in found.filter("rn = 1").collect()}
    assert got[5] == (5, 2) and got[800] == (0, 1)
