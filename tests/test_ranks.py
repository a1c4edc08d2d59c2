"""Global numbering, exact medians, unlike texts against brute force."""

import random
import statistics
import time

import pytest
from pyspark.sql import functions as F

from glosstream.operators import audit, ranks, stats, unlike


def test_numbered(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 50), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(7)
    got = [tuple(r) for r in ranks.numbered(df, [F.desc("a"), F.asc("b")]).orderBy("place").collect()]
    assert got == [(a, b, i) for i, (a, b) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])), 1)]
    assert ranks.numbered(df.limit(0), [F.asc("a")]).count() == 0
    assert [(r["a"], r["n"], r["place"]) for r in stats.most_common(spark.createDataFrame([("x",), ("y",), ("y",), ("a",)], "a string"), ["a"]).orderBy("place").collect()] == [("y", 2, 1), ("a", 1, 2), ("x", 1, 3)]


@pytest.mark.parametrize("values", [[1.0], [2.0, 1.0], [0.5] * 9, [0.0, 1e300, -1e300, 5.0, 5.0], [1e-320, 2e-320, 3e-320, 1.0], [i * i / 7 for i in range(501)], [1.0, 1.0, 1.0, 2.0, 2.0, 2.0]])
def test_median(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(3)
    for bins in (2, 16, 1024):
        assert ranks.median(df, "v", bins) == (len(values), statistics.median(values))
    assert ranks.median(df.limit(0), "v") == (0, None)


def test_order_statistics(spark):
    rng = random.Random(2)
    values = [rng.choice([rng.random(), rng.gauss(0, 1e6), float(rng.randint(0, 3))]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert ranks.order_statistics(df, "v", [0, 17, 1500, 2999], 32) == [sorted(values)[k] for k in (0, 17, 1500, 2999)]


def brute(texts, least):
    out = set()
    for i, (k, a, fa) in enumerate(texts):
        for l, b, fb in texts[i + 1 :]:  # noqa: E741
            if k == l and unlike.SequenceMatcher(None, *((a, b) if fa < fb else (b, a))).ratio() < least:
                out |= {(k, a), (k, b)}
    return out


@pytest.mark.parametrize("seed", range(4))
def test_unlike(spark, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcde ") for _ in range(40)) for _ in range(3)]
    texts = {}
    for i in range(150):
        key = f"k{rng.randint(0, 12)}"
        text = list(rng.choice(base) * (8 if key == "k3" else 1))
        for _ in range(rng.choice([1, 2, 3, 15, 30])):
            text[rng.randrange(len(text))] = rng.choice("abcdexyz ")
        text = "".join(text[: rng.choice([12, 40, 400])])
        texts.setdefault((key if key != "k1" else "k2", text), i)
    rows = [(k, s, f) for (k, s), f in texts.items()]
    got = unlike.unlike_texts(spark.createDataFrame(rows, "key string, s string, first int").repartition(3), 0.55, block=4)
    assert {tuple(r) for r in got.collect()} == brute(rows, 0.55)


def test_near_copies_end(spark):
    """Very many sources of one target, all different and all alike: no pair of them is compared but with the first."""
    rows = spark.range(20_000).select(F.lit("k").alias("key"), F.concat(F.lit("the same long sentence with a number that is "), F.col("id").cast("string")).alias("s"), F.col("id").alias("first"))
    began = time.perf_counter()
    assert unlike.unlike_texts(rows, 0.55).count() == 0
    odd = spark.createDataFrame([("k", "something quite different, without any of that and much more of its own", 1_000_000)], "key string, s string, first long")
    assert unlike.unlike_texts(rows.unionByName(odd), 0.55).count() == 20_001
    assert time.perf_counter() - began < 120


def test_duplicates_show_others(spark):
    rows = [(1, "one two three four", "Same."), (2, "other words stand here now", "same."), (3, "one two three four!", " same. "), (4, "short", "else"), (5, "a b c d", "else"), (6, "one two three", "uno"), (7, None, None)]
    got = {r["seq"]: r["others"] for r in audit.duplicates(spark.createDataFrame(rows, "seq int, source string, target string")).collect()}
    assert got == {1: ["other words stand here now", "one two three four!"], 2: ["one two three four", "one two three four!"], 3: ["one two three four", "other words stand here now"]}
