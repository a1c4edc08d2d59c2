"""Notes, windows and decision lists against plain walks."""

import random
import re

import pytest
from pyspark.sql import functions as F

from glosstream.functions.similarity import ratio
from glosstream.operators import align, decide


def walk_notes(segments, notes):
    """Marks by a search through the letters of each paragraph."""
    out, number = [], 0
    for para in sorted({p for p, *_ in notes}):
        hosts = sorted((o, c) for p, o, c in segments if p == para)
        if not hosts:
            continue
        kept = []
        for o, c in hosts:
            blank = re.sub(r"\s*\(\s*\)", lambda m: "\0" * len(m[0]), c)
            kept += [(ch, o, i) for i, ch in enumerate(blank) if ch not in "\0«»" and not ch.isspace()]
        joined, behind = "".join(k[0] for k in kept), 0
        for _, n, anchor in sorted(x for x in notes if x[0] == para):
            number += 1
            at = joined.find(anchor, behind) if anchor else -1
            if at >= 0:
                behind = at + len(anchor)
                out.append((para, n, number, kept[behind - 1][1], kept[behind - 1][2] + 1))
            else:
                out.append((para, n, number, *((hosts[-1][0], len(hosts[-1][1])) if anchor else (hosts[0][0], 0))))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_notes(spark, seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice(["a", "b", "c", " ", "«", "»", "( )", " ", "ü"]) for _ in range(rng.randint(0, n)))
    segments = [(p, o, text(12)) for p in range(20) for o in range(1, rng.randint(1, 5)) if p % 7]
    notes = [(p, n, rng.choice(["a", "ab", "bc", "", "abc", "zz", "ü"])) for p in range(20) for n in range(1, rng.randint(1, 5))]
    s = spark.createDataFrame([(1, *x) for x in segments], "doc_id int, para int, ord int, content string").repartition(3)
    t = spark.createDataFrame([(1, *x, f"note {x[1]}") for x in notes], "doc_id int, para int, n int, anchor string, text string")
    assert sorted(tuple(r)[1:] for r in align.place_notes(s, t).collect()) == sorted(walk_notes(segments, notes))


def test_with_notes(spark):
    s = spark.createDataFrame([(1, 1, 1, "one two."), (1, 1, 2, "three four."), (1, 2, 1, "five")], "doc_id int, para int, ord int, content string")
    t = spark.createDataFrame([(1, 1, 1, "two.", "A"), (1, 1, 2, "three", "B"), (1, 1, 3, "gone", "C"), (1, 1, 4, "gone", None), (1, 2, 1, "", "D"), (1, 9, 1, "x", "E")], "doc_id int, para int, n int, anchor string, text string")
    got = [(r["para"], r["k"], r["content"], r["footnote"]) for r in align.with_notes(s, t).orderBy("para", "k", "ord").collect()]
    assert got == [
        (1, 0, "one two.[1]", False), (1, 0, "three[2] four.[4][3]", False), (1, 1, "[1] A", True), (1, 2, "[2] B", True), (1, 3, "[3] C", True), (1, 4, "[4] ", True), (2, 0, "[5] five", False), (2, 1, "[5] D", True),
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_windows(spark, seed):
    rng = random.Random(seed)
    words = ["alpha", "alpho", "beta", "betas", "gamma", "gama", "delta", "d"]
    corpus = {g: [rng.choice(words) for _ in range(rng.randint(0, 30))] for g in range(8)}
    queries = [(i, rng.randint(0, 8), [rng.choice(words) for _ in range(rng.randint(0, 4))]) for i in range(150)]
    want = {}
    for i, g, q in queries:
        canon = corpus.get(g, [])
        windows = [(sum(ratio(a, b) for a, b in zip(q, canon[at:])) / len(q), -at) for at in range(len(canon) - len(q) + 1) if q and any(a == b for a, b in zip(q, canon[at:]))]
        if windows and max(windows)[0] >= 85:
            want[i] = (-max(windows)[1], round(max(windows)[0], 6))
    got = align.aligned_windows(spark.createDataFrame(queries, "i int, group int, words array<string>"), spark.createDataFrame(list(corpus.items()), "group int, words array<string>"), ["i"])
    assert {r["i"]: (r["start"], round(r["score"], 6)) for r in got.collect()} == want and len(want) > 20


@pytest.mark.parametrize("seed", [1, 2])
def test_decide(spark, seed):
    rng = random.Random(seed)
    rows = [(g, i, rng.choice("mxy"), rng.choice(["m", "m", "x", "z", None])) for g in range(12) for i in range(rng.randint(1, 40))]
    want = {}
    for g, i, plain, behind in rows:
        want[g, i] = behind if i and want[g, i - 1] == "m" else plain
    df = spark.createDataFrame(rows, "g int, i int, p string, b string").repartition(3)
    got = decide.decide(df, ["g"], ["i"], F.col("p"), F.col("b"), "m")
    assert {(r["g"], r["i"]): r["kind"] for r in got.collect()} == want
    assert [r["k"] for r in df.limit(1).select(decide.first_of([(F.lit(None).cast("boolean"), "a"), (F.lit(False), "b"), (F.lit(True), "c")], "d").alias("k")).collect()] == ["c"]
