"""Glossary lookup by joins against a plain walk over the words."""

import random

import pytest
from pyspark.sql import functions as F

from glosstream.config import Config
from glosstream.functions import plain
from glosstream.operators import glossary as G

KINDS = "arabic string, english string, dict string, note string"


def walk(text, entries):
    """Terms of a text, by trying all lengths and forms at each word."""
    by_form = {}
    for e in sorted(entries):
        by_form[plain.lexical(e[0])] = e
    words, out, i = plain.lexical(text).split(), [], 0
    formulas = {tuple(plain.lexical(h).split()) for h in G.HONORIFICS}
    blocked = {j for k in range(len(words)) for n in range(2, 7) if tuple(words[k : k + n]) in formulas for j in range(k, k + n)}
    while i < len(words):
        step = 1
        if i not in blocked:
            forms = plain.affix_forms(words[i])
            tries = [(n, " ".join([f, *words[i + 1 : i + n]])) for n in range(min(8, len(words) - i), 1, -1) for f in forms]
            long = next(((n, f) for n, f in tries if f in by_form), None)
            if long:
                step = long[0]
                found = [by_form[long[1]][0]]
            else:
                found = [by_form[f][0] for f in forms if f in by_form and by_form[f][0] not in out][:1] if words[i] not in G.PARTICLES else []
            out += [a for a in found if a not in out]
        i += step
    return out


WORDS = ["رحم", "الله", "رحمه", "صلاة", "الصلاة", "بالصلاة", "الجماعة", "إخلاص", "الإخلاص", "هم", "وهم", "كتاب", "وكتابهم", "عز", "وجل", "صبر", "a", "b", "c", "a.", "(b)"]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_walk(spark, seed):
    rng = random.Random(seed)
    entries = [(" ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 1, 2, 2, 3]))), "x", rng.choice(["terms", None]), None) for _ in range(25)]
    entries = [e for e in entries if plain.lexical(e[0])]
    texts = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 25)))) for i in range(120)] + [(120, None), (121, ""), (122, "...")]
    rows = spark.createDataFrame(texts, "k int, content string").repartition(3)
    got = {r["k"]: [t["arabic"] for t in r["terms"]] for r in G.with_terms(rows, spark.createDataFrame(entries, KINDS), ["k"]).collect()}
    assert got == {k: walk(t or "", [(a, b or "", c or "", d or "") for a, b, c, d in entries]) for k, t in texts}


def test_terms_and_their_fields(spark):
    entries = spark.createDataFrame([("رحم", "womb", "terms", "n"), ("إخلاص", "sincerity", "terms", ""), ("صلاة الجماعة", "congregation", None, ""), ("صلاة", "prayer", "terms", ""), ("عمر", "Umar", "alam", "")], KINDS)
    rows = spark.createDataFrame([(1, "رحمه الله على الصلاة الجماعة والإخلاص والصلاة عمر"), (2, None)], "k int, content string")
    got = {r["k"]: r["terms"] for r in G.with_terms(rows, entries, ["k"]).collect()}
    assert [(t["arabic"], t["english"], t["kind"], t["surface"]) for t in got[1]] == [("صلاة الجماعة", "congregation", "terms", "الصلاة الجماعة"), ("إخلاص", "sincerity", "terms", "والاخلاص"), ("صلاة", "prayer", "terms", "والصلاة")] and got[2] == []
    every = G.with_terms(rows, entries, ["k"], config=Config(glossary_dicts=())).filter("k = 1").first()["terms"]
    assert (every[-1]["arabic"], every[-1]["label"]) == ("عمر", "عَلَم")
    common = spark.createDataFrame([("إخلاص", 9, 10)], "word string, df int, books int")
    assert [t["arabic"] for t in G.with_terms(rows, entries, ["k"], frequencies=common).filter("k = 1").first()["terms"]] == ["صلاة الجماعة", "صلاة"]
    shown = G.surfaces(G.with_terms(rows, entries, ["k"])).filter("k = 1").first()["terms"]
    assert [t["surface"] for t in shown] == ["الصلاة الجماعة", "والإخلاص", "والصلاة"]
    numbered = G.with_terms(rows, entries, ["k"]).withColumn("number", F.col("k"))
    assert [[t["arabic"] for t in r["terms"]] for r in G.keep_listed(numbered, ["1.2"]).orderBy("k").collect()] == [["إخلاص"], []]


def test_many_entries_under_one_head(spark):
    """Entries that begin alike meet only phrases of their own length and words."""
    entries = spark.range(5000).select(F.concat(F.lit("a b"), F.col("id").cast("string")).alias("arabic"), F.lit("x").alias("english"), F.lit("terms").alias("dict"), F.lit("").alias("note"))
    rows = spark.range(200).select(F.col("id").alias("k"), F.concat(F.lit("a b"), (F.col("id") * 30).cast("string"), F.lit(" a c")).alias("content"))
    hits = G.term_hits(rows, G.dictionary(entries), ["k"])
    assert hits.count() == 167 and G.with_terms(rows, entries, ["k"]).filter(F.size("terms") == 1).count() == 167
