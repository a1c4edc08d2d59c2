"""Phrase lookup by a positional inverted index: which texts contain which needles, as text, not as words.

Texts and needles are split at single spaces.  A needle of three words or more
stands in a text where its inner words stand in a row and its outer ones end
and begin the words beside them; it is looked up by its rarest inner word, whose
place gives the place of all others.  Shorter needles have no whole word; while
they are few they meet the texts where these are read, two words by letters on
both sides of the space, one by its first letters at every place of a word.  Of
more needles the vocabulary's words are found first, by a few letters at an edge
or inside, and those words in the texts.  Every step is an equi-join, however
many needles there are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .ngram import BROADCAST_ROWS, small

#: Letters of a word by which short needles are looked up in the vocabulary, and on both sides of a space.
LETTERS = 3
#: First letters by which a needle of one word is looked up in the words of texts.
FIRST = 8


def positions(texts: DataFrame, key: list[str]) -> DataFrame:
    """(scope, word, key, pos, before, after) of every word of texts(scope, key, text); null texts have none."""
    parts, nothing = F.split("text", " ", -1), F.array(F.lit(None).cast("string"))
    # Shifted arrays, zipped: looking up neighbours place by place would split the text again for each.
    before, after = F.concat(nothing, F.slice(parts, F.lit(1), F.size(parts) - 1)), F.concat(F.slice(parts, F.lit(2), F.size(parts)), nothing)
    split = texts.filter("text is not null").select("scope", *key, F.posexplode(F.arrays_zip(parts.alias("word"), before.alias("before"), after.alias("after"))).alias("pos", "w"))
    return split.select("scope", "w.word", *key, "pos", "w.before", "w.after")


def _words(texts: DataFrame, key: list[str]) -> DataFrame:
    """(scope, word, key, pos) of every word; null texts have none."""
    return texts.filter("text is not null").select("scope", *key, F.posexplode(F.split("text", " ", -1)).alias("pos", "word"))


def _joined(each: DataFrame, needles: DataFrame) -> DataFrame:
    """each(scope, unit) with the few needles(scope, unit) of the same numbers: these are looked up faster than texts, and what is no match goes later."""
    other = F.broadcast(needles.withColumnRenamed("scope", "__scope"))
    mine, theirs = F.col("scope").cast("string"), F.col("__scope").cast("string")
    return each.join(other, "unit").filter(mine.startswith(theirs) & theirs.startswith(mine)).drop("__scope")  # equal scopes, but no key of the join


def _rarest(units: DataFrame, counts: DataFrame) -> DataFrame:
    """Of each needle's units(scope, needle, unit, at) the one that counts(scope, unit, n) has least; one that it does not have at all is rarest."""
    known = units.join(counts, ["scope", "unit"], "left")
    least = known.groupBy("scope", "needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "unit")).alias("u"))
    return least.select("scope", "needle", "u.unit", "u.at")


def _by_words(wanted: DataFrame, texts: DataFrame, key: list[str]) -> DataFrame:
    """Needles of three words or more."""
    inner = wanted.select("scope", "needle", F.posexplode(F.slice("parts", F.lit(2), F.size("parts") - 2)).alias("at", "unit"))
    # Only words of needles are counted and looked up.
    words = small(inner.select("scope", F.col("unit").alias("word")).distinct())
    mine = _words(texts, key).join(words, ["scope", "word"], "left_semi")
    rarest = written(_rarest(inner, mine.groupBy("scope", F.col("word").alias("unit")).agg(F.count(F.lit(1)).alias("n"))), "rarest")
    split = texts.filter("text is not null").select("scope", *key, F.split("text", " ", -1).alias("t"))
    start = (F.col("pos") - F.col("at") - 1).alias("start")
    if rarest.count() <= BROADCAST_ROWS:
        # Each text is met with the needles where it is read, and goes no further.
        each = split.select("scope", *key, "t", F.posexplode("t").alias("pos", "word")).withColumn("unit", F.xxhash64("scope", "word"))
        both = _joined(each, rarest.withColumn("unit", F.xxhash64("scope", "unit"))).select("scope", "needle", *key, "t", start).filter("start >= 0")
    else:
        found = rarest.join(mine.withColumnRenamed("word", "unit"), ["scope", "unit"])
        both = found.select("scope", "needle", *key, start).filter("start >= 0").join(split, ["scope", *key])
    p = F.split("needle", " ", -1)
    n = F.size(p)
    here = F.slice("t", F.col("start") + 1, n)
    fits = (F.size(here) == n) & (F.slice(here, F.lit(2), n - 2) == F.slice(p, F.lit(2), n - 2)) & F.element_at(here, 1).endswith(F.element_at(p, 1)) & F.element_at(here, -1).startswith(F.element_at(p, -1))
    return both.filter(F.coalesce(fits, F.lit(False))).select("scope", "needle", *key, "start")


def _letters(word: Column) -> Column:
    """All runs of one to LETTERS letters of a word."""

    def runs(n: int) -> Column:
        starts = F.when(F.length(word) >= n, F.sequence(F.lit(1), F.length(word) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(word, i, F.lit(n)))

    return F.array_distinct(F.concat(*map(runs, range(1, LETTERS + 1))))


def _edge(word: Column, side: str) -> Column:
    n = F.least(F.length(word), F.lit(LETTERS))
    return F.concat(F.lit(side), F.substring(word, F.lit(1), n) if side == "<" else F.substring(word, F.length(word) - n + 1, n))


def _by_letters(wanted: DataFrame, index: DataFrame, key: list[str]) -> DataFrame:
    """Needles of one or two words, by the vocabulary's words that they may begin, end or lie in."""
    first, last = F.element_at("parts", 1), F.element_at("parts", -1)
    # Of two words the longer one is looked up, at its inner edge: the end of the first, the beginning of the last.
    ends = (F.size("parts") == 2) & (F.length(first) >= F.length(last))
    begins = (F.size("parts") == 2) & ~ends
    words = written(index.select("scope", "word").distinct(), "vocabulary")
    w = F.col("word")
    edges = [F.when(F.length(w) >= n, F.concat(F.lit("<"), F.substring(w, F.lit(1), F.lit(n)))) for n in range(1, LETTERS + 1)] + [F.when(F.length(w) >= n, F.concat(F.lit(">"), F.substring(w, F.length(w) - n + 1, F.lit(n)))) for n in range(1, LETTERS + 1)]
    grams = words.select("scope", "word", F.explode(F.concat(_letters(w), F.array_compact(F.array(*edges)))).alias("unit"))
    whole = F.transform(F.sequence(F.lit(1), F.greatest(F.length("needle") - LETTERS + 1, F.lit(1))), lambda i: F.substring(F.col("needle"), i, F.lit(LETTERS)))
    asked = F.when(ends, F.array(_edge(first, ">"))).when(begins, F.array(_edge(last, "<"))).otherwise(F.array_distinct(whole))
    units = wanted.select("scope", "needle", F.posexplode(asked).alias("at", "unit"))
    chosen = small(written(_rarest(units, grams.join(small(units.select("scope", "unit").distinct()), ["scope", "unit"], "left_semi").groupBy("scope", "unit").agg(F.count(F.lit(1)).alias("n"))), "units"))
    near = chosen.drop("at").join(grams, ["scope", "unit"]).withColumn("parts", F.split("needle", " ", -1))
    fits = F.when(ends, w.endswith(first)).when(begins, w.startswith(last)).otherwise(w.contains(F.col("needle")))
    # Words that fit are few beside the places of all words, which are not shuffled then.
    found = small(written(near.filter(fits).select("scope", "needle", "parts", "word"), "fitting")).join(index, ["scope", "word"])
    beside = F.when(ends, F.col("after").startswith(last)).when(begins, F.col("before").endswith(first)).otherwise(True)
    return found.filter(F.coalesce(beside, F.lit(False))).select("scope", "needle", *key, (F.col("pos") - begins.cast("int")).alias("start"))


def _across(wanted: DataFrame, index: DataFrame, key: list[str]) -> DataFrame:
    """Few needles of two words, by the last letters of the first and the first letters of the last: no word is shuffled, however many words fit one side."""
    first, last = F.element_at("parts", 1), F.element_at("parts", -1)
    asked = wanted.withColumns({"before": F.least(F.length(first), F.lit(LETTERS)), "behind": F.least(F.length(last), F.lit(LETTERS))})
    sides = [(r["before"], r["behind"]) for r in asked.select("before", "behind").distinct().collect()]  # 15 at most

    def unit(a: Column, b: Column, n: int, m: int) -> Column:
        return F.xxhash64("scope", F.lit(LETTERS * n + m), *([F.substring(a, -n, n)] if n else []), *([F.substring(b, 1, m)] if m else []))

    chosen = reduce(lambda other, s: F.when((F.col("before") == s[0]) & (F.col("behind") == s[1]), unit(first, last, *s)).otherwise(other), sides, F.lit(None).cast("long"))
    needles = asked.select("scope", "needle", chosen.alias("unit"), first.alias("first"), last.alias("last"))
    each = index.filter("after is not null").select("scope", *key, "pos", "word", "after", F.explode(F.array(*(unit(F.col("word"), F.col("after"), *s) for s in sides))).alias("unit"))
    found = _joined(each, needles).filter(F.col("word").endswith(F.col("first")) & F.col("after").startswith(F.col("last")))
    return found.select("scope", "needle", *key, F.col("pos").alias("start"))


def _inside(wanted: DataFrame, texts: DataFrame, key: list[str]) -> DataFrame:
    """Few needles of one word, by their first letters at every place of every word."""
    n = F.least(F.length("needle"), F.lit(FIRST))
    needles = wanted.select("scope", "needle", F.substring(F.col("needle"), F.lit(1), n).alias("letters")).withColumn("unit", F.xxhash64("scope", "letters"))
    sizes = sorted(r[0] for r in wanted.select(n).distinct().collect())  # FIRST at most
    sized = _words(texts, key).filter(F.length("word") >= sizes[0]).select("scope", *key, "pos", "word", F.explode(F.array(*map(F.lit, sizes))).alias("n")).filter(F.length("word") >= F.col("n"))
    each = sized.select("scope", *key, "pos", "word", "n", F.explode(F.sequence(F.lit(1), F.length("word") - F.col("n") + 1)).alias("i")).select("scope", *key, "pos", "word", "i", F.xxhash64("scope", F.substring("word", F.col("i"), F.col("n"))).alias("unit"))
    # A word that has the letters twice counts once.
    found = _joined(each, needles).filter(F.col("word").contains(F.col("needle")) & (F.position("letters", "word") == F.col("i")))
    return found.select("scope", "needle", *key, F.col("pos").alias("start"))


def _spaces(wanted: DataFrame, index: DataFrame, key: list[str]) -> DataFrame:
    """The needle of one space: wherever a word has one behind it."""
    return index.filter("after is not null").join(F.broadcast(wanted.select("scope", "needle")), "scope").select("scope", "needle", *key, F.col("pos").alias("start"))  # a row for each scope


def occurrences(texts: DataFrame, needles: DataFrame, key: list[str]) -> DataFrame:
    """(scope, needle, key, start): every word of a text, counted from 0, in which an occurrence of a needle begins.

    texts(scope, key, text) has one row for each scope and key; needles(scope,
    needle) are looked up in texts of their scope only.  Null and empty needles
    and null texts give nothing.  Of several occurrences that begin in one word,
    one row.
    """
    wanted = needles.filter("needle <> ''").select("scope", "needle").distinct().withColumn("parts", F.split("needle", " ", -1))
    index = positions(texts, key)
    long, space, one = F.size("parts") > 2, F.col("needle") == " ", F.size("parts") == 1
    counts = {r[0]: r[1] for r in wanted.groupBy(F.when(long, "words").when(space, "space").when(one, "one").otherwise("two")).count().collect()}  # at most four rows
    kinds, few = set(counts), counts.get("one", 0) + counts.get("two", 0) <= BROADCAST_ROWS
    ways = []
    if "words" in kinds:
        ways.append(_by_words(wanted.filter(long), texts, key))
    if kinds & {"one", "two"} and not few:
        ways.append(_by_letters(wanted.filter(~long & ~space), index, key))
    if "two" in kinds and few:
        ways.append(_across(wanted.filter(~long & ~space & ~one), index, key))
    if "one" in kinds and few:
        ways.append(_inside(wanted.filter(one), texts, key))
    if "space" in kinds:
        ways.append(_spaces(wanted.filter(space), index, key))
    return reduce(DataFrame.unionByName, ways) if ways else index.select("scope", F.col("word").alias("needle"), *key, F.col("pos").alias("start")).limit(0)


def meetings(texts: DataFrame, needles: DataFrame, key: str | list[str], item: str | list[str], scope: str | None = None) -> DataFrame:
    """(key, item) for each word of a text in which an occurrence of the item's needle begins, so that a pair may come several times (see :func:`containing`)."""
    key, item = ([c] if isinstance(c, str) else c for c in (key, item))
    within = F.col(scope) if scope else F.lit("")
    named = needles.select(within.alias("scope"), *item, "needle")
    found = occurrences(texts.select(within.alias("scope"), *key, "text"), named, key).select("scope", "needle", *key)
    if named.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        # Items come first where that shuffles nothing: needles are not carried along.
        return found.join(F.broadcast(named), ["scope", "needle"]).select(*key, *item)
    return found.distinct().join(named, ["scope", "needle"]).select(*key, *item)


def containing(texts: DataFrame, needles: DataFrame, key: str | list[str], item: str | list[str], scope: str | None = None) -> DataFrame:
    """(key, item) where the text contains the item's needle; with ``scope``, a column of both, only where that is equal."""
    return meetings(texts, needles, key, item, scope).distinct()
