"""Glossary lookup: the longest entry first, from left to right, with affixes off the first word."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text as T
from ..functions.arrays import let
from ..sources.scratch import written
from .ngram import small

# Honorific formulas, particles and dictionary labels.
HONORIFICS = (
    "رحمه الله", "رحمها الله", "رحمهم الله", "رحمهما الله", "رحمهن الله", "رحمك الله", "رحمكم الله", "رحمكما الله", "رحمكن الله", "رحمني الله", "رحمنا الله",
    "رضي الله عنه", "رضي الله عنها", "رضي الله عنهم", "رضي الله عنهما", "صلى الله عليه وسلم", "صلى الله عليه واله وسلم", "عليه السلام", "عليهم السلام", "عليهما السلام",
    "عليه الصلاة والسلام", "سبحانه وتعالى", "عز وجل", "جل جلاله", "تبارك وتعالى",
)
PARTICLES = ("وهم", "هم", "وهو", "هو", "وهي", "هي")
LABELS = {"terms": "مصطلح", "alam": "عَلَم", "amaken": "مكان", "asmaa": "اسم وصفة", "feraq": "فرقة", "sefat": "صفة"}
CATEGORIES = {"terms": "term", "alam": "person", "amaken": "place", "asmaa": "divine_name", "feraq": "sect", "sefat": "attribute"}
TERMS = "array<struct<arabic:string,english:string,kind:string,label:string,note:string,surface:string>>"


def dictionary(entries: DataFrame, config: Config = Config(), frequencies: DataFrame | None = None) -> DataFrame:
    """(form, head, n, entry) of glossary(arabic, english, dict, note): entries by lexical form, as far as the configuration lets them in.

    Of entries of one form that with the greatest (arabic, english, dict, note)
    stays.  Words that ``frequencies``(word, df, books) has in too many books
    are left out.
    """
    kind = F.coalesce(F.col("dict"), F.lit("terms"))
    named = entries.select("arabic", "english", kind.alias("kind"), "note", T.lexical(F.col("arabic")).alias("form")).filter("form <> ''")
    if config.glossary_dicts:
        named = named.filter(F.col("kind").isin(*config.glossary_dicts))
    if frequencies is not None and config.term_df_max < 1:
        common = frequencies.filter(F.col("df") / F.greatest("books", F.lit(1)) >= config.term_df_max).select(F.col("word").alias("arabic"))
        named = named.join(common, "arabic", "left_anti")
    kept = named.groupBy("form").agg(F.max(F.struct("arabic", "english", "kind", "note")).alias("entry"))
    words = F.split("form", " ")
    return kept.withColumns({"head": words[0], "n": F.size(words)}).filter(F.col("n").between(config.term_min_words, config.phrase_max))


def _blocked(words: Column) -> Column:
    """Places (from 0) of words that belong to an honorific formula."""
    spelled = [h.translate(str.maketrans(T.SPELLING_FROM, T.SPELLING_TO)) for h in HONORIFICS]
    formulas = {n: [h for h in spelled if len(h.split()) == n] for n in range(2, 7)}
    nowhere = F.array().cast("array<int>")

    def here(i: Column) -> Column:
        found = reduce(lambda rest, n: F.when(F.array_join(F.slice(words, i + 1, n), " ").isin(*formulas[n]), F.sequence(i, i + n - 1)).otherwise(rest), (n for n in sorted(formulas) if formulas[n]), nowhere)
        return F.when(F.get(words, i).isin(*{h.split()[0] for hs in formulas.values() for h in hs}), found).otherwise(nowhere)

    return F.array_distinct(F.flatten(F.transform(T.places(words), here)))


def _free(words: Column) -> Column:
    """Places of words that belong to no formula; a text without the first word of one has no other places taken off."""
    spelled = [h.translate(str.maketrans(T.SPELLING_FROM, T.SPELLING_TO)) for h in HONORIFICS]
    return F.when(F.arrays_overlap(words, F.array(*map(F.lit, sorted({h.split()[0] for h in spelled})))), F.array_except(T.places(words), _blocked(words))).otherwise(T.places(words))


def term_hits(rows: DataFrame, entries: DataFrame, key: list[str], column: str = "content") -> DataFrame:
    """(key, pos, n, form_order, word, entry, surface): every entry of a :func:`dictionary` that begins at a word of a text, with affixes off its first word.

    Affixes are taken off the distinct words only; the forms that head some
    entry go back to the texts with the lengths of the entries they head, and
    phrases of those lengths are joined with the entries.
    """
    entries = small(written(entries, "glossary-entries"))
    # Words are not exploded from a column of their own: the filter that Spark makes of that would split the texts again.
    texts, words = rows.select(*key, T.lexical(F.col(column)).alias("form")), T.spaced_words(F.col("form"))
    heads = entries.groupBy("head").agg(F.sort_array(F.collect_set("n")).alias("sizes"))
    # Words without Arabic letters have no affixes.
    reduced = F.when(F.col("word").rlike("[\u0600-\u06ff]"), T.affix_forms(F.col("word"))).otherwise(F.array("word"))
    forms = texts.select(F.explode(words).alias("word")).distinct().select("word", F.posexplode(reduced).alias("form_order", "head"))
    lead = small(written(forms.join(heads, "head"), "glossary-leads"))
    # Words stay in their array: only those that lead to an entry are cut out with the words behind them.
    tokens = texts.select(*key, words.alias("words")).select(*key, "words", F.explode(_free(F.col("words"))).alias("pos"))
    rest = F.slice("words", F.col("pos") + 2, Config().phrase_max - 1)
    tokens = tokens.select(*key, "pos", F.get("words", F.col("pos")).alias("word"), rest.alias("rest"))
    sized = tokens.join(lead, "word").withColumn("n", F.explode("sizes")).filter(F.col("n") <= F.size("rest") + 1)
    tail = F.array_join(F.slice("rest", F.lit(1), F.col("n") - 1), " ")
    phrased = sized.select(*key, "pos", "n", "form_order", "word", F.when(F.col("n") > 1, F.concat_ws(" ", "head", tail)).otherwise(F.col("head")).alias("form"), F.when(F.col("n") > 1, F.concat_ws(" ", "word", tail)).otherwise(F.col("word")).alias("surface"))
    return phrased.join(entries.select("form", "entry"), "form").select(*key, "pos", "n", "form_order", "word", "entry", "surface")


def with_terms(rows: DataFrame, glossary: DataFrame, key: list[str], column: str = "content", config: Config = Config(), frequencies: DataFrame | None = None) -> DataFrame:
    """rows with ``terms``: the longest entry first, from left to right, each entry once, in order of first occurrence.

    ``key`` tells rows apart.  A text's hits are folded in their order: a phrase
    of several words takes the words it covers; a single word counts unless it
    is a particle, or all entries of its forms have been found before.  Texts
    that are null or without a hit have no terms.  The glossary is joined, so
    that it may have any size.
    """
    hits = term_hits(rows, dictionary(glossary, config, frequencies), key, column)
    kind = F.when(F.col("entry.kind").isin(*LABELS), F.col("entry.kind")).otherwise("terms")
    label = F.element_at(F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv)), kind)
    term = F.struct(F.col("entry.arabic").alias("arabic"), F.col("entry.english").alias("english"), F.col("entry.kind").alias("kind"), label.alias("label"), F.col("entry.note").alias("note"), "surface")
    # At each place the longest phrase, of equal ones by the least reduced form; else all single words, least reduced first.
    choice = F.struct((-F.col("n")).alias("shorter"), "form_order", "n", term.alias("term"))
    places = hits.filter((F.col("n") > 1) | ~F.col("word").isin(*PARTICLES)).groupBy(*key, "pos").agg(F.array_sort(F.collect_list(choice)).alias("choices"))
    ordered = places.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "choices"))).alias("places"))
    none = F.lit(None).cast(TERMS.replace("array<", "", 1)[:-1])
    head = lambda place: F.get(place["choices"], F.lit(0))

    def pick(done: Column, place: Column) -> Column:
        """Which places count depends on the words taken before only, not on the terms."""
        free = place["pos"] >= done["next"]
        return F.when(free, F.struct((place["pos"] + head(place)["n"]).alias("next"), F.concat(done["picked"], F.array(place["pos"])).alias("picked"))).otherwise(done)

    picked = F.aggregate("places", F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("picked")), pick, lambda done: done["picked"])
    counted = let(picked, lambda taken: F.filter("places", lambda p: F.array_contains(taken, p["pos"])))

    def news(places: Column) -> Column:
        """A place that can give one entry only says nothing new after the first one that gives it."""
        sure = F.transform(places, lambda p: F.when((head(p)["n"] > 1) | (F.size(p["choices"]) == 1), head(p)["term"]["arabic"]))
        return let(sure, lambda names: F.filter(places, lambda p, i: F.coalesce(F.array_position(names, F.get(names, i)) == i + 1, F.lit(True))))

    def take(terms: Column, place: Column) -> Column:
        known = F.transform(terms, lambda t: t["arabic"])
        new = F.get(F.filter(place["choices"], lambda c: ~F.array_contains(known, c["term"]["arabic"]) & ((c["n"] == head(place)["n"]) & (c["form_order"] == head(place)["form_order"]) | (head(place)["n"] == 1))), F.lit(0))["term"]
        return F.array_compact(F.concat(terms, F.array(F.coalesce(new, none))))

    terms = let(counted, lambda places: let(news(places), lambda some: F.aggregate(some, F.array().cast(TERMS), take)))
    folded = ordered.select(*key, terms.alias("terms"))
    return rows.join(folded, key, "left").withColumn("terms", F.coalesce("terms", F.array().cast(TERMS)))


def keep_listed(rows: DataFrame, keep: list[str] | None, config: Config = Config()) -> DataFrame:
    """Terms numbered ``segment.term`` (segments from 1 within a batch) that a reviewer lists stay; a failed review keeps all.

    rows needs ``number`` (of the segment in its batch) and ``terms``.
    """
    if keep is None:
        return rows
    listed = F.array(*map(F.lit, keep)) if keep else F.array().cast("array<string>")
    numbered = F.transform("terms", lambda t, i: F.struct(t.alias("t"), F.concat(F.col("number").cast("string"), F.lit("."), (i + 1).cast("string")).alias("id")))
    return rows.withColumn("terms", F.transform(F.filter(numbered, lambda x: F.array_contains(listed, x["id"])), lambda x: x["t"]))


def surfaces(rows: DataFrame) -> DataFrame:
    """Each term's surface as it stands in the text, whole words and with diacritics."""
    return rows.withColumn("terms", F.transform("terms", lambda t: t.withField("surface", T.surface(F.col("content"), F.coalesce(t["surface"], t["arabic"])))))
