"""Matching against reference corpora: candidates, fuzzy verification, anchors.

All of them are joins on n-grams, words or keys, which scale with both sides;
similarity runs on the pairs that are left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text as T
from ..functions.similarity import combined_udf, partial_ratio_udf, ratio_udf
from ..sources.scratch import written
from . import phrases as P
from .ngram import small, top_hits

# Patterns of references.
REFERENCE = "سورة\\s+(.+?)\\s+[—–-]\\s+(\\d+)"
FUZZY_ANCHOR, COVERS = 0.6, 90.0


def reference_forms(corpus: DataFrame) -> DataFrame:
    """corpus(ref_id, text, ...) with norm, norm2 (null if equal), words and n_words."""
    norm, expanded = T.normalize(F.col("text")), T.normalize(T.expand_dagger(F.col("text")))
    forms = corpus.withColumns({"norm": norm, "norm2": F.when(expanded != norm, expanded)})
    spellings = F.array_compact(F.array("norm", "norm2", T.split_vocative(F.col("norm")), T.split_vocative(F.col("norm2"))))
    return forms.withColumns({"spellings": F.array_distinct(spellings), "words": F.array_distinct(F.flatten(F.transform(spellings, T.words))), "n_words": F.size(T.words(F.col("norm")))})


def _grams(spellings: Column, n: int) -> Column:
    return F.explode(F.array_distinct(F.flatten(F.transform(spellings, lambda s: T.ngrams(T.words(s), n)))))


def match_texts(queries: DataFrame, corpus: DataFrame, config: Config = Config(), *, every_record: bool = True, key: str = "key", least: float = 0.0) -> DataFrame:
    """(key, ref_id, score): the best reference of each query(key, text, short, prefer); queries without a candidate are left out.

    Candidates share 3-grams; those without any, 2-grams (of records of up to
    eight words, or of all with ``every_record``); short ones without any, single
    words of records of up to three.  The five with most hits (ties: smaller
    ref_id) are scored.  ``prefer`` names a group (column ``surah``): its best
    record wins within a margin.  Texts in the old spelling are also tried in
    the new; the better attempt counts.  Matches that score below ``least`` are
    left out, and cost little.
    """
    refs = reference_forms(corpus)
    first = F.struct(F.lit(0).alias("attempt"), T.normalize(F.col("text")).alias("query"))
    second = F.when(T.has_old_spelling(F.col("text")), F.struct(F.lit(1).alias("attempt"), T.normalize(T.expand_dagger(F.col("text"))).alias("query")))
    tries = lambda asked: asked.select(key, "short", "prefer", F.explode(F.array_compact(F.array(first, second))).alias("t")).select(key, "short", "prefer", "t.attempt", "t.query")
    # All sizes in one pass over the queries; the longest size with a hit counts.
    sizes = {config.ngram: refs, config.ngram_fallback: refs if every_record else refs.filter(F.col("n_words") <= config.fallback_max_words), 1: refs.filter(F.col("n_words") <= config.unigram_max_words)}
    index = reduce(DataFrame.unionByName, (records.select("ref_id", _grams(F.col("spellings"), n).alias("gram")).withColumn("gram", F.concat(F.lit(f"{n} "), "gram")) for n, records in sizes.items()))
    single = F.col("short") & (F.size("qwords") <= config.unigram_max_words)
    # Grams are made at each place, in generated code that the join with the index goes on in, and not in lambdas.
    starts = tries(queries).withColumn("qwords", T.spaced_words(F.col("query"))).select(key, "attempt", "qwords", single.alias("single"), F.explode(T.places(F.col("qwords"))).alias("i"))
    here = lambda n: F.when((F.size("qwords") - F.col("i") >= n) & (F.lit(True) if n > 1 else F.col("single")), F.concat(F.lit(f"{n} "), T.gram(F.col("qwords"), F.col("i"), n)))
    grams = starts.select(key, "attempt", F.explode(F.array(*(F.struct(F.lit(n).alias("n"), here(n).alias("gram")) for n in sizes))).alias("g")).select(key, "attempt", "g.n", "g.gram").filter("gram is not null")
    hits = top_hits(grams, index, [key, "attempt", "n"], "ref_id", config.candidates)
    longest = F.max("n").over(Window.partitionBy(key, "attempt"))
    top = written(hits.withColumn("__n", longest).filter(F.col("n") == F.col("__n")).select(key, "attempt", "ref_id"), "match-top")
    # Similarity is worth a task for each core, however few bytes its pairs have.
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Only queries with a candidate are normalised once more.
    asked = tries(queries.join(small(top.select(key).distinct()), key, "left_semi"))
    pairs = small(top).join(asked, [key, "attempt"]).repartition(parts, key, "attempt")
    details = refs.select("ref_id", F.array("norm", "norm2").alias("forms"), "words", T.normalize(F.col("surah").cast("string")).alias("group"))
    scored = pairs.join(small(details), "ref_id").withColumn("score", combined_udf(least)("query", "forms", "words")).filter("score > 0")
    wanted = F.coalesce(T.normalize(F.col("prefer")), F.lit(""))
    best = F.max("score").over(Window.partitionBy(key, "attempt"))
    favoured = (wanted != "") & (F.col("group") == wanted) & (F.col("score") >= best - config.prefer_margin / 100)
    tops = scored.withColumn("__best", best).withColumn("__fav", favoured.cast("int"))
    tops = tops.withColumn("__r", F.row_number().over(Window.partitionBy(key, "attempt").orderBy(F.desc("__fav"), F.desc("score"), "ref_id"))).filter("__r = 1")
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "attempt"))
    return tops.withColumn("__l", last).filter("__l = 1").select(key, "ref_id", "score")


def reference_parts(text: Column, pattern: str = "(?U)" + REFERENCE) -> Column:
    """(name, number) of a reference; an empty name and null if it is none."""
    return F.struct(F.regexp_extract(text, pattern, 1).alias("name"), F.regexp_extract(text, pattern, 2).try_cast("int").alias("number"))


def parse_references(rows: DataFrame, verses: DataFrame, column: str = "reference") -> DataFrame:
    """rows with surah_no and ayah_no of the verse that a reference names, null if there is none."""
    names = verses.select(T.normalize(F.col("surah_name")).alias("__name"), "surah_no", "ayah_no")
    parts = reference_parts(F.col(column))
    parsed = rows.withColumns({"__n": T.normalize(parts["name"]), "__a": parts["number"]})
    return parsed.join(small(names), (F.col("__n") == F.col("__name")) & (F.col("__a") == F.col("ayah_no")), "left").drop("__n", "__a", "__name")


def exact_anchors(forms: DataFrame, verses: DataFrame) -> DataFrame:
    """(phrase_id, surah_no, ayah_no, rank): the verses that a phrase names (1), and those that contain its plain (2) or a normal form (3).

    forms(phrase_id, reference, q) has the forms in q(clean, normal, expanded);
    verses has the four derived columns.  Containment is looked up in an index
    of positions (see phrases.py), without meeting all verses.
    """
    # Phrases are few beside verses: these are not shuffled by their names, and only those of a number that is asked for are normalised.
    parts = reference_parts(F.col("reference"))
    asked = forms.select("phrase_id", T.normalize(parts["name"]).alias("__name"), parts["number"].alias("__a")).filter("__a is not null")
    numbers = small(asked.select("__a").distinct())
    names = verses.join(numbers, F.col("ayah_no") == F.col("__a"), "left_semi").filter("surah_no is not null").select("surah_no", "ayah_no", T.normalize(F.col("surah_name")).alias("__named"))
    by_name = names.join(small(asked), (F.col("__named") == F.col("__name")) & (F.col("ayah_no") == F.col("__a"))).select("phrase_id", "surah_no", "ayah_no", F.lit(1).alias("rank"))
    fields = {"clean_imlaei": 2, "clean_uthmani": 2, "normalized_imlaei": 3, "normalized_uthmani": 3}
    # Fields of one rank that are equal are looked up once.
    texts = verses.select("surah_no", "ayah_no", F.posexplode(F.array_distinct(F.array(*(F.struct(F.lit(rank).alias("rank"), F.col(c).alias("text")) for c, rank in fields.items())))).alias("field", "t"))
    texts = texts.select("surah_no", "ayah_no", "field", "t.rank", "t.text")
    wanted = F.explode(F.array_distinct(F.array(*(F.struct(F.lit(rank).alias("rank"), F.col(f"q.{form}").alias("needle")) for form, rank in (("clean", 2), ("normal", 3), ("expanded", 3))))))
    needles = forms.select("phrase_id", wanted.alias("w")).select("phrase_id", "w.rank", "w.needle")
    # What comes several times is one in the end: it is not made distinct before.
    found = P.meetings(texts, needles, ["surah_no", "ayah_no", "field"], ["phrase_id", "rank"], "rank")
    anchors = by_name.unionByName(found.select(*by_name.columns))
    return anchors.groupBy("phrase_id", "surah_no", "ayah_no").agg(F.min("rank").alias("rank"))


def find_verses(phrases: DataFrame, verses: DataFrame, config: Config = Config()) -> DataFrame:
    """(phrase_id, surah_no, ayah_no, method, exact_full): the first anchor whose verse covers the phrase.

    Anchors in order: the phrase's reference, verses that contain its plain
    form, verses that contain a normal form, the best fuzzy match.  verses has
    the four derived columns; phrases has text and reference.
    """
    forms = phrases.select("phrase_id", "text", "reference", T.query_forms(F.col("text")).alias("q")).filter("q.normal <> ''")
    texts = verses.select("surah_no", "ayah_no", "clean_imlaei", "clean_uthmani", "normalized_imlaei", "normalized_uthmani")
    corpus = verses.select(F.struct("surah_no", "ayah_no").alias("ref_id"), F.col("text_uthmani").alias("text"), F.col("surah_name").alias("surah"))
    asked = forms.select(F.col("phrase_id").alias("key"), T.quoted_part(F.col("text")).alias("text"), F.lit(False).alias("short"), F.lit("").alias("prefer"))
    fuzzy = match_texts(asked, corpus, config, least=FUZZY_ANCHOR).select(F.col("key").alias("phrase_id"), "ref_id.surah_no", "ref_id.ayah_no", F.lit(4).alias("rank"))
    anchors = exact_anchors(forms, verses).unionByName(fuzzy).groupBy("phrase_id", "surah_no", "ayah_no").agg(F.min("rank").alias("rank"))
    pairs = anchors.join(forms.select("phrase_id", "q"), "phrase_id").join(small(texts), ["surah_no", "ayah_no"])
    wanted = F.array_distinct(F.filter(F.array("q.normal", "q.expanded"), lambda f: f != ""))
    each = pairs.withColumn("__form", F.explode(wanted)).withColumn("__text", F.explode(F.array("normalized_imlaei", "normalized_uthmani")))
    alike = F.when(F.length("__text") >= F.length("__form"), partial_ratio_udf("__form", "__text")).otherwise(ratio_udf("__form", "__text"))
    covered = each.withColumn("__covers", F.col("__text").contains(F.col("__form")) | (alike >= COVERS))
    whole = F.col("q.clean").isin(F.col("clean_imlaei"), F.col("clean_uthmani")) | (F.col("__form") == F.col("__text"))
    verified = covered.groupBy("phrase_id", "rank", "surah_no", "ayah_no").agg(F.bool_or("__covers").alias("covers"), F.bool_or(whole).alias("exact_full")).filter("covers")
    first = F.row_number().over(Window.partitionBy("phrase_id").orderBy("rank", "surah_no", "ayah_no"))
    method = F.element_at(F.array(*map(F.lit, ("reference", "clean", "normalized", "fuzzy"))), F.col("rank"))
    return verified.withColumn("__r", first).filter("__r = 1").select("phrase_id", "surah_no", "ayah_no", method.alias("method"), "exact_full")


def nearby_verses(rows: DataFrame, verses: DataFrame, before: int = 1, after: int = 3) -> DataFrame:
    """Each row (surah, ayah) with the corpus rows from ``before`` before it to ``after`` behind it, in order."""
    near = verses.select(F.col("surah").alias("__s"), F.col("ayah").alias("near_ayah"), F.col("text").alias("near_text"))
    return rows.join(small(near), (F.col("surah") == F.col("__s")) & F.col("near_ayah").between(F.col("ayah") - before, F.col("ayah") + after)).drop("__s")


def review_candidates(queries: DataFrame, corpora: dict[str, DataFrame], top: int = 4, key: str = "key") -> DataFrame:
    """(key, kind, ref_id, score): the best candidates of several corpora together, by partial similarity with their normal form.

    Only these may be chosen by a reviewer.
    """
    from .ngram import candidates

    words = queries.select(key, T.normalize(F.col("text")).alias("query")).withColumn("words", T.words(F.col("query")))
    found: list[DataFrame] = []
    for kind, corpus in corpora.items():
        refs = corpus.select("ref_id", T.normalize(F.col("text")).alias("norm")).withColumn("words", T.words(F.col("norm")))
        hits = candidates(words.select(key, "words"), refs, key, "ref_id", 3, top).join(small(refs.select("ref_id", "norm")), "ref_id")
        found.append(hits.join(words.select(key, "query"), key).select(key, F.lit(kind).alias("kind"), "ref_id", (partial_ratio_udf("query", "norm") / 100).alias("score")))
    every = reduce(DataFrame.unionByName, found)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "kind", "ref_id"))
    return every.withColumn("__r", rank).filter(F.col("__r") <= top).drop("__r")
