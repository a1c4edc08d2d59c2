"""Rows for export: the payload, the pipeline sheet, the book's rows and footnotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import written
from ..functions.dates import local_day
from ..functions.identity import phrase_id
from . import context

# Vocabularies and labels.
KIND = {"quran": "quran", "hadith": "hadith", "athar": "athar", "title": "heading", "author": "author", "attribution": "attribution", "citation": "citation", "term": "term", "text": "plain", "uncertain": "plain"}
CONTENT_TYPE = {"quran": 1, "hadith": 2, "athar": 3}
TEXT_TYPE, FOOTNOTE_TYPE = 4, 5
CONTENT_NAME = {1: "ayah", 2: "hadith", 3: "athar", 4: "text", 5: "footnote", 6: "heading", 7: "author"}
CONFIDENCE = {"title": 1.0, "attribution": 0.6, "citation": 1.0, "term": 0.6, "text": 0.4, "athar": 0.6, "uncertain": 0.2}
REASON = {"title": "word_heading_style", "attribution": "attribution_formula", "citation": "citation_ref", "term": "glossary_entry"}
UNMATCHED_VERSE, UNMATCHED_TRADITION = "فيه قوس آية ولم تبلغ المطابقة العتبة", "اقتباسٌ لم تبلغ مطابقتُه العتبة"
VARIANT, CITATION_NOTE = "يخالف رسم المصحف", "إحالة مصدر"
HEADINGS = {"heading1": "h1", "heading2": "h2", "heading3": "h3", "heading4": "h3", "heading5": "h3"}
SUB_TYPES = {"ayah": "aya", "hadith": "hadith", "athar": "athar"}
CATEGORY = {"terms": "term", "alam": "person", "amaken": "place", "asmaa": "divine_name", "feraq": "sect", "sefat": "attribute"}
SOURCING = "^\\s*[(\\[]?\\s*(رواه|أخرجه|خرّجه|خرجه|متفق عليه|صححه|صحّحه|حسنه|حسّنه|ضعفه|ضعّفه|صحيح|حسن|ضعيف|انظر|ينظر|أخرج|رواية|في صحيح|في سنن|في مسند)"
MARKER = "(\\[\\d+\\])"


def lookup(table: dict, key: Column, default=None) -> Column:
    found = F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def confidence(kind: Column, score: Column, note: Column) -> Column:
    """A variant reading is doubtful whatever its score; then the score, the citation, the two unmatched notes, the kind."""
    note = F.coalesce(note, F.lit(""))
    return (
        F.when((kind == "quran") & note.contains(VARIANT), 0.2)
        .when(kind.isin("quran", "hadith", "athar") & score.isNotNull(), F.bround(score, 3))
        .when(note == CITATION_NOTE, 1.0)
        .when(note == UNMATCHED_VERSE, 0.2)
        .when(note == UNMATCHED_TRADITION, 0.25)
        .otherwise(lookup(CONFIDENCE, kind, 0.4))
    )


def reason_code(kind: Column, score: Column, note: Column) -> Column:
    note = F.coalesce(note, F.lit(""))
    return (
        F.when((kind == "quran") & note.contains(VARIANT), "unmatched_quran")
        .when(kind.isin("quran", "hadith") | (kind == "athar") & score.isNotNull(), "index_match")
        .when(note == UNMATCHED_VERSE, "unmatched_quran")
        .when(note == UNMATCHED_TRADITION, "unmatched_hadith")
        .when(note == CITATION_NOTE, "citation_ref")
        .otherwise(lookup(REASON, kind, "no_evidence"))
    )


def sheet_rows(segments: DataFrame) -> DataFrame:
    """The pipeline sheet: numbers, tags, types, confidence and its reason for each segment."""
    doc = Window.partitionBy("doc_id").orderBy("para", "ord")
    heading = (F.col("kind") == "title") & (F.col("level") > 0)
    tag = F.when(F.col("footnote"), "footnote").when(heading, F.concat(F.lit("heading"), F.least("level", F.lit(5)).cast("string"))).otherwise("p")
    numbered = context.csv_ids(segments.withColumn("seq", F.row_number().over(doc)), "doc_id", "para", "ord")
    return numbered.withColumns(
        {
            "tag": tag,
            "align": F.when(heading, "center").otherwise("right"),
            "direction": F.lit("rtl"),
            "text_type": F.when(F.col("footnote"), "footnote").otherwise("p"),
            "content_type_id": F.when(F.col("footnote"), FOOTNOTE_TYPE).otherwise(lookup(CONTENT_TYPE, F.col("kind"), TEXT_TYPE)),
            "confidence": confidence(F.col("kind"), F.col("score"), F.col("note")),
            "reason_code": reason_code(F.col("kind"), F.col("score"), F.col("note")),
            "translatable": F.lit(True),
        }
    )


def phrases(rows: DataFrame, titles: DataFrame) -> DataFrame:
    """Sheet rows as phrases with their stable ids; titles(doc_id, title)."""
    joined = rows.join(titles, "doc_id")
    return joined.withColumn("phrase_id", phrase_id(F.col("title"), F.col("para_no"), F.col("ord"), F.col("content")))


def payload(rows: DataFrame, low: float = 0.3) -> DataFrame:
    """(doc_id, title, payload): each document and its phrases as JSON; null keys are left out."""
    terms = F.when(
        F.size("terms") > 0,
        F.transform("terms", lambda t: F.struct(t["arabic"].alias("ar"), F.when(t["english"] != "", t["english"]).alias("en"), t["surface"].alias("surface"), lookup(CATEGORY, F.coalesce(t["kind"], F.lit("terms")), "term").alias("category"))),
    )
    kind = lookup(KIND, F.col("kind"), "plain")
    analysis = F.struct(kind.alias("kind"), "confidence", "reason_code", F.when(F.col("source") != "", F.col("source")).alias("source"), terms.alias("terms"))
    item = F.struct(
        "seq", "phrase_id", F.col("para_no").alias("group_id"), F.col("ord").alias("group_order"), F.col("content").alias("arabic_text"), "content_type_id", lookup(CONTENT_NAME, F.col("content_type_id")).alias("content_type_name"),
        "tag", "text_type", "align", "direction", "translatable", analysis.alias("analysis"),
    )
    grouped = rows.withColumns({"__item": item, "__kind": kind}).groupBy("doc_id", "title").agg(
        F.count_distinct("para_no").alias("paragraphs"), F.count(F.lit(1)).alias("phrases"), F.count_if(F.col("confidence") < low).alias("needs_review"), F.array_sort(F.collect_list("__item")).alias("items"),
        F.collect_list(lookup(CONTENT_NAME, F.col("content_type_id"))).alias("types"), F.collect_list("__kind").alias("kinds"),
    )
    counts = lambda c: F.map_from_entries(F.transform(F.array_sort(F.array_distinct(c)), lambda v: F.struct(v, F.size(F.filter(c, lambda x: x == v)))))
    document = F.struct("title", "paragraphs", "phrases", counts("types").alias("by_content_type"), counts("kinds").alias("by_kind"), "needs_review")
    return grouped.select("doc_id", "title", F.to_json(F.struct(F.lit("2.0").alias("api_version"), document.alias("document"), F.col("items").alias("phrases"))).alias("payload"))


def saved(rows: DataFrame, glossary: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Phrases, their analyses and their links to existing glossary entries, each link once; references of traditions and reports stay blank."""
    analysis = rows.select("phrase_id", lookup(KIND, F.col("kind"), "plain").alias("kind"), "reason_code", F.bround(F.col("confidence") * 100).cast("int").alias("confidence"), F.when(F.col("kind").isin("hadith", "athar"), "").otherwise(F.col("source")).alias("reference"))
    links = rows.select("phrase_id", F.explode("terms").alias("t")).select("phrase_id", F.trim("t.arabic").alias("ar")).join(glossary.select(F.col("id").alias("glossary_id"), "ar"), "ar").select("phrase_id", "glossary_id").dropDuplicates()
    return rows.select("phrase_id", "doc_id", "para_no", "ord", "content", "tag", "text_type", "align", "content_type_id", "translatable"), analysis, links


class DuplicateTitle(ValueError):
    """A document of this title is stored already."""


def save_documents(rows: DataFrame, glossary: DataFrame, path: str, version: int, *, replace: bool = False) -> None:
    """Store documents (rows of :func:`phrases`) with their analyses and links, all of a version in one folder.

    A title that an earlier version has is an error unless ``replace`` is set;
    then :func:`stored_documents` reads the later version in its place.  A save
    that is run again under its number replaces itself.  The title that clashes
    is looked for with one semi-join; nothing else comes to the driver.
    """
    from pyspark.errors import AnalysisException

    spark = rows.sparkSession
    if not replace:
        try:
            earlier = spark.read.parquet(path).filter(F.col("version") != version).select("title")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            earlier = None  # nothing is stored yet
        clash = earlier and rows.select("title").join(earlier, "title", "left_semi").first()
        if clash:
            raise DuplicateTitle(clash["title"])
    rows = written(rows, "documents")  # they are read several times, and must be the same each time
    kept, analysis, links = saved(rows, glossary)
    titles = rows.select("phrase_id", "title")
    linked = links.groupBy("phrase_id").agg(F.array_sort(F.collect_set("glossary_id")).alias("glossary_ids"))
    whole = kept.join(titles, "phrase_id").join(analysis, "phrase_id").join(linked, "phrase_id", "left").withColumn("glossary_ids", F.coalesce("glossary_ids", F.array().cast("array<bigint>")))
    whole.write.mode("overwrite").parquet(f"{path}/version={version}")


def stored_documents(spark: SparkSession, path: str) -> DataFrame:
    """The phrases of the latest version of every title."""
    every = spark.read.parquet(path)
    latest = every.groupBy("title").agg(F.max("version").alias("version"))
    return every.join(latest, ["title", "version"], "left_semi")


def file_name(title: Column, language: Column, iso: Column, number: Column, kind: str) -> Column:
    """The name of an exported file; what file systems refuse in a title becomes a space."""
    return F.concat(F.trim(F.regexp_replace(title, "[\\\\/:*?\"<>|]+", " ")), F.lit(" - "), language, F.lit(" ["), iso, number.cast("string"), F.lit(f"].{kind}"))


def book_tag(iso: Column, number: Column, dated: Column, today: Column) -> Column:
    """The tag of a book's first page, with the day where that is asked for."""
    return F.concat(iso, number.cast("string"), F.when(dated, F.concat(F.lit(" - "), local_day(today))).otherwise(""))


def row_type(tag: Column, text_type: Column) -> Column:
    return F.when(tag.isin(*HEADINGS), "title").when(tag == "footnote", "footnote").when(text_type == "naqhara", "naqhara").when(tag == "listparagraph", "listparagraph").otherwise("paragraph")


def book_rows(phrase_rows: DataFrame, translations: DataFrame, *, include_untranslatable: bool = True) -> DataFrame:
    """Rows of the book in order; what needs no translation stands in its own words, what lacks one is left out."""
    texts = translations.select("phrase_id", F.trim("translation").alias("__t")).filter("__t <> ''")
    joined = phrase_rows.join(texts, "phrase_id", "left")
    shown = F.coalesce("__t", F.when(~F.col("translatable") & F.lit(include_untranslatable), F.col("text")))
    kept = joined.withColumn("translation", shown).filter("translation is not null")
    return kept.select(
        "document_id", F.col("phrase_id").alias("id"), row_type(F.col("tag"), F.col("text_type")).alias("type"), lookup(HEADINGS, F.col("tag"), "p").alias("tag"), lookup(SUB_TYPES, F.col("content_type"), "normal").alias("sub_type"),
        context.continues(F.col("group_id"), ["document_id"], ["group_id", "group_order"]).alias("splitted"), F.col("group_id").alias("split_group"), "group_order", "translation", F.col("text").alias("original_text"),
    )


def missing(phrase_rows: DataFrame, translations: DataFrame) -> DataFrame:
    """Translatable phrases without a translation."""
    done = translations.filter(F.trim("translation") != "").select("phrase_id")
    return phrase_rows.filter("translatable").select("document_id", "phrase_id").join(done, "phrase_id", "left_anti")


def footnote_hosts(rows: DataFrame) -> DataFrame:
    """(document_id, id, host, marker): each footnote takes the first marker [n] before it that no other has taken; null if none is left.

    The footnotes and markers of a document are folded in order inside one row:
    a marker counts only from its own place on.
    """
    markers = F.when(F.col("type") == "footnote", F.array().cast("array<string>")).otherwise(F.regexp_extract_all("original_text", F.lit(MARKER)))
    items = rows.withColumn("__m", markers).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("split_group", "group_order", (F.col("type") == "footnote").alias("note"), "id", "__m"))).alias("items"))
    state = F.struct(F.array().cast("array<struct<host:string,marker:string>>").alias("free"), F.array().cast("array<struct<id:string,host:string,marker:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        first = F.get(acc["free"], F.lit(0))
        taken = F.struct(F.when(x["note"], F.slice(acc["free"], 2, 1_000_000)).otherwise(F.concat(acc["free"], F.transform(x["__m"], lambda m: F.struct(x["id"].cast("string").alias("host"), m.alias("marker"))))).alias("free"),
                         F.when(x["note"], F.concat(acc["out"], F.array(F.struct(x["id"].cast("string").alias("id"), first["host"].alias("host"), first["marker"].alias("marker"))))).otherwise(acc["out"]).alias("out"))
        return taken

    return items.select("document_id", F.explode(F.aggregate("items", state, step)["out"]).alias("f")).select("document_id", "f.id", "f.host", "f.marker")


def runs(rows: DataFrame) -> DataFrame:
    """Prose runs (same group) and verse runs: adds ``run`` by document."""
    prose = (F.col("type") == "paragraph") & (F.col("sub_type") == "normal")
    value = F.when(prose, F.concat(F.lit("p"), F.col("split_group").cast("string"))).when(F.col("sub_type") == "aya", F.lit("aya")).otherwise(F.concat(F.lit("x"), F.col("id").cast("string")))
    return context.runs(rows, ["document_id"], ["split_group", "group_order"], value)


def preferences(defaults: Column, options: Column, layout: Column) -> Column:
    """Option maps laid over one another; the last wins."""
    keep = lambda low, high: F.map_filter(low, lambda k, v: ~F.map_contains_key(high, k))
    first = F.map_concat(keep(defaults, options), options)
    return F.map_concat(keep(first, layout), layout)


def invalid_options(options: Column, known: Column, booleans: Column) -> Column:
    """Unknown keys, and boolean keys whose value is neither true nor false."""
    unknown = F.array_except(F.map_keys(options), known)
    wrong = F.filter(F.array_intersect(F.map_keys(options), booleans), lambda k: ~F.lower(F.element_at(options, k)).isin("true", "false"))
    return F.struct(unknown.alias("unknown"), wrong.alias("not_boolean"))


def screen_rows(segments: DataFrame) -> DataFrame:
    """For the editor's screen: the carried section, running numbers of traditions and reports, labels and percentages."""
    order = (["doc_id"], ["para", "ord"])
    part = context.carried(F.col("kind") == "title", T.strip(F.col("content")), *order)
    number = F.when(F.col("kind").isin("hadith", "athar"), context.running_number(F.col("kind").isin("hadith", "athar"), *order))
    label = (
        F.when(F.col("footnote"), "حاشية").when((F.col("kind") == "title") & T.strip(F.col("content")).rlike("(?U)^(?:ال)?خاتمة\\b"), "نص عام").when(F.col("kind") == "title", "عنوان")
        .when((F.col("kind") == "attribution") & F.col("content").rlike(SOURCING), "تخريج").when(F.col("kind") == "attribution", "نص عام").when(F.col("kind") == "citation", "عزو")
    )
    share = F.when(F.col("kind") == "citation", 1.0).otherwise(confidence(F.col("kind"), F.col("score"), F.col("note")))
    shown = lookup({"quran": "aya", "hadith": "hadith", "athar": "athar", "term": "term"}, F.col("kind"), "text")
    text = T.strip(T.replace(F.col("content"), "(?U)\\s*﴿\\s*﴾"))
    return segments.select("doc_id", "para", "ord", text.alias("ar"), shown.alias("k"), F.coalesce(part, F.lit("")).alias("part"), number.alias("fn"), label.alias("label"), F.concat(F.bround(share * 100).cast("int").cast("string"), F.lit("%")).alias("conf"))


def search(rows: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows of which some column holds the text, whatever the case."""
    from functools import reduce

    return rows.filter(reduce(Column.__or__, (F.lower(F.col(c).cast("string")).contains(text.lower()) for c in columns)))


def facets(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value, n) for each column, in one pass."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns)))
    return rows.select(pairs.alias("p")).groupBy("p.facet", "p.value").agg(F.count(F.lit(1)).alias("n"))


def faceted(rows: DataFrame, columns: dict[str, str], date: str | None = None) -> DataFrame:
    """(facet, value, n): facets by name and column, of own and joined columns alike, and the years, months and days of ``date``.

    One aggregation over grouping sets; the days are rolled up to months and
    years in it.  Null values count as a value of their own.
    """
    parts = {name: F.col(c).cast("string") for name, c in columns.items()} | ({name: F.date_format(date, form) for name, form in (("year", "yyyy"), ("month", "yyyy-MM"), ("day", "yyyy-MM-dd"))} if date else {})
    sets = [[F.col(name)] for name in columns] + ([[F.col(c) for c in ("year", "month", "day")[:n]] for n in (1, 2, 3)] if date else [])
    counted = rows.select(*(c.alias(name) for name, c in parts.items())).groupingSets(sets, *parts).agg(F.count(F.lit(1)).alias("n"), *(F.grouping(name).alias(f"__{name}") for name in parts))
    # The last name that a set holds is its facet: of year and month the month.
    last = [F.when(F.col(f"__{name}") == 0, F.struct(F.lit(name).alias("facet"), F.col(name).alias("value"))) for name in reversed(parts)]
    return counted.select(F.coalesce(*last).alias("f"), "n").select("f.facet", "f.value", "n")


def stored_segments(phrase_rows: DataFrame, analysis: DataFrame, links: DataFrame, glossary: DataFrame) -> DataFrame:
    """Segments back from their tables, terms in order; the stored reason stands for the note, which was never saved."""
    back = {v: k for k, v in KIND.items() if k != "uncertain"}
    terms = links.join(glossary.select(F.col("id").alias("glossary_id"), "ar", "en"), "glossary_id").groupBy("phrase_id").agg(F.array_sort(F.collect_list(F.struct("ar", "en"))).alias("terms"))
    joined = phrase_rows.join(analysis.withColumnRenamed("kind", "__kind"), "phrase_id", "left").join(terms, "phrase_id", "left")
    return joined.select(
        F.col("doc_id"), F.col("para_no").alias("para"), "ord", lookup(back, F.coalesce("__kind", F.lit("plain")), "text").alias("kind"), "content", F.coalesce("reference", F.lit("")).alias("source"),
        (F.col("confidence") / 100).alias("confidence"), "reason_code", F.coalesce("terms", F.array().cast("array<struct<ar:string,en:string>>")).alias("terms"),
    )


def kind_label(content_type: Column, tag: Column) -> Column:
    """The label of a phrase in the translation sheet."""
    return F.when(tag.isin(*HEADINGS), "heading").when(tag == "footnote", "footnote").otherwise(content_type)


def translation_sheet(phrase_rows: DataFrame, translations: DataFrame) -> DataFrame:
    """Every phrase in order with its translation, empty where it lacks one."""
    joined = phrase_rows.join(translations.select("phrase_id", F.trim("translation").alias("__t")), "phrase_id", "left")
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("group_id", "group_order"))
    return joined.select("document_id", place.alias("n"), "phrase_id", kind_label(F.col("content_type"), F.col("tag")).alias("kind"), "text", F.coalesce("__t", F.lit("")).alias("translation"), (F.col("translatable") & (F.coalesce("__t", F.lit("")) == "")).alias("missing"))
