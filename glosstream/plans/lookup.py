"""Lookups of phrases and terms over the driver's tables, each with the same statement in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import match, ngram, phrases
from ..operators.glossary import with_terms
from .relational import PARAGRAPHS, paragraphs_of, plain_form, plain_sql, query, table

#: Needles of a passage: parts of words at both ends, with whole words between and without; a part of a word or two; the first sentence.
NEEDLES = """
    needles AS (
        SELECT item_id, unnest([1, 2, 3, 4]) AS part, unnest([substring(t, 3, 25), substring(t, 10, 8), substring(t, 12, 6), string_split(t, '. ')[1]]) AS needle
        FROM (SELECT item_id, lower(text) AS t FROM benchmark)
    )"""


def _needles(spark: SparkSession, folder: str) -> DataFrame:
    t = F.lower("text")
    parts = F.array(F.substring(t, 3, 25), F.substring(t, 10, 8), F.substring(t, 12, 6), F.get(F.split(t, "[.] "), F.lit(0)))
    return table(spark, folder, "benchmark").select("item_id", F.posexplode(parts).alias("part", "needle")).withColumn("part", (F.col("part") + 1).cast("long"))


@query(
    f"""WITH {PARAGRAPHS}, {NEEDLES}, t AS (SELECT doc_id, para, lower(text) AS text, string_split(lower(text), ' ') AS l FROM paras),
    n AS (SELECT *, string_split(needle, ' ') AS p FROM needles WHERE needle <> ''),
    near AS (SELECT doc_id, para, item_id, part, l, p, needle FROM t JOIN n ON contains(text, needle)),
    placed AS (SELECT *, unnest(range(len(l) - len(p) + 1)) AS start FROM near)
    SELECT doc_id, para, item_id, part::BIGINT AS part, start::BIGINT AS start FROM placed
    WHERE CASE WHEN len(p) = 1 THEN contains(l[start + 1], needle) ELSE ends_with(l[start + 1], p[1]) AND starts_with(l[start + len(p)], p[len(p)]) AND l[start + 2:start + len(p) - 1] = p[2:len(p) - 1] END"""
)
def phrase_positions(spark: SparkSession, folder: str) -> DataFrame:
    """Where fragments of the benchmark stand in the paragraphs of all documents, also in parts of words."""
    texts = paragraphs_of(table(spark, folder, "documents")).select(F.lit("").alias("scope"), "doc_id", "para", F.lower("text").alias("text"))
    needles = _needles(spark, folder).withColumn("scope", F.lit(""))
    found = phrases.occurrences(texts, needles, ["doc_id", "para"])
    return found.join(ngram.small(needles.filter("needle <> ''")), ["scope", "needle"]).select("doc_id", "para", "item_id", "part", F.col("start").cast("long").alias("start"))


@query(
    f"""WITH {PARAGRAPHS}, {NEEDLES}, v AS (SELECT doc_id AS surah_no, para AS ayah_no, lower(text) AS clean, {plain_sql('text')} AS normal FROM paras),
    q AS (SELECT item_id * 10 + part AS phrase_id, needle AS clean, {plain_sql('needle')} AS normal, item_id AS named, part FROM needles),
    every AS (
        SELECT phrase_id, surah_no, ayah_no, 1 AS rank FROM q JOIN v ON surah_no = named AND ayah_no = part
        UNION ALL SELECT phrase_id, surah_no, ayah_no, 2 FROM q JOIN v ON q.clean <> '' AND contains(v.clean, q.clean)
        UNION ALL SELECT phrase_id, surah_no, ayah_no, 3 FROM q JOIN v ON q.normal <> '' AND contains(v.normal, q.normal)
    )
    SELECT phrase_id, surah_no, ayah_no, min(rank)::BIGINT AS rank FROM every GROUP BY ALL"""
)
def verse_anchors(spark: SparkSession, folder: str) -> DataFrame:
    """All anchors but the fuzzy ones of fragments of the benchmark, with the paragraphs of all documents as verses."""
    paras = paragraphs_of(table(spark, folder, "documents"))
    clean, normal = F.lower("text"), plain_form(F.col("text"))
    verses = paras.select(F.col("doc_id").alias("surah_no"), F.col("para").alias("ayah_no"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("surah_name"), *(f.alias(c) for c, f in (("clean_imlaei", clean), ("clean_uthmani", clean), ("normalized_imlaei", normal), ("normalized_uthmani", normal))))
    form = plain_form(F.col("needle"))
    reference = F.format_string("سورة d%d — %d", "item_id", "part")
    forms = _needles(spark, folder).select((F.col("item_id") * 10 + F.col("part")).alias("phrase_id"), reference.alias("reference"), F.struct(F.col("needle").alias("clean"), form.alias("normal"), form.alias("expanded")).alias("q"))
    return match.exact_anchors(forms, verses).withColumn("rank", F.col("rank").cast("long"))


@query(
    f"""WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(string_split({plain_sql('text')}, ' '), lambda x: x <> '')) AS l FROM conversations),
    g AS (SELECT conv_id, turn, unnest(l) AS g FROM w), b AS (SELECT DISTINCT item_id, unnest(string_split({plain_sql('text')}, ' ')) AS g FROM benchmark),
    hits AS (SELECT conv_id, turn, item_id, count(*)::BIGINT AS hits FROM g JOIN b USING (g) GROUP BY ALL)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY hits DESC, item_id)::BIGINT AS rn FROM hits) WHERE rn <= 3"""
)
def heavy_grams(spark: SparkSession, folder: str) -> DataFrame:
    """The three passages that share most words with each turn: words that stand in more than five passages are too frequent to be joined on."""
    w = F.array_distinct(F.filter(F.split(plain_form(F.col("text")), " "), lambda x: x != ""))
    grams = table(spark, folder, "conversations").select("conv_id", "turn", F.explode(w).alias("gram"))
    index = table(spark, folder, "benchmark").select("item_id", F.explode(w).alias("gram"))
    return ngram.top_hits(grams, index, ["conv_id", "turn"], "item_id", 3, least=5)




#: The lexical form of Latin text: signs to spaces, single spaces.
LEXICAL = "trim(regexp_replace(regexp_replace({}, '[.,;:!?\"''()\\[\\]{{}}\\-«»–—…]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(
    f"""WITH RECURSIVE {PARAGRAPHS.replace("WITH", "")},
    named AS (SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT array_to_string(string_split(text, ' ')[1:k], ' ') FROM benchmark, range(1, 5) ks(k)),
    entries AS (SELECT form, max(arabic) AS arabic, len(string_split(form, ' ')) AS n FROM (SELECT lower(name) AS arabic, {LEXICAL.format("lower(name)")} AS form FROM named) WHERE form <> '' GROUP BY form),
    texts AS (SELECT 'turn' AS place, conv_id AS id, turn::BIGINT AS part, lower(text) AS t FROM conversations UNION ALL SELECT 'paragraph', doc_id, para, lower(text) FROM paras),
    words AS (SELECT place, id, part, string_split({LEXICAL.format("t")}, ' ') AS l FROM texts),
    grams AS (SELECT place, id, part, i, k, array_to_string(l[i:i + k - 1], ' ') AS form FROM (SELECT place, id, part, l, unnest(range(1, len(l) + 1)) AS i FROM words), range(1, 9) ks(k) WHERE i + k - 1 <= len(l)),
    hits AS (SELECT place, id, part, i, max(n) AS n, arg_max(arabic, n) AS arabic FROM grams JOIN entries USING (form) GROUP BY ALL),
    lists AS (SELECT place, id, part, list({{'i': i, 'n': n, 'arabic': arabic}} ORDER BY i) AS h FROM hits GROUP BY ALL),
    walk(place, id, part, h, next, taken) AS (
        SELECT place, id, part, h, 0::BIGINT, []::VARCHAR[] FROM lists
        UNION ALL SELECT place, id, part, h, x.i + x.n, CASE WHEN list_contains(taken, x.arabic) THEN taken ELSE list_append(taken, x.arabic) END
        FROM (SELECT *, list_filter(h, lambda y: y.i >= next)[1] AS x FROM walk) WHERE x IS NOT NULL
    ), ended AS (SELECT place, id, part, arg_max(taken, next) AS taken FROM walk GROUP BY ALL)
    SELECT place, id, part, coalesce(len(taken), 0)::INT AS n_terms, coalesce(array_to_string(taken, '; '), '') AS terms FROM texts LEFT JOIN ended USING (place, id, part)"""
)
def glossary_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Names of nations and regions, and beginnings of the benchmark's passages, in the paragraphs of documents and the turns of conversations."""
    named = table(spark, folder, "nation").select(F.col("n_name").alias("name")).unionByName(table(spark, folder, "region").select(F.col("r_name").alias("name")))
    begun = table(spark, folder, "benchmark").select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.array_join(F.slice(F.split("text", " "), 1, k), " "))).alias("name"))
    entries = named.unionByName(begun).select(F.lower("name").alias("arabic"), F.col("name").alias("english"), F.lit("terms").alias("dict"), F.lit("").alias("note"))
    turns = table(spark, folder, "conversations").select(F.lit("turn").alias("place"), F.col("conv_id").alias("id"), F.col("turn").cast("long").alias("part"), F.lower("text").alias("content"))
    paras = paragraphs_of(table(spark, folder, "documents")).select(F.lit("paragraph").alias("place"), F.col("doc_id").alias("id"), F.col("para").alias("part"), F.lower("text").alias("content"))
    found = with_terms(turns.unionByName(paras), entries, ["place", "id", "part"])
    return found.select("place", "id", "part", F.size("terms").alias("n_terms"), F.array_join(F.transform("terms", lambda t: t["arabic"]), "; ").alias("terms"))
