"""The text functions over the driver's rows, each of which gets an Arabic sample in front of a word of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.identity import hashed_feature
from .relational import query, table

#: Samples of all that the functions look for: marks, old spelling, brackets, signs, numbers, affixes and names.
SAMPLES = (
    "بِسْمِ اللَّهِ الرَّحْمَٰنِ الرَّحِيمِ", "وَقَالَﷺ: إنّما الأعمالُ بالنيّات.", "قال تعالى: ﴿فَإِنَّ مَعَ الْعُسْرِ يُسْرًا ٥﴾ [الشرح: 5].", "يٰأيها الذين ءامنوا اصبروا", "والتوكّل عليه، وبالصبر (وحده", "«كتابهم» — ومكتبتنا؛ 12",
    "[1] This is (2) Allah[3] One {4} *(5).", "3) Guide  us .", "🙂 #tag  نصّ", "---===---", "مدرسة المعلمون ساعاتك", "(a [b] c) {d}", "a) b (", "يا أيها النبي صلى الله عليه وسلم", "Text with كلمة inside ﷺ", "",
)


def sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


LIST = "[" + ", ".join(map(sql_text, SAMPLES)) + "]"
ROWS = f"r AS (SELECT event_id, ({LIST})[event_id % {len(SAMPLES)} + 1] || ' ' || event_type AS t FROM events)"
SPACE = "[ \\t\\n\\x0b\\f\\r]"


def samples(spark: SparkSession, folder: str) -> DataFrame:
    picked = F.element_at(F.array(*map(F.lit, SAMPLES)), (F.col("event_id") % len(SAMPLES) + 1).cast("int"))
    return table(spark, folder, "events").select("event_id", F.concat(picked, F.lit(" "), F.col("event_type")).alias("t"))


def sub(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, {sql_text(pattern)}, {sql_text(by)}, 'g')"


def strip(x: str) -> str:
    return sub(x, f"^{SPACE}+|{SPACE}+$")


def collapse(x: str) -> str:
    return strip(sub(x, f"{SPACE}+", " "))


def bare(x: str) -> str:
    return sub(sub(x, T.SCRIPTURE_MARKS), T.DIACRITICS)


def lexical(x: str) -> str:
    return collapse(sub(f"translate({bare(x)}, '{T.SPELLING_FROM}', '{T.SPELLING_TO}')", T.PUNCTUATION, " "))


def normal(x: str) -> str:
    return collapse(sub(f"translate({bare(x)}, '{T.SPELLING_FROM}ة', '{T.SPELLING_TO}ه')", T.PUNCTUATION, " "))


def dagger(x: str) -> str:
    return sub(f"replace({sub(x, f'[وي]{T.DAGGER}', 'ا')}, '{T.DAGGER}', 'ا')", "ءَ?ا", "ا")


def split(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


@query(f"WITH {ROWS} SELECT event_id, {collapse(bare('t'))} AS light, {lexical('t')} AS lexical, {normal('t')} AS normal FROM r")
def normal_forms(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("t")
    return samples(spark, folder).select("event_id", T.light(t).alias("light"), T.lexical(t).alias("lexical"), T.normalize(t).alias("normal"))


@query(f"WITH {ROWS} SELECT event_id, {split(normal('t'))} AS tokens, {split(lexical('t'))} AS lexical_tokens, len({split(normal('t'))})::BIGINT AS n FROM r")
def token_forms(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("t")
    return samples(spark, folder).select("event_id", T.tokens(t).alias("tokens"), T.lexical_tokens(t).alias("lexical_tokens"), F.size(T.tokens(t)).cast("long").alias("n"))


@query(
    f"""WITH {ROWS} SELECT event_id, {dagger('t')} AS expanded, contains(t, '{T.DAGGER}') OR contains(t, 'ء') AS old, {sub(normal(dagger('t')), '(^| )ياا?يها( |$)', chr(92) + '1يا ايها' + chr(92) + '2')} AS vocative FROM r"""
)
def spelling_forms(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("t")
    return samples(spark, folder).select("event_id", T.expand_dagger(t).alias("expanded"), T.has_old_spelling(t).alias("old"), T.split_vocative(T.normalize(T.expand_dagger(t))).alias("vocative"))


PREFIX, SUFFIX, PRONOUN = (str(list(x)) for x in (T.PREFIXES, T.PRONOUNS + T.ENDINGS, T.PRONOUNS))


@query(
    f"""WITH {ROWS}, w AS (SELECT DISTINCT unnest({split(lexical('t'))}) AS w FROM r),
    b AS (SELECT DISTINCT w, unnest([w] || list_transform(list_filter({PREFIX}, lambda p: starts_with(w, p) AND length(w) - length(p) >= 3), lambda p: substr(w, length(p) + 1))) AS b FROM w),
    s AS (SELECT w, b, NULL AS s, b AS stem FROM b UNION ALL SELECT w, b, x.s, substr(b, 1, length(b) - length(x.s)) FROM b, (SELECT unnest({SUFFIX}) AS s) x WHERE ends_with(b, x.s) AND length(b) - length(x.s) >= 3),
    f AS (SELECT w, stem AS f FROM s UNION SELECT w, substr(stem, 1, length(stem) - 1) || CASE WHEN ends_with(stem, 'ت') THEN 'ة' ELSE 'ي' END FROM s WHERE list_contains({PRONOUN}, s) AND (ends_with(stem, 'ت') OR ends_with(stem, 'ا')))
    SELECT w AS word, string_agg(f, ' ' ORDER BY -length(f), f) AS forms FROM f GROUP BY w"""
)
def affix_forms(spark: SparkSession, folder: str) -> DataFrame:
    words = samples(spark, folder).select(F.explode(T.lexical_tokens(F.col("t"))).alias("word")).distinct()
    return words.select("word", F.array_join(T.affix_forms(F.col("word")), " ").alias("forms"))


DIGITS = "[0-9٠-٩]"
SPACED = "replace(replace(t, 'ﷺ', ' ﷺ '), 'ﷻ', ' ﷻ ')"
LIGATURES = strip(f"replace({sub(sub(SPACED, SPACE + '*' + DIGITS + '+' + SPACE + '*﴾', '﴾'), ' +([،.:!؟»)' + chr(92) + ']])', chr(92) + '1')}, '  ', ' ')")
NOISELESS = sub(strip(sub("t", T.EMOJI.replace("\\x{1F000}-\\x{1FAFF}", "\U0001f000-\U0001faff").replace("\\x{FE0F}\\x{200D}", "️‍"), " ")), SPACE + "{2,}", " ")


@query(
    f"""WITH {ROWS}, n AS (SELECT *, {NOISELESS} AS n FROM r)
    SELECT event_id, {LIGATURES} AS ligatures, CASE WHEN regexp_full_match(n, '([#＃][^ #＃]+[ ،,]*)+') OR regexp_full_match(n, '[^\\p{{L}}\\p{{M}}\\p{{N}}]{{2,}}') THEN '' ELSE n END AS noiseless,
        {collapse(sub(sub(sub('t', '^' + SPACE + '*' + DIGITS + '+' + SPACE + '*[.),:،]?' + SPACE + '*'), chr(92) + '*?' + chr(92) + '(' + DIGITS + '+' + chr(92) + ')|' + chr(92) + '[' + DIGITS + '+' + chr(92) + ']|' + chr(92) + '{' + DIGITS + '+' + chr(92) + '}'), SPACE + '*[.]' + SPACE + '*$', '.'))} AS translation FROM n"""
)
def cleaned_forms(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("t")
    return samples(spark, folder).select("event_id", T.expand_ligatures(t).alias("ligatures"), T.clean_noise(t).alias("noiseless"), T.clean_translation(t).alias("translation"))


AUDIT = f"lower({collapse(sub('translate(' + sub('t', T.NARROW_DIACRITICS) + chr(44) + ' ' + sql_text('إأآىة') + ', ' + sql_text('ااايه') + ')', '[^' + chr(92) + 'p{L}' + chr(92) + 'p{M}' + chr(92) + 'p{N}_ ]', ' '))})"
FOREIGN = f"array_to_string(regexp_extract_all({sub(sub(sub('t', T.NARROW_DIACRITICS), T.ALLOWED_SIGNS), 'صلى' + SPACE + '+الله' + SPACE + '+عليه' + SPACE + '+وسلم')}, '{T.LETTER_RANGES}'), '')"


@query(
    f"""WITH {ROWS} SELECT event_id, {AUDIT} AS audited, {sub('t', T.SPEAKER_DIACRITICS)} AS speaker, {sub('t', '[ «»]')} AS anchor, {FOREIGN} AS letters, {collapse("translate(t, '«»', '')")} AS display,
        trim(t, '﴿﴾{{}}«»()“”" ') AS unquoted, {collapse(sub('t', '[' + chr(92) + chr(92) + '/:*?"<>|]+', ' '))} AS file_name FROM r"""
)
def audit_forms(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("t")
    return samples(spark, folder).select(
        "event_id", T.audit_normalize(t).alias("audited"), T.speaker_form(t).alias("speaker"), T.anchor_key(t).alias("anchor"), T.foreign_letters(t).alias("letters"), T.display(t).alias("display"),
        T.strip_quotes(t).alias("unquoted"), T.safe_file_name(t).alias("file_name"),
    )


SIGNS = sub("t", "[^()\\[\\]{}«»﴿﴾]")
PAIRED = SIGNS
for _ in range(6):  # deeper nesting than any sample has
    PAIRED = sub(PAIRED, "\\(\\)|\\[\\]|\\{\\}|«»|﴿﴾")
QUOTED = "list_filter(list_transform(regexp_extract_all(t, '(?s)﴿(.+?)﴾', 1), lambda s: trim(s)), lambda s: regexp_matches(s, '[ء-يٱ]'))"


@query(
    f"""WITH {ROWS}, q AS (SELECT *, {QUOTED} AS q FROM r)
    SELECT event_id, {PAIRED} <> '' AS unbalanced, CASE WHEN len(q) > 0 THEN array_to_string(q, ' ') ELSE t END AS quoted FROM q"""
)
def bracket_forms(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("t")
    return samples(spark, folder).select("event_id", T.unbalanced(t).alias("unbalanced"), T.quoted_part(t).alias("quoted"))


QUERY_PART = sub("p", T.QUERY_SIGNS.replace("\\d", "0-9٠-٩"), " ")


@query(
    f"""WITH {ROWS}, q AS (SELECT *, {QUOTED} AS q FROM r), p AS (SELECT event_id, t, CASE WHEN len(q) > 0 THEN array_to_string(q, ' ') ELSE t END AS p FROM q), d AS (SELECT *, {QUERY_PART} AS d FROM p)
    SELECT event_id, {collapse(bare('d'))} AS clean, {normal('d')} AS normal, CASE WHEN contains(d, '{T.DAGGER}') OR contains(d, 'ء') THEN {normal(dagger('d'))} ELSE {normal('d')} END AS expanded,
        {collapse(bare('t'))} AS clean_uthmani, {normal(dagger('t'))} AS normalized_uthmani FROM d"""
)
def query_forms(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("t")
    derived = T.matching_forms(t, t)
    return samples(spark, folder).select("event_id", T.query_forms(t).alias("q"), derived["clean_uthmani"].alias("clean_uthmani"), derived["normalized_uthmani"].alias("normalized_uthmani")).select("event_id", "q.*", "clean_uthmani", "normalized_uthmani")


@query(
    f"""WITH {ROWS}, w AS (SELECT event_id, i, (list_filter(string_split({sub('t', SPACE + '+', ' ')}, ' '), lambda x: x <> ''))[i] AS w FROM r, LATERAL (SELECT unnest(range(1, 30)) AS i)),
    h AS (SELECT event_id, arg_min(w, i) AS w FROM w WHERE contains({normal('w')}, 'صبر') GROUP BY 1)
    SELECT event_id, coalesce(trim(w, {sql_text(T.EDGE_PUNCTUATION)}), 'صَبر') AS surface FROM r LEFT JOIN h USING (event_id)"""
)
def surface_forms(spark: SparkSession, folder: str) -> DataFrame:
    return samples(spark, folder).select("event_id", T.surface(F.col("t"), F.lit("صَبر")).alias("surface"))


CODES = ["ur", "FA", " ps ", "en", "", "uzb_Arab", "fr", "ku"]


@query(f"SELECT event_id, lower(trim(({CODES})[event_id % 8 + 1])) IN {T.ARABIC_SCRIPT_LANGUAGES} AS arabic FROM events")
def script_languages(spark: SparkSession, folder: str) -> DataFrame:
    iso = F.element_at(F.array(*map(F.lit, CODES)), (F.col("event_id") % 8 + 1).cast("int"))
    return table(spark, folder, "events").select("event_id", T.is_arabic_script(iso).alias("arabic"))


@query(
    f"""WITH {ROWS}, d AS (SELECT t, hex(t) AS h FROM (SELECT DISTINCT t FROM r)),
    b AS (SELECT t, list_transform(range(1, len(h) // 2 + 1), lambda i: ((strpos('0123456789ABCDEF', h[2 * i - 1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2 * i]) - 1)::BIGINT) AS b FROM d),
    c AS (SELECT t, list_reduce(b, lambda c, x: list_reduce(range(8), lambda y, i: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384::BIGINT) ELSE y // 2 END, xor(c, x)), 4294967295::BIGINT) AS c FROM b)
    SELECT event_id, xor(c, 4294967295::BIGINT) % 1048576 AS bucket FROM r JOIN c USING (t)"""
)
def hashed_features(spark: SparkSession, folder: str) -> DataFrame:
    """CRC-32 of each text in twenty bits; the SQL works it out bit by bit."""
    return samples(spark, folder).select("event_id", hashed_feature(F.col("t")).alias("bucket"))
