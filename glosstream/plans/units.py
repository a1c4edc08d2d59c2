"""Units of paragraphs, lead-ins and speakers, similarities and stored documents, each with the same statement in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.similarity import coverage_udf, matching_blocks_udf, partial_ratio_udf
from ..operators import boundary, export, segment, speaker, verses
from ..sources.scratch import shared_folder
from .relational import PARAGRAPHS, paragraphs_of, query, table
from .workflow import SHEET, _segments

#: Quotation signs and brackets of the splitter, as SQL.
CLOSER = "CASE x[2] WHEN '(' THEN ')' WHEN '\"' THEN '\"' WHEN '«' THEN '»' WHEN '“' THEN '”' WHEN '﴿' THEN '﴾' END"


@query(
    f"""WITH {PARAGRAPHS}, t AS (SELECT doc_id, para, CASE WHEN para % 7 = 0 THEN text || ' [ab 12].' WHEN para % 7 = 3 THEN 'Here: ' || text || ': «so. (it) is!» end' ELSE text END AS text FROM paras),
    c AS (SELECT doc_id, para, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM t),
    n AS (SELECT *, lag(c, 1, '') OVER w AS p1, lag(c, 2, '') OVER w AS p2, lead(c, 1, '') OVER w AS nx FROM c WINDOW w AS (PARTITION BY doc_id, para ORDER BY i)),
    s AS (SELECT doc_id, para, list([i::VARCHAR, c, p1, p2, nx, CASE WHEN c = ':' THEN ltrim(substr(text, i + 1))[1] ELSE '' END] ORDER BY i) AS s FROM n JOIN t USING (doc_id, para) WHERE contains('.!؟?:"()«»“”﴿﴾', c) GROUP BY ALL),
    f AS (SELECT doc_id, para, list_reduce(s, lambda acc, x: CASE
        WHEN acc[2] <> '' AND right(acc[2], 1) = x[2] THEN list_concat([acc[1], left(acc[2], len(acc[2]) - 1)], acc[3:])
        WHEN {CLOSER} IS NOT NULL THEN CASE WHEN acc[2] = '' AND x[2] <> '(' THEN list_concat([x[1], {CLOSER}], acc[3:], [x[1]]) ELSE list_concat([acc[1], acc[2] || {CLOSER}], acc[3:]) END
        WHEN acc[2] = '' AND contains('.!؟?:', x[2])
            AND NOT (x[2] = '.' AND (x[5] = '.' OR x[1]::INT > acc[1]::INT AND (x[3] = '.' OR x[3] <> ' ' AND (x[1]::INT - 1 = acc[1]::INT OR x[4] IN (' ', '')))))
            AND NOT (x[2] = ':' AND x[6] <> '' AND NOT contains('﴿«("“', x[6])) THEN list_concat([(x[1]::INT + 1)::VARCHAR, ''], acc[3:], [(x[1]::INT + 1)::VARCHAR])
        ELSE acc END, ['1', '']) AS f FROM s),
    u AS (SELECT doc_id, para, text, list_concat([1], list_transform(coalesce(f[3:], []), lambda x: x::INT), [len(text) + 1]) AS k FROM t LEFT JOIN f USING (doc_id, para)),
    p AS (SELECT doc_id, para, text, list_filter(list_transform(range(1, len(k)), lambda i: trim(substr(text, k[i], k[i + 1] - k[i]))), lambda x: x <> '') AS p FROM u),
    m AS (SELECT doc_id, para, text, list_reduce(p, lambda acc, x: CASE WHEN acc <> '' AND regexp_full_match(x, '[\\s.،,؛;:!؟?]+') THEN acc || x WHEN ltrim(x, '،, ') = '' THEN acc WHEN acc = '' THEN ltrim(x, '،, ') ELSE acc || chr(1) || ltrim(x, '،, ') END, '') AS m FROM p),
    r AS (SELECT doc_id, para, text, flatten(list_transform(string_split(m, chr(1)), lambda x: CASE WHEN regexp_matches(x, '^\\S+\\s+\\S+\\s+\\S.*\\[[^\\]]{{2,40}}\\]\\s*[.،]?\\s*$')
        THEN [trim(regexp_replace(x, '\\s*\\[[^\\]]{{2,40}}\\]\\s*[.،]?\\s*$', '')), regexp_extract(x, '\\[[^\\]]{{2,40}}\\]\\s*[.،]?\\s*$')] ELSE [x] END)) AS r FROM m),
    w AS (SELECT doc_id, para, CASE WHEN replace(array_to_string(r, ''), ' ', '') = replace(text, ' ', '') THEN r ELSE [trim(text)] END AS r FROM r)
    SELECT doc_id, para, unnest(range(1, len(r) + 1))::INT AS ord, unnest(r) AS unit FROM w"""
)
def ruled_units(spark: SparkSession, folder: str) -> DataFrame:
    """Units of every paragraph by the rules, some with a reference at the end or quotations inside."""
    para, text = F.col("para"), F.col("text")
    shown = F.when(para % 7 == 0, F.concat(text, F.lit(" [ab 12]."))).when(para % 7 == 3, F.concat(F.lit("Here: "), text, F.lit(": «so. (it) is!» end"))).otherwise(text)
    return segment.units(paragraphs_of(table(spark, folder, "documents")).select("doc_id", "para", shown.alias("text"), F.lit(False).alias("heading"))).drop("heading")


@query(
    f"""WITH {PARAGRAPHS}, t AS (SELECT doc_id, para, trim(regexp_replace(CASE WHEN para % 2 = 0 THEN replace(text, '. ', '». ') ELSE replace(text, '! ', '! ,') END, '\\s+', ' ', 'g')) AS t FROM paras),
    c AS (SELECT doc_id, para, regexp_replace(regexp_replace(t, '([!؟?؛;:»”")…]) ', '\\1' || chr(1), 'g'), '([^.,،\\x01 ]) ([«﴿“"(])', '\\1' || chr(1) || '\\2', 'g') AS c FROM t),
    b AS (SELECT doc_id, para, regexp_replace(c, '\\x01([،, ]+)([^،, \\x01])', '\\1' || chr(1) || '\\2', 'g') AS b FROM c),
    q AS (SELECT doc_id, para, string_split(regexp_replace(b, '([»”]\\s*[.!؟?]+)\\s+([^\\s\\x01])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS q FROM b)
    SELECT doc_id, para, unnest(range(1, len(q) + 1))::INT AS ord, trim(unnest(q)) AS unit FROM q"""
)
def learned_units(spark: SparkSession, folder: str) -> DataFrame:
    """Units by a learned splitter that cuts at no full stop and no comma; commas go back, closed quotations end a unit."""
    text = F.when(F.col("para") % 2 == 0, F.replace("text", F.lit(". "), F.lit("». "))).otherwise(F.replace("text", F.lit("! "), F.lit("! ,")))
    weights = {"pc=.": -9.0, "pc=,": -9.0, "pc=،": -9.0}
    paras = paragraphs_of(table(spark, folder, "documents")).select("doc_id", "para", text.alias("text"), F.lit(False).alias("heading"))
    return segment.units(paras, boundary.splitter(weights)).drop("heading")


LEADINS = ("قال تعالى:", "وقال رسول الله ﷺ :", "كقوله سبحانه :")


@query(
    f"""WITH b AS (SELECT conv_id AS doc_id, turn AS para, text, role, ({list(LEADINS)})[turn % 3 + 1] AS lead FROM conversations),
    k AS (SELECT doc_id, para, CASE WHEN role = 'user' THEN 'text' ELSE 'quran' END AS kind, CASE para % 4 WHEN 0 THEN text WHEN 1 THEN lead WHEN 2 THEN text || ' and so it goes. ' || lead ELSE text || ' and so it goes. ' || lead || ' x' END AS content, text, lead FROM b),
    c AS (SELECT *, kind = 'text' AND para % 4 IN (1, 2) AS cut FROM k)
    SELECT doc_id, para, 1::INT AS ord, CASE WHEN cut AND para % 4 = 1 THEN 'attribution' ELSE kind END AS kind, CASE WHEN cut AND para % 4 = 2 THEN text || ' and so it goes.' ELSE content END AS content, CASE WHEN cut AND para % 4 = 1 THEN 'lead-in' ELSE '' END AS note FROM c
    UNION ALL SELECT doc_id, para, 2, 'attribution', lead, 'lead-in' FROM c WHERE cut AND para % 4 = 2"""
)
def leadins_apart(spark: SparkSession, folder: str) -> DataFrame:
    """Lead-ins at the end of prose stand alone; those of other kinds and inside a text stay."""
    turn, text = F.col("turn"), F.col("text")
    lead = F.element_at(F.array(*map(F.lit, LEADINS)), (turn % 3 + 1).cast("int"))
    head = F.concat(text, F.lit(" and so it goes. "), lead)
    content = F.when(turn % 4 == 0, text).when(turn % 4 == 1, lead).when(turn % 4 == 2, head).otherwise(F.concat(head, F.lit(" x")))
    kind = F.when(F.col("role") == "user", "text").otherwise("quran")
    rows = table(spark, folder, "conversations").select(F.col("conv_id").alias("doc_id"), turn.alias("para"), F.lit(1).alias("ord"), kind.alias("kind"), content.alias("content"), F.lit("").alias("note"))
    return segment.split_trailing_leadins(rows)


#: Lead-ins and whom they introduce.
INTROS = {
    "قال عمر:": "companion", "قال رسول الله ﷺ:": "prophet", "وقالت عائشة رضي الله عنها: «": "companion", "قال الشيخ:": "scholar", "قال عمر": None, "سمع النبي يقول:": "prophet", "قال في مسجد النبي أنس:": "companion", "ذكر عمر:": None,
}


@query(
    f"""WITH b AS (SELECT conv_id AS doc_id, turn, CASE WHEN turn % 2 = 0 THEN ({list(INTROS)})[(conv_id + turn) % {len(INTROS)} + 1] ELSE text END AS content,
        CASE WHEN turn % 2 = 0 THEN ({[v or '' for v in INTROS.values()]})[(conv_id + turn) % {len(INTROS)} + 1] ELSE '' END AS who, CASE turn % 6 WHEN 1 THEN 'hadith' WHEN 3 THEN 'text' WHEN 4 THEN 'citation' ELSE 'quran' END AS kind FROM conversations),
    w AS (SELECT *, lag(who, 1, '') OVER o AS p1, lead(kind) OVER o AS nx FROM b WINDOW o AS (PARTITION BY doc_id ORDER BY turn)),
    c AS (SELECT *, turn % 2 = 1 AND p1 = 'companion' AND (kind = 'hadith' OR kind = 'text' AND coalesce(nx = 'citation', false)) AS c FROM w)
    SELECT doc_id, turn AS ord, CASE WHEN c THEN 'athar' ELSE kind END AS kind, CASE WHEN c AND kind = 'hadith' THEN 'companion''s saying' WHEN c THEN 'companion''s saying, cited' ELSE '' END AS note, c AS reviewed FROM c"""
)
def sayings(spark: SparkSession, folder: str) -> DataFrame:
    """Traditions and cited prose that a companion introduces become reports."""
    turn = F.col("turn")
    intro = F.element_at(F.array(*map(F.lit, INTROS)), ((F.col("conv_id") + turn) % len(INTROS) + 1).cast("int"))
    kind = F.when(turn % 6 == 1, "hadith").when(turn % 6 == 3, "text").when(turn % 6 == 4, "citation").otherwise("quran")
    rows = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.lit(1).alias("para"), turn.alias("ord"), kind.alias("kind"), F.when(turn % 2 == 0, intro).otherwise(F.col("text")).alias("content"), F.lit("").alias("note"), F.lit(False).alias("reviewed")
    )
    return speaker.reattribute(rows).select("doc_id", "ord", "kind", "note", "reviewed")


NEIGHBOURS = "p AS (SELECT DISTINCT lag(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS a, p_name AS b FROM part), n AS (SELECT * FROM p WHERE a IS NOT NULL AND b IS NOT NULL)"


def _neighbours(spark: SparkSession, folder: str) -> DataFrame:
    before = F.lag("p_name").over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    return table(spark, folder, "part").select(before.alias("a"), F.col("p_name").alias("b")).distinct().filter("a IS NOT NULL AND b IS NOT NULL")


def lcs_sql(a: str, b: str) -> str:
    """Length of the longest common subsequence, row by row; lambdas have no names of the outer query."""
    return f"""list_reduce(list_transform(range(1, len({a}) + 1), lambda i: [ord({a}[i])]), lambda row, c: list_concat([0], list_transform(range(1, len({b}) + 1),
        lambda j: list_max(list_transform(range(1, j + 1), lambda i: greatest(row[i + 1], CASE WHEN ord({b}[i]) = c[1] THEN row[i] + 1 ELSE 0 END))))), list_transform(range(len({b}) + 1), lambda x: 0))[len({b}) + 1]"""


@query(
    f"""WITH {NEIGHBOURS}, s AS (SELECT a, b, CASE WHEN len(a) <= len(b) THEN a ELSE b END AS s, CASE WHEN len(a) <= len(b) THEN b ELSE a END AS l FROM n),
    w AS (SELECT a, b, s, l, unnest(list_distinct(list_transform(range(1, len(s) + len(l)), lambda e: substr(l, greatest(e - len(s), 0) + 1, least(e, len(l)) - greatest(e - len(s), 0))))) AS w FROM s),
    d AS (SELECT s, w, {lcs_sql('s', 'w')} AS n FROM (SELECT DISTINCT s, w FROM w)),
    x AS (SELECT a, b, max(200.0 * n / (len(s) + len(w))) AS x FROM w JOIN d USING (s, w) GROUP BY a, b)
    SELECT a, b, round(CASE WHEN contains(l, s) THEN 100 ELSE x END, 6)::DOUBLE AS partial FROM s JOIN x USING (a, b)"""
)
def partial_ratios(spark: SparkSession, folder: str) -> DataFrame:
    """The similarity of the names of neighbouring parts, of the shorter with the best place of the longer."""
    return _neighbours(spark, folder).select("a", "b", F.round(partial_ratio_udf("a", "b"), 6).alias("partial"))


@query(
    f"""WITH RECURSIVE {NEIGHBOURS}, m AS (
        SELECT a, b, a AS x, b AS y, 0 AS size FROM n
        UNION ALL
        SELECT a, b, unnest([left(x, (-g.i)::INT - 1), substr(x, (-g.i + g.k)::INT)]), unnest([left(y, (-g.j)::INT - 1), substr(y, (-g.j + g.k)::INT)]), unnest([g.k, 0]) FROM (
            SELECT a, b, x, y, list_max(flatten(list_transform(range(1, len(x) + 1), lambda i: list_transform(range(1, len(y) + 1), lambda j:
                {{'k': len(list_filter(range(1, len(x) - i + 2), lambda z: j + z - 1 <= len(y) AND substr(x, i, z) = substr(y, j, z))), 'i': -i, 'j': -j}})))) AS g
            FROM m WHERE x <> '' AND y <> '') WHERE g.k > 0
    )
    SELECT a, b, round(2.0 * sum(size) / (len(a) + len(b)), 6)::DOUBLE AS blocks FROM m GROUP BY a, b"""
)
def matching_block_ratios(spark: SparkSession, folder: str) -> DataFrame:
    """The share of the names of neighbouring parts that lies in matching blocks."""
    return _neighbours(spark, folder).select("a", "b", F.round(matching_blocks_udf("a", "b"), 6).alias("blocks"))


@query(
    f"""WITH w AS (SELECT conv_id, turn, unnest(string_split(lower(text), ' ')) AS w FROM conversations), v AS (SELECT DISTINCT w, conv_id, turn FROM w),
    c AS (SELECT DISTINCT q.w AS a, r.w AS b FROM v q JOIN v r ON q.conv_id = r.conv_id AND r.turn = q.turn - 1 WHERE 200 * least(len(q.w), len(r.w)) >= 80 * (len(q.w) + len(r.w))
        AND len(list_distinct(string_split(q.w, ''))) + len(list_distinct(string_split(r.w, ''))) - 2 * len(list_intersect(string_split(q.w, ''), string_split(r.w, ''))) <= 0.2 * (len(q.w) + len(r.w))),
    l AS (SELECT a, b FROM c WHERE a = b OR 200.0 * {lcs_sql('a', 'b')} >= 80 * (len(a) + len(b))),
    h AS (SELECT DISTINCT q.conv_id, q.turn, q.w FROM v q JOIN v r ON q.conv_id = r.conv_id AND r.turn = q.turn - 1 JOIN l ON l.a = q.w AND l.b = r.w)
    SELECT w.conv_id, w.turn, round(count(h.w) / count(*), 6) AS covered FROM w JOIN (SELECT DISTINCT conv_id, turn + 1 AS turn FROM conversations) USING (conv_id, turn) LEFT JOIN h ON h.conv_id = w.conv_id AND h.turn = w.turn AND h.w = w.w GROUP BY 1, 2"""
)
def covered_turns(spark: SparkSession, folder: str) -> DataFrame:
    """The share of a turn's words that resemble a word of the turn before."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", F.split(F.lower("text"), " ").alias("words"))
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("words").alias("earlier"))
    return turns.join(before, ["conv_id", "turn"]).select("conv_id", "turn", F.round(coverage_udf("words", "earlier"), 6).alias("covered"))


@query(
    f"""WITH {SHEET}, v AS (SELECT 'book ' || doc_id AS title, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS version, doc_id || ':' || seq AS phrase_id, CASE WHEN doc_id % 3 = 0 THEN 'again ' ELSE '' END || content AS content, reason_code, confidence, ord FROM sh)
    SELECT title, version::INT AS version, phrase_id, content, reason_code, round_even(confidence * 100, 0)::INT AS confidence, CASE WHEN ord % 40 < 25 THEN (ord % 40)::VARCHAR ELSE '' END AS links FROM v"""
)
def stored_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Documents saved under their titles, every third a second time: of these the later version is read."""
    term = F.struct(F.concat(F.lit("NATION_"), (F.col("ord") % 40).cast("string")).alias("arabic"), F.lit("").alias("english"), F.lit("").alias("surface"), F.lit("terms").alias("kind"))
    rows = export.sheet_rows(_segments(spark, folder).withColumn("terms", F.array(term))).withColumn("phrase_id", F.concat_ws(":", "doc_id", "seq")).withColumn("title", F.concat(F.lit("book "), F.col("doc_id").cast("string")))
    glossary = table(spark, folder, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.concat(F.lit("NATION_"), F.col("n_nationkey").cast("string")).alias("ar"))
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    export.save_documents(rows, glossary, path, 1)
    export.save_documents(rows.filter("doc_id % 3 = 0").withColumn("content", F.concat(F.lit("again "), "content")), glossary, path, 2, replace=True)
    stored = export.stored_documents(spark, path)
    return stored.select("title", F.col("version").cast("int").alias("version"), "phrase_id", "content", "reason_code", "confidence", F.array_join("glossary_ids", ",").alias("links"))


VERSES = """v AS (SELECT p_brand AS surah, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)::INT AS ayah, p_name AS text, p_partkey, p_size FROM part),
    spots AS (SELECT text, list({'surah': surah, 'ayah': ayah} ORDER BY surah, ayah) AS spot FROM v GROUP BY text)"""


def _verses(spark: SparkSession, folder: str) -> DataFrame:
    """The names of parts as verses of their brand."""
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    return table(spark, folder, "part").select(F.col("p_brand").alias("surah"), place.alias("ayah"), F.col("p_name").alias("text"), "p_partkey", "p_size")


@query(
    f"""WITH RECURSIVE {VERSES}, s AS (SELECT surah AS doc_id, ayah AS ord, text, spot, CASE WHEN p_partkey % 9 = 0 THEN {{'surah': surah, 'ayah': ayah}} ELSE spot[1] END AS own, row_number() OVER (PARTITION BY surah ORDER BY ayah) AS i FROM v JOIN spots USING (text) WHERE p_size % 6 > 0),
    w AS (SELECT doc_id, ord, i, own AS place, false AS changed FROM s WHERE i = 1
        UNION ALL SELECT s.doc_id, s.ord, s.i, CASE WHEN list_contains(s.spot, {{'surah': w.place.surah, 'ayah': w.place.ayah + 1}}) THEN {{'surah': w.place.surah, 'ayah': w.place.ayah + 1}} ELSE s.own END,
            list_contains(s.spot, {{'surah': w.place.surah, 'ayah': w.place.ayah + 1}}) AND s.own <> {{'surah': w.place.surah, 'ayah': w.place.ayah + 1}} FROM w JOIN s ON s.doc_id = w.doc_id AND s.i = w.i + 1)
    SELECT doc_id, ord, 'سورة ' || place.surah || ' — ' || place.ayah AS source, CASE WHEN changed THEN 'by the sequence around it' ELSE '' END AS note FROM w
    UNION ALL SELECT surah, ayah, '', '' FROM v WHERE p_size % 6 = 0"""
)
def sequence_verses(spark: SparkSession, folder: str) -> DataFrame:
    """Names that many parts have: each takes the place behind the verse before, where its words stand there too."""
    v = _verses(spark, folder)
    least = v.groupBy("text").agg(F.min(F.struct("surah", "ayah")).alias("least"))
    own = F.when(F.col("p_partkey") % 9 == 0, F.struct("surah", "ayah")).otherwise(F.col("least"))
    quoted = F.col("p_size") % 6 > 0
    rows = v.join(least, "text").select(
        F.col("surah").alias("doc_id"), F.lit(1).alias("para"), F.col("ayah").cast("long").alias("ord"), F.when(quoted, "quran").otherwise("text").alias("kind"), F.concat("text", F.lit(" ١٢.")).alias("content"),
        F.when(quoted, verses.source_name(own["surah"], own["ayah"])).otherwise("").alias("source"), F.lit(0.9).alias("score"), F.lit("").alias("note"),
    )
    return verses.prefer_sequence(rows, v.select("surah", "ayah", "text")).select("doc_id", F.col("ord").cast("int").alias("ord"), "source", "note")


def _nearest_sql(ref: str) -> str:
    """Of the places in the surah of ``ref`` the first behind it, else the first."""
    return f"coalesce(list_filter(s.spot, lambda p: p.surah = {ref}.surah AND p.ayah > {ref}.ayah)[1], list_filter(s.spot, lambda p: p.surah = {ref}.surah)[1])"


@query(
    f"""WITH RECURSIVE {VERSES}, k AS (SELECT surah AS doc_id, ayah AS ord, CASE WHEN p_size % 8 = 1 THEN 'quran' WHEN p_size % 8 = 2 THEN 'citation' ELSE 'text' END AS kind, CASE WHEN p_size % 8 = 3 THEN NULL ELSE spot END AS spot,
        CASE WHEN p_size % 8 = 1 AND p_partkey % 5 > 0 THEN {{'surah': CASE WHEN p_partkey % 2 = 0 THEN surah ELSE spot[1].surah END, 'ayah': ayah}} END AS ref FROM v JOIN spots USING (text)),
    s AS (SELECT *, lead(kind) OVER o AS next_kind, lead(ref) OVER o AS next_ref FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY ord)),
    w AS (SELECT doc_id, 0 AS ord, 'none' AS kind, NULL::STRUCT(surah VARCHAR, ayah INT) AS place, false AS changed FROM (SELECT DISTINCT doc_id FROM s)
        UNION ALL SELECT doc_id, ord, CASE WHEN t THEN 'quran' ELSE kind END, CASE WHEN t THEN p ELSE ref END, t FROM (
            SELECT s.doc_id, s.ord, s.kind, s.ref, s.kind = 'text' AND s.spot IS NOT NULL AND (w.kind = 'quran' OR coalesce(s.next_kind = 'quran', false)) AS t,
                coalesce(CASE WHEN w.kind = 'quran' THEN {_nearest_sql('w.place')} END, CASE WHEN s.next_kind = 'quran' THEN {_nearest_sql('s.next_ref')} END, s.spot[1]) AS p
            FROM w JOIN s ON s.doc_id = w.doc_id AND s.ord = w.ord + 1))
    SELECT doc_id, ord, kind, CASE WHEN place IS NULL THEN '' ELSE 'سورة ' || place.surah || ' — ' || place.ayah END AS source, CASE WHEN changed THEN 'short verse among verses' ELSE '' END AS note FROM w WHERE ord > 0"""
)
def short_verses(spark: SparkSession, folder: str) -> DataFrame:
    """Names of parts among prose: those beside a verse, or beside one that has just become one, are verses as well."""
    v, size = _verses(spark, folder), F.col("p_size") % 8
    least = v.groupBy("text").agg(F.min(F.struct("surah", "ayah")).alias("least"))
    surah = F.when(F.col("p_partkey") % 2 == 0, F.col("surah")).otherwise(F.col("least.surah"))
    rows = v.join(least, "text").select(
        F.col("surah").alias("doc_id"), F.lit(1).alias("para"), F.col("ayah").cast("long").alias("ord"), F.when(size == 1, "quran").when(size == 2, "citation").otherwise("text").alias("kind"),
        F.when(size == 3, F.concat("text", F.lit(" and more"))).otherwise(F.concat("text", F.lit(" ٣ ."))).alias("content"), F.when((size == 1) & (F.col("p_partkey") % 5 > 0), verses.source_name(surah, F.col("ayah"))).otherwise("").alias("source"),
        F.lit(0.5).alias("score"), F.lit("").alias("note"),
    )
    return verses.rescue_short(rows, v.select("surah", "ayah", "text")).select("doc_id", F.col("ord").cast("int").alias("ord"), "kind", "source", "note")


@query(
    f"""WITH RECURSIVE {VERSES}, n AS (SELECT surah AS doc_id, (ayah - 1) // 3 AS unit, ayah AS i, CASE WHEN p_size % 5 = 0 THEN 'strange thing' ELSE text END AS name FROM v),
    u AS (SELECT doc_id, unit, unit // 4 AS para, string_agg(name, ' ١ ' ORDER BY i) AS content FROM n GROUP BY ALL),
    w AS (SELECT doc_id, unit // 5 AS run, unit, i, unnest(string_split(name, ' ')) AS w, generate_subscripts(string_split(name, ' '), 1) AS k FROM n WHERE unit % 5 < 4),
    t AS (SELECT *, row_number() OVER o AS pos, lead(w) OVER o AS nx, coalesce(lag(unit) OVER o <> unit, true) AS opens, coalesce(lead(unit) OVER o <> unit, true) AS closes FROM w WINDOW o AS (PARTITION BY doc_id, run ORDER BY i, k)),
    m AS (SELECT t.doc_id, t.run, t.unit, t.i, t.pos, t.opens, e.closes, v.surah, v.ayah, t.pos - 2 * v.ayah AS shift FROM t JOIN v ON v.text = t.w || ' ' || t.nx JOIN t e ON e.doc_id = t.doc_id AND e.run = t.run AND e.pos = t.pos + 1),
    g AS (SELECT *, ayah - row_number() OVER (PARTITION BY doc_id, run, surah, shift ORDER BY ayah) AS island FROM m),
    b AS (SELECT *, min(ayah) FILTER (opens) OVER o AS lo, max(ayah) FILTER (closes) OVER o AS hi FROM g WINDOW o AS (PARTITION BY doc_id, run, surah, shift, island)),
    f AS (SELECT * FROM b WHERE hi > lo AND ayah BETWEEN lo AND hi),
    c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY start, stop DESC, surah, shift, island) AS r FROM (SELECT doc_id, run, surah, shift, island, min(pos) AS start, max(pos) + 2 AS stop FROM f GROUP BY ALL)),
    x AS (SELECT doc_id, run, surah, shift, island, stop, r FROM c WHERE r = 1
        UNION ALL SELECT c.doc_id, c.run, c.surah, c.shift, c.island, c.stop, c.r FROM x JOIN c ON c.doc_id = x.doc_id AND c.run = x.run AND c.start >= x.stop QUALIFY row_number() OVER (PARTITION BY c.doc_id, c.run ORDER BY c.r) = 1),
    y AS (SELECT f.* FROM f JOIN x USING (doc_id, run, surah, shift, island)),
    z AS (SELECT doc_id, y.unit // 4 AS para, y.unit, y.i, 'quran' AS kind, name || CASE WHEN y.i % 3 > 0 AND EXISTS (SELECT 1 FROM n l WHERE l.doc_id = y.doc_id AND l.i = y.i + 1) THEN ' ١' ELSE '' END AS content, 'سورة ' || surah || ' — ' || ayah AS source FROM y JOIN n USING (doc_id, i)
        UNION ALL SELECT doc_id, para, unit, 0, CASE WHEN unit % 5 = 4 THEN 'title' ELSE 'text' END, content, '' FROM u WHERE NOT EXISTS (SELECT 1 FROM y WHERE y.doc_id = u.doc_id AND y.unit = u.unit))
    SELECT doc_id, para, row_number() OVER (PARTITION BY doc_id, para ORDER BY unit, i)::INT AS ord, kind, content, source FROM z"""
)
def verse_chains(spark: SparkSession, folder: str) -> DataFrame:
    """Names of parts in units of three, some of them strange: names that follow one another in some brand, from unit to unit, are verses."""
    v = _verses(spark, folder)
    unit = F.floor((F.col("ayah") - 1) / 3)
    name = F.when(F.col("p_size") % 5 == 0, "strange thing").otherwise(F.col("text"))
    listed = v.groupBy(F.col("surah").alias("doc_id"), unit.alias("unit")).agg(F.array_sort(F.collect_list(F.struct("ayah", name.alias("name")))).alias("l"))
    rows = listed.select(
        "doc_id", F.floor(F.col("unit") / 4).alias("para"), F.col("unit").alias("ord"), F.when(F.col("unit") % 5 == 4, "title").otherwise("text").alias("kind"), F.array_join(F.transform("l", lambda x: x["name"]), " ١ ").alias("content"),
        F.lit("").alias("source"), F.lit(0.5).alias("score"), F.lit("").alias("note"),
    )
    return verses.chain_verses(rows, v.select("surah", "ayah", "text")).select("doc_id", "para", "ord", "kind", "content", "source")
