"""The relational operators over the driver's tables, each with the same statement in SQL.

``QUERIES`` maps a name to (function of (spark, folder), SQL).  Both read whole
tables and alias every column.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import context, ngram, phrases, stats, upsert
from ..sources.scratch import written
from ..sources.tables import read_table as table
from ..sources.tables import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def paragraphs_of(docs: DataFrame) -> DataFrame:
    """(doc_id, para, text): non-empty lines, numbered from 1 in each document."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.btrim(x)), lambda x: x != "")
    return spread(docs.select("doc_id", "text")).select("doc_id", F.posexplode(lines).alias("pos", "text")).select("doc_id", (F.col("pos") + 1).cast("long").alias("para"), "text")


PARAGRAPHS = """
    paras AS (
        SELECT doc_id, unnest(range(1, len(l) + 1)) AS para, unnest(l) AS text
        FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)
    )"""

ACCENTS, PLAIN = "áéíóúàèìòùâêîôûäëïöüñçÁÉÍÓÚÀÈÌÒÙÂÊÎÔÛÄËÏÖÜÑÇ", "aeiouaeiouaeiouaeiouncAEIOUAEIOUAEIOUAEIOUNC"
MARKS = "[^A-Za-z0-9ß]+"
#: The same class sign by sign, which the JVM looks up in a table; ranges it asks one after the other.
LISTED = f"[^{string.ascii_letters}{string.digits}ß]+"


def plain_form(text: Column) -> Column:
    """The normal form's shape on Latin letters: accents folded, punctuation to spaces, collapsed, lower case."""
    return F.lower(F.btrim(F.regexp_replace(F.translate(text, ACCENTS, PLAIN), LISTED, " ")))


def plain_sql(text: str) -> str:
    return f"lower(trim(regexp_replace(translate({text}, '{ACCENTS}', '{PLAIN}'), '{MARKS}', ' ', 'g')))"


@query(f"WITH {PARAGRAPHS} SELECT doc_id, para, text, length(text)::BIGINT AS n_chars, (row_number() OVER (PARTITION BY doc_id ORDER BY para))::BIGINT AS ord FROM paras")
def paragraph_scan(spark: SparkSession, folder: str) -> DataFrame:
    paras = paragraphs_of(table(spark, folder, "documents"))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("para")).cast("long")
    return paras.select("doc_id", "para", "text", F.length("text").cast("long").alias("n_chars"), order.alias("ord"))


@query(f"SELECT doc_id, {plain_sql('text')} AS normal, len(string_split({plain_sql('text')}, ' '))::BIGINT AS n_words FROM documents")
def normalize_text(spark: SparkSession, folder: str) -> DataFrame:
    normal = plain_form(F.col("text"))
    return spread(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", normal.alias("normal"), F.size(F.split(normal, " ")).cast("long").alias("n_words"))


@query(
    f"""WITH {PARAGRAPHS}, h AS (SELECT p.doc_id, para, sha1(d.source || '|' || para || ':1|' || p.text) AS h FROM paras p JOIN documents d USING (doc_id))
    SELECT doc_id, para, h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS phrase_id FROM h"""
)
def phrase_id(spark: SparkSession, folder: str) -> DataFrame:
    from ..functions.identity import phrase_id as derive

    docs = table(spark, folder, "documents")
    # The source travels with the text: no join back to the documents.
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.btrim(x)), lambda x: x != "")
    paras = docs.select("doc_id", "source", F.posexplode(lines).alias("pos", "text")).withColumn("para", (F.col("pos") + 1).cast("long"))
    return paras.select("doc_id", "para", derive(F.col("source"), F.col("para"), F.lit(1), F.col("text")).alias("phrase_id"))


GRAMS = """grams({id}, g) AS (
    SELECT DISTINCT {id}, unnest(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' '))) FROM (SELECT {id}, string_split({form}, ' ') AS w FROM {t})
)"""
CANDIDATES = f"""
    WITH {PARAGRAPHS}, p AS (SELECT doc_id * 1000000000 + para AS key, text FROM paras),
    d_{GRAMS.format(id="key", n=3, form=plain_sql("text"), t="p")},
    b_{GRAMS.format(id="item_id", n=3, form=plain_sql("text"), t="benchmark")},
    hits AS (SELECT key, item_id, count(*)::BIGINT AS hits FROM d_grams JOIN b_grams USING (g) GROUP BY 1, 2),
    top AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY hits DESC, item_id) AS rn FROM hits)"""


def _keyed_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return paragraphs_of(table(spark, folder, "documents")).select((F.col("doc_id") * 1_000_000_000 + F.col("para")).alias("key"), F.split(plain_form(F.col("text")), " ").alias("words"))


def _items(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select("item_id", F.split(plain_form(F.col("text")), " ").alias("words"))


@query(CANDIDATES + " SELECT key, item_id, hits, rn::BIGINT AS rn FROM top WHERE rn <= 5")
def ngram_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return ngram.candidates(_keyed_paragraphs(spark, folder), _items(spark, folder), "key", "item_id", 3, 5)


@query(CANDIDATES + " SELECT key, item_id, hits, rn::BIGINT AS rn FROM top WHERE rn <= 1")
def ngram_best(spark: SparkSession, folder: str) -> DataFrame:
    return ngram.candidates(_keyed_paragraphs(spark, folder), _items(spark, folder), "key", "item_id", 3, 1)


@query(
    f"""WITH {PARAGRAPHS}, p AS (SELECT doc_id * 1000000000 + para AS key, text FROM paras WHERE len(string_split({plain_sql("text")}, ' ')) <= 3),
    d3_{GRAMS.format(id="key", n=3, form=plain_sql("text"), t="p")}, b3_{GRAMS.format(id="item_id", n=3, form=plain_sql("text"), t="benchmark")},
    h3 AS (SELECT key, item_id, count(*)::BIGINT AS hits, 3 AS tier FROM d3_grams JOIN b3_grams USING (g) GROUP BY 1, 2),
    d2_{GRAMS.format(id="key", n=2, form=plain_sql("text"), t="p")}, b2_{GRAMS.format(id="item_id", n=2, form=plain_sql("text"), t="benchmark")},
    h2 AS (SELECT key, item_id, count(*)::BIGINT AS hits, 2 AS tier FROM d2_grams JOIN b2_grams USING (g) WHERE key NOT IN (SELECT key FROM h3) GROUP BY 1, 2),
    d1_{GRAMS.format(id="key", n=1, form=plain_sql("text"), t="p")}, b1_{GRAMS.format(id="item_id", n=1, form=plain_sql("text"), t="benchmark")},
    h1 AS (SELECT key, item_id, count(*)::BIGINT AS hits, 1 AS tier FROM d1_grams JOIN b1_grams USING (g) WHERE key NOT IN (SELECT key FROM h3) AND key NOT IN (SELECT key FROM h2) GROUP BY 1, 2),
    every AS (SELECT * FROM h3 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h1),
    top AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY hits DESC, item_id) AS rn FROM every)
    SELECT key, item_id, hits, tier::BIGINT AS tier, rn::BIGINT AS rn FROM top WHERE rn <= 5"""
)
def ngram_fallback(spark: SparkSession, folder: str) -> DataFrame:
    short = _keyed_paragraphs(spark, folder).filter(F.size("words") <= 3)
    return ngram.tiered_candidates(short, _items(spark, folder), "key", "item_id", (3, 2, 1), 5)


@query(
    """WITH needles AS (SELECT item_id, unnest(list_filter(string_split(lower(text), '. '), lambda x: len(string_split(x, ' ')) >= 3)) AS needle FROM benchmark)
    SELECT DISTINCT d.doc_id, n.item_id FROM documents d JOIN needles n ON contains(lower(d.text), n.needle)"""
)
def contains_join(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a sentence of a benchmark passage, of three words or more."""
    sentences = F.filter(F.split(F.lower("text"), "[.] "), lambda x: F.size(F.split(x, " ")) >= 3)
    needles = table(spark, folder, "benchmark").select("item_id", F.explode(sentences).alias("needle"))
    return phrases.containing(spread(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", F.lower("text").alias("text")), needles, "doc_id", "item_id")


@query(
    CANDIDATES
    + f""", q AS (SELECT key, list_distinct(string_split({plain_sql("text")}, ' ')) AS w FROM p), r AS (SELECT item_id, list_distinct(string_split({plain_sql("text")}, ' ')) AS w FROM benchmark)
    SELECT key, item_id, hits, round(len(list_intersect(q.w, r.w)) / len(q.w), 6) AS coverage, CASE WHEN len(list_intersect(q.w, r.w)) / len(q.w) >= 0.8 THEN 'match' ELSE 'plain' END AS label
    FROM top JOIN q USING (key) JOIN r USING (item_id) WHERE rn <= 5"""
)
def coverage_score(spark: SparkSession, folder: str) -> DataFrame:
    paras, items = _keyed_paragraphs(spark, folder), _items(spark, folder)
    # Few paragraphs have candidates: these are settled, so that the words of the others are not dealt out.
    top = written(ngram.candidates(paras, items, "key", "item_id", 3, 5), "candidates")
    paras = paras.join(ngram.small(top.select("key").distinct()), "key", "left_semi")
    both = top.join(paras.withColumnRenamed("words", "q"), "key").join(ngram.small(items.withColumnRenamed("words", "r")), "item_id")
    share = ngram.coverage(F.col("q"), F.col("r"))
    return both.select("key", "item_id", "hits", F.round(share, 6).alias("coverage"), F.when(share >= 0.8, "match").otherwise("plain").alias("label"))


@query(
    """SELECT conv_id, turn, role,
        array_to_string(list_filter([lag(text, 2) OVER w, lag(text) OVER w], lambda x: x IS NOT NULL), ' ') AS before, lead(role) OVER w AS next_role,
        last_value(CASE WHEN role <> 'assistant' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_other
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"""
)
def neighbour_context(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    return context.neighbours(turns, ["conv_id"], ["turn"], "text", "role").select(
        "conv_id", "turn", "role", "before", F.col("next_kind").alias("next_role"), context.last_where(F.col("role") != "assistant", F.col("turn"), ["conv_id"], ["turn"]).alias("last_other")
    )


@query(
    """WITH c AS (SELECT *, CASE WHEN role = lag(role) OVER w THEN 0 ELSE 1 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM c)
    SELECT conv_id, run::BIGINT AS run, role, min(turn)::BIGINT AS first_turn, count(*)::BIGINT AS n FROM r GROUP BY conv_id, run, role"""
)
def islands(spark: SparkSession, folder: str) -> DataFrame:
    runs = context.runs(table(spark, folder, "conversations"), ["conv_id"], ["turn"], F.col("role"))
    return runs.groupBy("conv_id", "run", "role").agg(F.min("turn").cast("long").alias("first_turn"), F.count(F.lit(1)).alias("n"))


@query(
    """WITH e AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM e)
    SELECT user_id, run::BIGINT AS run, event_type, min(event_id)::BIGINT AS first_event, count(*)::BIGINT AS n FROM r GROUP BY 1, 2, 3"""
)
def event_islands(spark: SparkSession, folder: str) -> DataFrame:
    runs = context.runs(table(spark, folder, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type"))
    return runs.groupBy("user_id", "run", "event_type").agg(F.min("event_id").cast("long").alias("first_event"), F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, turn, role, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS splitted FROM conversations WHERE length(text) > 40")
def split_flags(spark: SparkSession, folder: str) -> DataFrame:
    kept = table(spark, folder, "conversations").filter(F.length("text") > 40)
    return kept.select("conv_id", "turn", "role", context.continues(F.col("role"), ["conv_id"], ["turn"]).alias("splitted"))


@query(
    """SELECT o_custkey, o_orderkey, (n // 20)::BIGINT AS chunk, 'j' || o_custkey || '-g' || lpad((n // 20)::VARCHAR, 5, '0') AS group_key
    FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders)"""
)
def chunk_groups(spark: SparkSession, folder: str) -> DataFrame:
    return context.chunks(table(spark, folder, "orders").select("o_custkey", "o_orderkey"), "o_custkey", ["o_orderkey"], 20).select("o_custkey", "o_orderkey", "chunk", "group_key")


@query(
    """SELECT l_orderkey, l_linenumber, dr::BIGINT AS para_no, ord::BIGINT AS ord, (dr * 10)::VARCHAR || CASE WHEN ord = 1 THEN '' ELSE '_' || ((ord - 1) * 10)::VARCHAR END AS csv_id
    FROM (SELECT l_orderkey, l_linenumber, l_suppkey, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey) AS dr, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber) AS ord FROM lineitem)"""
)
def dense_csv_id(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    return context.csv_ids(lines, "l_orderkey", "l_suppkey", "l_linenumber").select("l_orderkey", "l_linenumber", "para_no", "ord", "csv_id")


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus, round(arg_max(o_totalprice, o_orderkey), 6) AS o_totalprice FROM orders GROUP BY o_custkey")
def latest_per_group(spark: SparkSession, folder: str) -> DataFrame:
    newest = stats.latest(table(spark, folder, "orders"), ["o_custkey"], "o_orderkey", ["o_orderstatus", "o_totalprice"])
    return newest.select("o_custkey", "o_orderkey", "o_orderstatus", F.round("o_totalprice", 6).alias("o_totalprice"))


@query(
    """SELECT c_custkey, count(o_orderkey)::BIGINT AS total, count(*) FILTER (o_orderkey IS NOT NULL AND o_totalprice > 100000)::BIGINT AS translated,
        count(*) FILTER (o_orderkey IS NOT NULL AND o_orderstatus = 'F')::BIGINT AS approved, count(DISTINCT o_orderstatus)::BIGINT AS statuses
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"""
)
def conditional_counts(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")
    # A set of the few statuses counts them in one shuffle, which a distinct count would not.
    # The orders are counted before they meet the customers: the join is by customer, not by order.
    counted = orders.groupBy("o_custkey").agg(
        F.count("o_orderkey").alias("total"), F.count_if(F.col("o_totalprice") > 100000).alias("translated"), F.count_if(F.col("o_orderstatus") == "F").alias("approved"), F.size(F.collect_set("o_orderstatus")).cast("long").alias("statuses")
    )
    joined = table(spark, folder, "customer").select("c_custkey").join(counted, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.select("c_custkey", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "translated", "approved", "statuses")))


@query(
    """WITH t AS (
        SELECT c_nationkey, c_custkey, CASE min(o_orderstatus) WHEN 'F' THEN 'translating' WHEN 'O' THEN 'review' ELSE 'approved' END AS status, count(*) AS total,
            count(*) FILTER (o_totalprice > 100000) AS translated, count(*) FILTER (o_orderstatus = 'F') AS approved
        FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2
    ), p AS (SELECT *, CASE status WHEN 'approved' THEN 100 WHEN 'review' THEN floor(60 + 20 * (approved / total) + 0.5) ELSE floor(40 + 20 * (translated / total) + 0.5) END AS progress,
        CASE status WHEN 'translating' THEN 3 WHEN 'review' THEN 4 ELSE 5 END AS stage FROM t)
    SELECT n_nationkey, coalesce(min(stage), 2)::BIGINT AS stage_index, coalesce(floor(avg(progress) + 0.5), 40)::BIGINT AS progress, count(c_custkey)::BIGINT AS languages
    FROM nation LEFT JOIN p ON c_nationkey = n_nationkey GROUP BY n_nationkey"""
)
def progress_rollup(spark: SparkSession, folder: str) -> DataFrame:
    from ..operators.progress import document_progress, translation_rows

    orders = table(spark, folder, "orders").groupBy("o_custkey").agg(
        F.min("o_orderstatus").alias("s"), F.count(F.lit(1)).alias("total"), F.count_if(F.col("o_totalprice") > 100000).alias("translated"), F.count_if(F.col("o_orderstatus") == "F").alias("approved")
    )
    status = F.when(F.col("s") == "F", "translating").when(F.col("s") == "O", "review").otherwise("approved")
    rows = table(spark, folder, "customer").join(orders, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("document_id"), F.col("c_custkey").alias("id"), status.alias("status"), "total", "translated", "approved")
    rolled = document_progress(table(spark, folder, "nation").select(F.col("n_nationkey").alias("document_id")), translation_rows(rows))
    return rolled.select(F.col("document_id").alias("n_nationkey"), F.col("stage_index").cast("long").alias("stage_index"), F.col("progress").cast("long").alias("progress"), "languages")


@query(
    """SELECT source, d.lang, count(*)::BIGINT AS phrases, count(DISTINCT d.doc_id)::BIGINT AS documents, count(*) FILTER (quality = 1)::BIGINT AS good, count(*) FILTER (quality = 0)::BIGINT AS poor,
        count(*) FILTER (l.doc_id IS NULL)::BIGINT AS unlabelled, sum(n_chars)::BIGINT AS chars
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1, 2"""
)
def doc_summary(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "lang", "n_chars")
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("l_id"), "quality")
    return docs.join(labels, F.col("doc_id") == F.col("l_id"), "left").groupBy("source", "lang").agg(
        F.count(F.lit(1)).alias("phrases"),
        F.count_distinct("doc_id").alias("documents"),
        F.count_if(F.col("quality") == 1).alias("good"),
        F.count_if(F.col("quality") == 0).alias("poor"),
        F.count_if(F.col("l_id").isNull()).alias("unlabelled"),
        F.sum("n_chars").alias("chars"),
    )


PAIRS = """
    turns AS (SELECT conv_id, turn, role, text AS source, lead(role) OVER w AS r2, lead(text) OVER w AS t FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    pairs AS (SELECT conv_id, turn, source, CASE WHEN turn % 7 = 2 THEN '' WHEN turn % 5 = 0 THEN source WHEN conv_id % 3 = 0 THEN t || ' (' ELSE t END AS target FROM turns WHERE role = 'user' AND r2 = 'assistant')"""


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, folder, "conversations").withColumns({"r2": F.lead("role").over(w), "t": F.lead("text").over(w)}).filter((F.col("role") == "user") & (F.col("r2") == "assistant"))
    target = F.when(F.col("turn") % 7 == 2, "").when(F.col("turn") % 5 == 0, F.col("text")).when(F.col("conv_id") % 3 == 0, F.concat("t", F.lit(" ("))).otherwise(F.col("t"))
    return turns.select("conv_id", "turn", F.col("text").alias("source"), target.alias("target"))


@query(
    f"""WITH {PAIRS}, n AS (SELECT *, lower(trim(regexp_replace(source, '[^A-Za-z0-9]+', ' ', 'g'))) AS ns, lower(trim(regexp_replace(target, '[^A-Za-z0-9]+', ' ', 'g'))) AS nt,
        len(regexp_extract_all(target, '[(]')) <> len(regexp_extract_all(target, '[)]')) AS tb, len(regexp_extract_all(source, '[(]')) <> len(regexp_extract_all(source, '[)]')) AS sb FROM pairs)
    SELECT conv_id, turn, nt = '' AS emp, nt <> '' AND ns = nt AS cpy, nt <> '' AND ns <> nt AND tb AND NOT sb AS brk,
        CASE WHEN nt = '' THEN 'empty' WHEN ns = nt THEN 'copy' END AS skip_reason FROM n"""
)
def audit_rules(spark: SparkSession, folder: str) -> DataFrame:
    form = lambda c: F.lower(F.btrim(F.regexp_replace(c, "[^A-Za-z0-9]+", " ")))
    odd = lambda c: F.regexp_count(c, F.lit("[(]")) != F.regexp_count(c, F.lit("[)]"))
    n = _pairs(spark, folder).withColumns({"ns": form("source"), "nt": form("target")})
    empty, copy = F.col("nt") == "", F.col("ns") == F.col("nt")
    return n.select(
        "conv_id", "turn", empty.alias("emp"), (~empty & copy).alias("cpy"), (~empty & ~copy & odd("target") & ~odd("source")).alias("brk"), F.when(empty, "empty").when(copy, "copy").alias("skip_reason")
    )


@query(f"WITH {PAIRS}, r AS (SELECT length(trim(target)) / length(trim(source)) AS r FROM pairs WHERE length(trim(source)) >= 20 AND length(trim(target)) > 0) SELECT count(*)::BIGINT AS n, CASE WHEN count(*) >= 10 THEN round(median(r), 6) END AS median_ratio FROM r")
def length_ratio_median(spark: SparkSession, folder: str) -> DataFrame:
    from ..operators.audit import median_ratio

    return median_ratio(_pairs(spark, folder)).select("n", F.round("median_ratio", 6).alias("median_ratio"))


@query("SELECT md5(text) AS text_key, count(*)::BIGINT AS n, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM documents WHERE length(text) >= 3 GROUP BY text HAVING count(*) >= 2 AND bool_and(len(string_split(text, ' ')) >= 3)")
def duplicate_targets(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").filter(F.length("text") >= 3)
    # A digest is shuffled, not the text.
    keyed = docs.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_key"), (F.size(F.split("text", " ")) >= 3).alias("long"))
    found = keyed.groupBy("text_key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.bool_and("long").alias("long"))
    return found.filter((F.col("n") >= 2) & F.col("long")).drop("long")


FINDINGS = "f AS (SELECT doc_id, CASE WHEN quality = 0 AND toxic = 1 THEN 4 WHEN quality = 0 THEN 3 WHEN toxic = 1 THEN 1 END AS rank, toxic = 1 AS sensitive FROM labels)"


def _findings(spark: SparkSession, folder: str) -> DataFrame:
    poor, toxic = F.col("quality") == 0, F.col("toxic") == 1
    severity = F.when(poor & toxic, "critical").when(poor, "major").when(toxic, "minor")
    return table(spark, folder, "labels").select("doc_id", severity.alias("severity"), toxic.alias("sensitive"))


@query(
    f"""WITH {FINDINGS}, g AS (SELECT d.source, max(rank) AS top, count(rank)::BIGINT AS errors, coalesce(bool_or(sensitive), false) AS sensitive FROM documents d LEFT JOIN f USING (doc_id) GROUP BY 1)
    SELECT source, errors, CASE top WHEN 4 THEN 'critical' WHEN 3 THEN 'major' WHEN 2 THEN 'moderate' WHEN 1 THEN 'minor' END AS max_severity,
        CASE WHEN top IS NULL THEN 'accepted' WHEN top >= 3 THEN 'rejected' ELSE 'review' END AS verdict, sensitive, coalesce(top = 4, false) OR sensitive AS needs_review FROM g"""
)
def verdict_fold(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source")
    return stats.verdicts(docs.join(_findings(spark, folder), "doc_id", "left"), ["source"])


@query(
    f"""WITH {FINDINGS}, dim(rank, severity) AS (VALUES (4, 'critical'), (3, 'major'), (2, 'moderate'), (1, 'minor')), n AS (SELECT count(rank) AS total FROM f)
    SELECT severity, count(f.rank)::BIGINT AS n, CASE WHEN total > 0 THEN round(100.0 * count(f.rank) / total, 1) ELSE 0 END AS pct FROM n CROSS JOIN dim LEFT JOIN f USING (rank) GROUP BY severity, total"""
)
def job_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return stats.breakdown(_findings(spark, folder).filter(F.col("severity").isNotNull()), "severity", stats.SEVERITIES)


@query(
    """SELECT c_custkey, CASE WHEN count(o_orderkey) = 0 OR bool_and(o_orderstatus = 'F') THEN 'done' WHEN bool_or(o_orderstatus = 'O') THEN 'running' WHEN bool_or(o_orderstatus = 'F') THEN 'partial' ELSE 'failed' END AS status
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"""
)
def job_status(spark: SparkSession, folder: str) -> DataFrame:
    from ..operators.audit import job_statuses

    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "failed").otherwise("pending")
    groups = table(spark, folder, "orders").select(F.col("o_custkey").alias("job_id"), status.alias("status"))
    return job_statuses(table(spark, folder, "customer").select(F.col("c_custkey").alias("job_id")), groups).withColumnRenamed("job_id", "c_custkey")


OLD = "old AS (SELECT p_partkey AS key, p_brand AS brand, p_size AS size FROM part WHERE p_partkey % 11 <> 0)"
NEW = "new AS (SELECT p_partkey AS key, CASE WHEN p_partkey % 5 = 0 THEN p_brand || '*' ELSE p_brand END AS brand, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_size END AS size FROM part WHERE p_partkey % 13 <> 0)"


@query(
    f"""WITH {OLD}, {NEW} SELECT coalesce(o.key, n.key) AS key, CASE WHEN o.key IS NULL THEN 'create' WHEN n.key IS NULL THEN 'keep' WHEN o.brand IS DISTINCT FROM n.brand OR o.size IS DISTINCT FROM n.size THEN 'update' ELSE 'unchanged' END AS action,
        CASE WHEN n.key IS NULL THEN o.brand ELSE n.brand END AS brand, CASE WHEN n.key IS NULL THEN o.size ELSE n.size END AS size FROM old o FULL JOIN new n ON o.key = n.key"""
)
def upsert_diff(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    new = part.filter("key % 13 <> 0").withColumns({"brand": F.when(F.col("key") % 5 == 0, F.concat("brand", F.lit("*"))).otherwise(F.col("brand")), "size": F.when(F.col("key") % 17 != 0, F.col("size"))})
    return upsert.diff(part.filter("key % 11 <> 0"), new, ["key"])


@query("SELECT md5(text) AS text_key, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, (count(*) - 1)::BIGINT AS skipped FROM documents GROUP BY text")
def first_wins_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("text_key"))
    marked = upsert.with_reasons(docs, [], ["text_key"], "doc_id")
    first = F.col("skip_reason").isNull()
    pick = lambda c: F.max(F.when(first, F.col(c))).alias(c)
    return marked.groupBy("text_key").agg(pick("doc_id"), pick("source"), F.count_if(F.col("skip_reason") == "duplicate").alias("skipped"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def missing_ids(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").filter("o_totalprice > 250000").select("o_custkey")
    return upsert.missing_keys(table(spark, folder, "customer").select("c_custkey"), orders, "c_custkey", "o_custkey")


@query("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE NOT coalesce(l.quality = 1 AND NOT (l.toxic = 1), false)")
def null_safe_exclude(spark: SparkSession, folder: str) -> DataFrame:
    from ..operators.audit import not_all

    docs, labels = table(spark, folder, "documents").select("doc_id"), table(spark, folder, "labels").select("doc_id", "quality", "toxic")
    return docs.join(labels, "doc_id", "left").filter(not_all(F.col("quality") == 1, ~(F.col("toxic") == 1))).select("doc_id", "quality")


@query(
    """WITH e AS (SELECT event_id, event_type || ' — ' || json_extract_string(props, '$.n') AS reference FROM events), p AS (SELECT event_id, regexp_extract(reference, '^(.+?) — ([0-9]+)$', 1) AS name, try_cast(regexp_extract(reference, '^(.+?) — ([0-9]+)$', 2) AS BIGINT) AS no FROM e)
    SELECT event_id, name, no, n_name FROM p LEFT JOIN nation ON n_nationkey = no"""
)
def reference_parse(spark: SparkSession, folder: str) -> DataFrame:
    from ..operators.match import reference_parts

    events = table(spark, folder, "events").select("event_id", F.concat("event_type", F.lit(" — "), F.get_json_object("props", "$.n")).alias("reference"))
    parsed = events.select("event_id", reference_parts(F.col("reference"), "^(.+?) — ([0-9]+)$").alias("p")).select("event_id", "p.name", F.col("p.number").cast("long").alias("no"))
    return parsed.join(F.broadcast(table(spark, folder, "nation").select("n_nationkey", "n_name")), F.col("no") == F.col("n_nationkey"), "left").select("event_id", "name", "no", "n_name")


@query(
    """SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, regexp_extract(url, '^https?://[^/]+/([a-z]{2})/', 1) AS lang, try_cast(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) AS number FROM pages"""
)
def url_parse(spark: SparkSession, folder: str) -> DataFrame:
    get = lambda p: F.regexp_extract("url", p, 1)
    return table(spark, folder, "pages").select("page_id", F.lower(get("^https?://([^/?#]+)")).alias("host"), get("^https?://[^/]+/([a-z]{2})/").alias("lang"), get("/([0-9]+)").try_cast("long").alias("number"))


@query(
    """SELECT conv_id, count(*)::BIGINT AS n, count(DISTINCT turn)::BIGINT AS turns, count(*) FILTER (gap)::BIGINT AS gaps FROM
    (SELECT conv_id, turn, turn <> lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) + 1 AS gap FROM conversations) GROUP BY conv_id"""
)
def gap_check(spark: SparkSession, folder: str) -> DataFrame:
    return stats.gaps(table(spark, folder, "conversations"), "conv_id", "turn").withColumnRenamed("distinct", "turns")


@query(
    """SELECT l_orderkey, l_linenumber, (count(*) OVER w)::BIGINT AS n, (sum(l_quantity) OVER w)::DOUBLE AS quantity
    FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber RANGE BETWEEN 1 PRECEDING AND 3 FOLLOWING)"""
)
def range_window(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    # A range frame instead of a self-join: one shuffle, and each row is read once.
    frame = Window.partitionBy("l_orderkey").orderBy("l_linenumber").rangeBetween(-1, 3)
    return lines.select("l_orderkey", "l_linenumber", F.count(F.lit(1)).over(frame).alias("n"), F.sum("l_quantity").over(frame).cast("double").alias("quantity"))


@query("SELECT event_type, count(*)::BIGINT AS n, (row_number() OVER (ORDER BY count(*) DESC, event_type))::BIGINT AS place FROM events GROUP BY event_type")
def top_types(spark: SparkSession, folder: str) -> DataFrame:
    return stats.most_common(table(spark, folder, "events"), ["event_type"])


@query("SELECT word, count(*)::BIGINT AS df FROM (SELECT DISTINCT doc_id, unnest(string_split(lower(text), ' ')) AS word FROM documents) WHERE word <> '' GROUP BY word HAVING count(*) >= 0.3 * (SELECT count(*) FROM documents)")
def doc_frequency_cut(spark: SparkSession, folder: str) -> DataFrame:
    docs = spread(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", F.split(F.lower("text"), " ").alias("words"))
    return stats.common_words(docs, 0.3)


@query(
    """SELECT conv_id, turn, (CASE WHEN role = 'system' THEN 1.0 WHEN role = 'assistant' AND length(text) >= 200 THEN 0.6 WHEN length(text) < 20 THEN 0.2 ELSE 0.4 END)::DOUBLE AS confidence,
        CASE WHEN role = 'system' THEN 'heading' WHEN role = 'assistant' AND length(text) >= 200 THEN 'formula' WHEN length(text) < 20 THEN 'unmatched' ELSE 'none' END AS reason FROM conversations"""
)
def label_case(spark: SparkSession, folder: str) -> DataFrame:
    long = (F.col("role") == "assistant") & (F.length("text") >= 200)
    pick = lambda a, b, c, d: F.when(F.col("role") == "system", a).when(long, b).when(F.length("text") < 20, c).otherwise(d)
    return table(spark, folder, "conversations").select("conv_id", "turn", pick(1.0, 0.6, 0.2, 0.4).alias("confidence"), pick("heading", "formula", "unmatched", "none").alias("reason"))


@query(
    """WITH e AS (SELECT o_orderkey, o_orderstatus = 'F' AS approve, o_custkey % 4 <> 0 AS translatable, CASE WHEN o_custkey % 6 = 0 THEN '' ELSE o_orderpriority END AS text,
        CASE o_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'suggested' ELSE 'approved' END AS status FROM orders)
    SELECT o_orderkey, CASE WHEN approve AND text = '' AND translatable THEN 'rejected' WHEN approve THEN 'approved' WHEN status IS NULL OR NOT translatable THEN 'deleted' WHEN status = 'approved' THEN 'suggested' ELSE status END AS outcome FROM e"""
)
def state_transition(spark: SparkSession, folder: str) -> DataFrame:
    from ..operators.route import approval

    key = F.col("o_custkey")
    events = table(spark, folder, "orders").select(
        "o_orderkey", (F.col("o_orderstatus") == "F").alias("approve"), (key % 4 != 0).alias("translatable"), F.when(key % 6 == 0, "").otherwise(F.col("o_orderpriority")).alias("text"),
        F.when(key % 3 == 1, "suggested").when(key % 3 == 2, "approved").alias("status"),
    )
    return events.select("o_orderkey", approval(F.col("approve"), F.col("translatable"), F.col("text"), F.col("status")).alias("outcome"))


@query(
    f"""WITH {PARAGRAPHS} SELECT doc_id, count(*)::BIGINT AS phrases, count(DISTINCT para)::BIGINT AS paragraphs, count(*) FILTER (length(text) < 20)::BIGINT AS needs_review,
        count(*) FILTER (text LIKE '%?%')::BIGINT AS questions, min(text) AS first_text FROM paras GROUP BY doc_id"""
)
def payload_json(spark: SparkSession, folder: str) -> DataFrame:
    """The scalar parts of the document payload, read back from its JSON."""
    paras = paragraphs_of(table(spark, folder, "documents"))
    shaped = paras.groupBy("doc_id").agg(
        F.to_json(F.struct(F.count(F.lit(1)).alias("phrases"), F.count_distinct("para").alias("paragraphs"), F.count_if(F.length("text") < 20).alias("needs_review"), F.count_if(F.col("text").contains("?")).alias("questions"), F.min("text").alias("first_text"))).alias("payload")
    )
    parsed = shaped.select("doc_id", F.from_json("payload", "phrases long, paragraphs long, needs_review long, questions long, first_text string").alias("p"))
    return parsed.select("doc_id", "p.*")


def entry(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs matched against reference passages by shared 3-grams, verified by coverage, counted by label."""
    scored = coverage_score(spark, folder)
    best = scored.groupBy("key").agg(F.max_by("label", "coverage").alias("label"), F.max("coverage").alias("coverage"))
    return best.groupBy("label").agg(F.count(F.lit(1)).alias("paragraphs"), F.round(F.avg("coverage"), 6).alias("mean_coverage"))


__all__ = ["QUERIES", "T", "entry"]
