"""Documents on their way through translation and audit: the operators on rows of the driver's tables.

Customers stand for documents or languages, orders for their phrases, line items
for translations, conversations for the ordered text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, export, match, parse, progress, route, stats, upsert
from .relational import PAIRS, _pairs, query, table

PHRASES = """ph AS (SELECT conv_id AS document_id, conv_id || ':' || turn AS phrase_id, turn AS group_id, 1::BIGINT AS group_order, text, role <> 'system' AS translatable, CASE WHEN turn % 5 = 0 THEN 'naqhara' ELSE 'p' END AS text_type,
        CASE turn % 6 WHEN 0 THEN 'heading1' WHEN 4 THEN 'listparagraph' ELSE 'p' END AS tag, CASE turn % 4 WHEN 1 THEN 'ayah' WHEN 2 THEN 'hadith' ELSE 'text' END AS content_type FROM conversations),
    an AS (SELECT conv_id || ':' || turn AS phrase_id, CASE WHEN turn % 3 = 0 THEN 'quran' ELSE 'plain' END AS kind, CASE WHEN turn % 2 = 0 THEN 'unmatched_quran' WHEN turn % 5 > 0 THEN 'index_match' END AS reason_code FROM conversations WHERE turn % 4 <> 3),
    tr AS (SELECT conv_id || ':' || turn AS phrase_id, CASE WHEN turn % 7 = 3 THEN '  ' ELSE ' ' || text || ' ' END AS translation FROM conversations WHERE (conv_id + turn) % 4 <> 1)"""


def _phrases(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    turns = table(spark, folder, "conversations").withColumn("phrase_id", F.concat_ws(":", "conv_id", "turn"))
    t = F.col("turn")
    phrases = turns.select(
        F.col("conv_id").alias("document_id"), "phrase_id", t.alias("group_id"), F.lit(1).cast("long").alias("group_order"), "text", (F.col("role") != "system").alias("translatable"), F.when(t % 5 == 0, "naqhara").otherwise("p").alias("text_type"),
        F.when(t % 6 == 0, "heading1").when(t % 6 == 4, "listparagraph").otherwise("p").alias("tag"), F.when(t % 4 == 1, "ayah").when(t % 4 == 2, "hadith").otherwise("text").alias("content_type"),
    )
    analysis = turns.filter("turn % 4 <> 3").select("phrase_id", F.when(t % 3 == 0, "quran").otherwise("plain").alias("kind"), F.when(t % 2 == 0, "unmatched_quran").when(t % 5 > 0, "index_match").alias("reason_code"))
    translations = turns.filter("(conv_id + turn) % 4 <> 1").select("phrase_id", F.when(t % 7 == 3, "  ").otherwise(F.concat(F.lit(" "), "text", F.lit(" "))).alias("translation"))
    return phrases, analysis, translations


@query(
    f"""WITH {PHRASES} SELECT document_id, ph.phrase_id, (row_number() OVER (PARTITION BY document_id ORDER BY group_id, group_order))::BIGINT AS seq, text AS source, coalesce(translation, '') AS target, CASE WHEN text_type = 'naqhara' THEN 'transliteration' ELSE 'text' END AS row_type
    FROM ph LEFT JOIN an USING (phrase_id) LEFT JOIN tr USING (phrase_id) WHERE translatable AND NOT coalesce(kind = 'quran' AND NOT coalesce(reason_code = 'unmatched_quran', false), false)"""
)
def job_rows(spark: SparkSession, folder: str) -> DataFrame:
    return audit.audit_rows(*_phrases(spark, folder), has_key=True).withColumn("seq", F.col("seq").cast("long"))


LETTERS = "[^\\p{L}\\p{M}\\p{N}_ ]"


def audited(x: str) -> str:
    return f"lower(trim(regexp_replace(regexp_replace(replace({x}, chr(10), ' '), '{LETTERS}', ' ', 'g'), ' +', ' ', 'g')))"


@query(
    f"""WITH {PAIRS}, n AS (SELECT conv_id * 1000 + turn AS seq, target, source, {audited('source')} AS ns, {audited('target')} AS nt,
        len(regexp_extract_all(target, '[(]')) <> len(regexp_extract_all(target, '[)]')) AS tb, len(regexp_extract_all(source, '[(]')) <> len(regexp_extract_all(source, '[)]')) AS sb FROM pairs)
    SELECT seq, CASE WHEN nt = '' THEN 'FRM-EMP' WHEN ns = nt THEN 'FRM-CPY' WHEN tb AND NOT sb THEN 'FRM-BRK' ELSE '' END AS codes, CASE WHEN nt = '' THEN 'empty' WHEN ns = nt THEN 'copy' END AS skip FROM n"""
)
def rule_findings(spark: SparkSession, folder: str) -> DataFrame:
    pairs = _pairs(spark, folder).select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), "source", "target")
    return audit.apply_rules(pairs).select("seq", F.array_join(F.transform("findings", lambda f: f["code"]), ",").alias("codes"), "skip")


@query(
    """WITH rule AS (SELECT o_custkey AS row_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq, o_orderpriority AS code FROM orders WHERE o_orderstatus = 'F'),
    model AS (SELECT o_custkey AS row_id, o_orderkey AS seq, o_orderstatus AS code FROM orders WHERE o_orderstatus <> 'F'), last AS (SELECT row_id, max(seq) AS m FROM rule GROUP BY 1)
    SELECT row_id, seq::BIGINT AS seq, code FROM rule UNION ALL SELECT row_id, (coalesce(m, 0) + row_number() OVER (PARTITION BY row_id ORDER BY seq))::BIGINT, code FROM model LEFT JOIN last USING (row_id)"""
)
def merged_findings(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("row_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("code"), "o_orderpriority")
    first = upsert.with_reasons(orders.filter("code = 'F'"), [], ["row_id"], "seq").drop("skip_reason")
    from pyspark.sql import Window

    rule = first.select("row_id", F.row_number().over(Window.partitionBy("row_id").orderBy("seq")).alias("seq"), F.col("o_orderpriority").alias("code"))
    return audit.merge_findings(rule, orders.filter("code <> 'F'").select("row_id", "seq", "code")).withColumn("seq", F.col("seq").cast("long"))


@query(
    """WITH r AS (SELECT CASE d.doc_id % 4 WHEN 0 THEN 'skipped' WHEN 1 THEN 'failed' ELSE 'done' END AS status, (d.doc_id % 3)::INT AS e, d.source, d.doc_id % 5 = 0 AS h FROM documents d), f AS (SELECT toxic = 1 AS s FROM labels WHERE quality = 0),
    n AS (SELECT count(*) AS total, count(*) FILTER (status = 'done') AS checked, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (e > 0) AS with_errors, count(*) FILTER (h) AS human,
        sum(len(string_split(source, ' '))) FILTER (status <> 'failed') AS words FROM r), m AS (SELECT count(*) AS errors, count(*) FILTER (s) AS sensitive FROM f)
    SELECT total, checked, skipped, failed, with_errors, human, words::BIGINT AS words, errors, sensitive, 0::BIGINT AS pending, round_even(100.0 * with_errors / (checked + skipped), 1) AS error_rows_pct, round_even(100.0 * errors / (checked + skipped), 2) AS errors_per_100_rows, round_even(1000.0 * errors / words, 2) AS errors_per_1000_words FROM n, m"""
)
def audit_statistics(spark: SparkSession, folder: str) -> DataFrame:
    d = F.col("doc_id")
    status = F.when(d % 4 == 0, "skipped").when(d % 4 == 1, "failed").otherwise("done")
    rows = table(spark, folder, "documents").select(status.alias("status"), (d % 3).cast("int").alias("error_count"), "source", (d % 5 == 0).alias("needs_review"))
    return audit.statistics(rows, table(spark, folder, "labels").filter("quality = 0").select((F.col("toxic") == 1).alias("sensitive")))


@query("SELECT o_orderkey AS row_id, o_custkey AS excel_row, l_linenumber AS seq, l_returnflag AS code, o_orderpriority AS source_text, o_orderstatus AS target_text FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def findings_sheet(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("seq"), F.col("o_orderpriority").alias("source_text"), F.col("o_orderstatus").alias("target_text"))
    return audit.export_findings(rows, table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("row_id"), F.col("l_linenumber").alias("seq"), F.col("l_returnflag").alias("code")))


@query(
    """WITH p AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority <> '5-LOW'), t AS (SELECT o_custkey, count(*) AS n FROM p GROUP BY 1),
    d AS (SELECT l_suppkey, count(*) FILTER (l_returnflag <> 'N') AS translated, count(*) FILTER (l_linestatus = 'F') AS approved FROM lineitem JOIN p ON l_orderkey = o_orderkey GROUP BY 1)
    SELECT s_suppkey AS id, s_nationkey::BIGINT AS document_id, coalesce(translated, 0)::BIGINT AS translated, coalesce(approved, 0)::BIGINT AS approved, coalesce(n, 0)::BIGINT AS total FROM supplier LEFT JOIN d ON l_suppkey = s_suppkey LEFT JOIN t ON o_custkey = s_nationkey"""
)
def progress_counts(spark: SparkSession, folder: str) -> DataFrame:
    phrases = table(spark, folder, "orders").select(F.col("o_orderkey").alias("phrase_id"), F.col("o_custkey").alias("document_id"), (F.col("o_orderpriority") != "5-LOW").alias("translatable"))
    done = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("dt_id"), F.col("l_orderkey").alias("phrase_id"), F.when(F.col("l_returnflag") == "N", "").otherwise("x").alias("translation"), F.when(F.col("l_linestatus") == "F", "approved").otherwise("suggested").alias("status"))
    translations = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("document_id"))
    return progress.counts(translations, phrases, done).select("id", "document_id", "translated", "approved", "total")


ROUTED = """ro AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'skipped_untranslatable' WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN 'skipped_approved' WHEN o_orderstatus = 'O' AND o_orderkey % 3 = 0 THEN 'skipped_existing'
        WHEN o_orderpriority = '1-URGENT' OR o_custkey % 7 = 0 THEN CASE WHEN o_totalprice > 150000 THEN 'quran_extract' ELSE 'quran_fallback' END ELSE 'text' END AS method FROM orders)"""


def _routed(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    third = F.col("o_orderkey") % 3 == 0
    phrases = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("group_id"), F.lit(1).alias("group_order"), (F.col("o_orderpriority") != "5-LOW").alias("translatable"), F.when(F.col("o_orderpriority") == "1-URGENT", "ayah").otherwise("text").alias("content_type"),
        F.when(F.col("o_custkey") % 7 == 0, "quran").alias("kind"), F.when(third & (F.col("o_orderstatus") == "F"), "approved").when(third & (F.col("o_orderstatus") == "O"), "suggested").alias("status"), F.when(F.col("o_totalprice") > 150000, "v").alias("verse"),
    )
    return route.route(phrases, has_key=True, limit=limit)


@query(
    f"""WITH {ROUTED}, n AS (SELECT *, count(*) FILTER (NOT starts_with(method, 'skipped_')) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM ro)
    SELECT o_custkey AS document_id, o_orderkey AS group_id, CASE WHEN starts_with(method, 'skipped_') OR n <= 3 THEN method END AS method FROM n"""
)
def routed_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """The limit is on what a run translates, not on what it reads."""
    return _routed(spark, folder, 3).select("document_id", "group_id", "method")


@query(f"WITH {ROUTED} SELECT method, count(*)::BIGINT AS n FROM (SELECT method FROM ro UNION ALL SELECT 'text' FROM ro WHERE method = 'quran_fallback') GROUP BY 1")
def run_counters(spark: SparkSession, folder: str) -> DataFrame:
    return route.run_counters(_routed(spark, folder))


@query(
    """SELECT o_orderkey, CASE WHEN s IN ('pending', 'translating') THEN CASE WHEN o_orderkey % 5 = 0 OR o_custkey % 5 = 0 THEN 'translating' ELSE 'review' END ELSE s END AS status, (2 + round_even(94.0 * (o_orderkey % 9) / greatest(o_custkey % 9, 1), 0))::BIGINT AS percent
    FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'pending' WHEN 'O' THEN 'translating' ELSE 'approved' END AS s FROM orders)"""
)
def run_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    status = F.when(F.col("o_orderstatus") == "F", "pending").when(F.col("o_orderstatus") == "O", "translating").otherwise("approved")
    return table(spark, folder, "orders").select("o_orderkey", route.finished(status, o % 5 == 0, c % 5 == 0).alias("status"), progress.polling_percent(o % 9, c % 9).cast("long").alias("percent"))


@query("SELECT n_regionkey::VARCHAR AS phrase_id, string_agg(n_name || '=' || lower(c), ';' ORDER BY n_name) AS pairs FROM nation JOIN (SELECT s_nationkey AS k, min(s_name) AS c FROM supplier WHERE s_suppkey % 3 = 0 GROUP BY 1) ON k = n_nationkey GROUP BY 1")
def equivalents(spark: SparkSession, folder: str) -> DataFrame:
    nations = table(spark, folder, "nation")
    glossary = nations.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("ar"), F.lit("").alias("en"))
    names = table(spark, folder, "supplier").filter("s_suppkey % 3 = 0").groupBy(F.col("s_nationkey").alias("glossary_id")).agg(F.lower(F.min("s_name")).alias("title")).withColumn("iso", F.lit("FR"))
    pairs = route.term_pairs(nations.select(F.col("n_regionkey").cast("string").alias("phrase_id"), F.col("n_nationkey").alias("glossary_id")), glossary, names, "fr")
    return pairs.select("phrase_id", F.array_join(F.transform("pairs", lambda p: F.concat(p["ar"], F.lit("="), p["title"])), ";").alias("pairs"))


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def keyed_languages(spark: SparkSession, folder: str) -> DataFrame:
    keys = table(spark, folder, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("language_id"))
    return route.languages_with_key(table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), keys)


@query("SELECT n_nationkey, n_name FROM nation WHERE lower(n_name) = lower('NaTiOn_7')")
def language_by_code(spark: SparkSession, folder: str) -> DataFrame:
    """One language is looked up: the limit to it is the feature."""
    nations = table(spark, folder, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("iso_code"), F.col("n_name").alias("name"))
    return route.language_of(nations, "NaTiOn_7").select(F.col("id").alias("n_nationkey"), F.col("name").alias("n_name"))


@query(
    """WITH b AS (SELECT doc_id, md5(text) AS k, CASE WHEN length(text) < 50 THEN 'short' WHEN source = 'web0' THEN 'source' END AS bad FROM documents)
    SELECT doc_id, CASE WHEN bad IS NOT NULL THEN bad WHEN row_number() OVER (PARTITION BY k, bad IS NULL ORDER BY doc_id) > 1 THEN 'duplicate' END AS skip_reason FROM b"""
)
def import_reasons(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", F.length("text").alias("n"), F.md5(F.col("text").cast("binary")).alias("k"))
    return upsert.with_reasons(docs, [(F.col("n") < 50, "short"), (F.col("source") == "web0", "source")], ["k"], "doc_id").select("doc_id", "skip_reason")


@query("WITH t AS (SELECT 'Title' AS title UNION ALL SELECT 'Title (' || r_regionkey || ')' FROM region) SELECT 'Title (' || min(i) || ')' AS title FROM range(2, 1000) x(i) WHERE 'Title (' || i || ')' NOT IN (SELECT title FROM t)")
def unique_title(spark: SparkSession, folder: str) -> DataFrame:
    numbered = table(spark, folder, "region").select(F.concat(F.lit("Title ("), F.col("r_regionkey").cast("string"), F.lit(")")).alias("title"))
    return upsert.free_title(numbered.unionByName(spark.createDataFrame([("Title",)], "title string")), "Title")


@query(
    """SELECT p_partkey AS id, p_brand AS language, row_number() OVER (PARTITION BY p_brand ORDER BY (p_size % 10 = 0)::INT DESC, CASE WHEN p_size % 10 = 0 THEN -p_partkey ELSE p_partkey END) = 1 AS is_default FROM part"""
)
def format_defaults(spark: SparkSession, folder: str) -> DataFrame:
    return upsert.default_formats(table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("language"), (F.col("p_size") % 10 == 0).alias("is_default")))


KINDS = ["quran", "hadith", "athar", "title", "attribution", "citation", "term", "text", "uncertain"]
SEGMENTS = f"""sg AS (SELECT o_custkey AS doc_id, o_orderkey // 4000 AS para, o_orderkey AS ord, ({KINDS})[o_orderkey % 9 + 1] AS kind, o_orderstatus || o_orderkey AS content, CASE WHEN o_orderkey % 2 = 0 THEN 's' || o_orderkey ELSE '' END AS source,
        CASE WHEN o_totalprice > 100000 THEN (o_orderkey % 11) / 10.0 END::DOUBLE AS score, CASE o_orderkey % 5 WHEN 0 THEN '{export.UNMATCHED_VERSE}' WHEN 1 THEN '{export.UNMATCHED_TRADITION}' WHEN 2 THEN '{export.CITATION_NOTE}' WHEN 3 THEN '⚠ {export.VARIANT}' END AS note,
        (o_orderkey % 3)::INT AS level, o_orderpriority = '5-LOW' AS footnote FROM orders)"""


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("o_orderkey")
    note = F.when(p % 5 == 0, export.UNMATCHED_VERSE).when(p % 5 == 1, export.UNMATCHED_TRADITION).when(p % 5 == 2, export.CITATION_NOTE).when(p % 5 == 3, f"⚠ {export.VARIANT}")
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("doc_id"), F.floor(p / 4000).alias("para"), p.alias("ord"), F.element_at(F.array(*map(F.lit, KINDS)), (p % 9 + 1).cast("int")).alias("kind"), F.concat("o_orderstatus", p.cast("string")).alias("content"),
        F.when(p % 2 == 0, F.concat(F.lit("s"), p.cast("string"))).otherwise("").alias("source"), F.when(F.col("o_totalprice") > 100000, p % 11 / F.lit(10.0)).alias("score"), note.alias("note"), (p % 3).cast("int").alias("level"),
        (F.col("o_orderpriority") == "5-LOW").alias("footnote"), F.array().cast("array<struct<arabic:string,english:string,surface:string,kind:string>>").alias("terms"),
    )


def cases(table_: dict, key: str, other: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in table_.items()) + f" ELSE {other} END"


SHARE = f"""(CASE WHEN kind = 'quran' AND contains(note, '{export.VARIANT}') THEN 0.2 WHEN kind IN ('quran', 'hadith', 'athar') AND score IS NOT NULL THEN round_even(score, 3) WHEN note = '{export.CITATION_NOTE}' THEN 1.0
    WHEN note = '{export.UNMATCHED_VERSE}' THEN 0.2 WHEN note = '{export.UNMATCHED_TRADITION}' THEN 0.25 ELSE {cases(export.CONFIDENCE, 'kind', '0.4')} END)::DOUBLE"""
CODE = f"""CASE WHEN kind = 'quran' AND contains(note, '{export.VARIANT}') THEN 'unmatched_quran' WHEN kind IN ('quran', 'hadith') OR kind = 'athar' AND score IS NOT NULL THEN 'index_match' WHEN note = '{export.UNMATCHED_VERSE}' THEN 'unmatched_quran'
    WHEN note = '{export.UNMATCHED_TRADITION}' THEN 'unmatched_hadith' WHEN note = '{export.CITATION_NOTE}' THEN 'citation_ref' ELSE {cases(export.REASON, 'kind', "'no_evidence'")} END"""
SHEET = f"""{SEGMENTS}, sh AS (SELECT *, CASE WHEN footnote THEN 'footnote' WHEN kind = 'title' AND level > 0 THEN 'heading' || level ELSE 'p' END AS tag, {SHARE} AS confidence, {CODE} AS reason_code,
    CASE WHEN footnote THEN 5 ELSE {cases(export.CONTENT_TYPE, 'kind', '4')} END::BIGINT AS content_type_id, row_number() OVER (PARTITION BY doc_id ORDER BY para, ord) AS seq, dense_rank() OVER (PARTITION BY doc_id ORDER BY para) AS para_no FROM (SELECT * REPLACE (coalesce(note, '') AS note) FROM sg))"""


@query(f"WITH {SHEET} SELECT doc_id, seq::BIGINT AS seq, para_no::BIGINT AS para_no, tag, confidence, reason_code, content_type_id FROM sh")
def pipeline_sheet(spark: SparkSession, folder: str) -> DataFrame:
    rows = export.sheet_rows(_segments(spark, folder))
    return rows.select("doc_id", F.col("seq").cast("long").alias("seq"), "para_no", "tag", F.col("confidence").cast("double").alias("confidence"), "reason_code", F.col("content_type_id").cast("long").alias("content_type_id"))


@query(
    f"""WITH {SHEET} SELECT doc_id, 'o' || doc_id AS title, count(DISTINCT para_no)::BIGINT AS paragraphs, count(*)::BIGINT AS phrases, count(*) FILTER (confidence < 0.3)::BIGINT AS needs_review, count(*) FILTER (kind = 'quran')::BIGINT AS quran,
        count(*) FILTER (content_type_id = 5)::BIGINT AS footnotes, min_by(content, seq) AS first_text FROM sh GROUP BY doc_id"""
)
def document_payload(spark: SparkSession, folder: str) -> DataFrame:
    """The payload, read back from its JSON."""
    rows = export.sheet_rows(_segments(spark, folder)).withColumn("title", F.concat(F.lit("o"), F.col("doc_id").cast("string")))
    rows = rows.withColumn("phrase_id", F.concat_ws(":", "doc_id", "seq"))
    kind = "struct<document:struct<paragraphs:long,phrases:long,needs_review:long,by_kind:map<string,long>,by_content_type:map<string,long>>,phrases:array<struct<arabic_text:string>>>"
    read = export.payload(rows).select("doc_id", "title", F.from_json("payload", kind).alias("p"))
    none = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return read.select(
        "doc_id", "title", "p.document.paragraphs", "p.document.phrases", "p.document.needs_review", none(F.try_element_at("p.document.by_kind", F.lit("quran"))).alias("quran"), none(F.try_element_at("p.document.by_content_type", F.lit("footnote"))).alias("footnotes"),
        F.get("p.phrases", F.lit(0))["arabic_text"].alias("first_text"),
    )


@query(
    f"""WITH {PHRASES}, j AS (SELECT ph.*, coalesce(nullif(trim(translation), ''), CASE WHEN NOT translatable THEN text END) AS shown FROM ph LEFT JOIN tr USING (phrase_id))
    SELECT document_id, phrase_id AS id, CASE tag WHEN 'heading1' THEN 'title' WHEN 'p' THEN CASE WHEN text_type = 'naqhara' THEN 'naqhara' ELSE 'paragraph' END ELSE CASE WHEN text_type = 'naqhara' THEN 'naqhara' ELSE tag END END AS type,
        CASE tag WHEN 'heading1' THEN 'h1' ELSE 'p' END AS tag, CASE content_type WHEN 'ayah' THEN 'aya' WHEN 'hadith' THEN 'hadith' ELSE 'normal' END AS sub_type, group_id AS split_group, shown AS translation FROM j WHERE shown IS NOT NULL"""
)
def book(spark: SparkSession, folder: str) -> DataFrame:
    phrases, _, translations = _phrases(spark, folder)
    return export.book_rows(phrases, translations).select("document_id", "id", "type", "tag", "sub_type", "split_group", "translation")


@query(f"WITH {PHRASES} SELECT document_id, phrase_id FROM ph WHERE translatable AND phrase_id NOT IN (SELECT phrase_id FROM tr WHERE trim(translation) <> '')")
def missing_translations(spark: SparkSession, folder: str) -> DataFrame:
    phrases, _, translations = _phrases(spark, folder)
    return export.missing(phrases, translations)


@query(
    f"""WITH {PHRASES} SELECT document_id, (row_number() OVER (PARTITION BY document_id ORDER BY group_id, group_order))::BIGINT AS n, phrase_id, CASE WHEN tag = 'heading1' THEN 'heading' ELSE content_type END AS kind, text, coalesce(trim(translation), '') AS translation,
        translatable AND coalesce(trim(translation), '') = '' AS missing FROM ph LEFT JOIN tr USING (phrase_id)"""
)
def translation_rows(spark: SparkSession, folder: str) -> DataFrame:
    phrases, _, translations = _phrases(spark, folder)
    return export.translation_sheet(phrases, translations).withColumn("n", F.col("n").cast("long"))


@query(f"WITH {PHRASES} SELECT document_id, count(tr.phrase_id)::BIGINT AS done, count(*)::BIGINT AS total FROM ph LEFT JOIN tr USING (phrase_id) WHERE translatable GROUP BY 1")
def screen_totals(spark: SparkSession, folder: str) -> DataFrame:
    phrases, _, translations = _phrases(spark, folder)
    return route.screen_totals(phrases, translations)


@query(
    f"""WITH {PHRASES}, e AS (SELECT phrase_id, ['la', 'the'] AS titles FROM ph WHERE group_id % 2 = 1), p AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY group_id, group_order) - 1 AS place FROM ph)
    SELECT document_id, place::BIGINT AS place, translation, CASE WHEN coalesce(kind, 'plain') = 'quran' THEN 'locked' WHEN titles IS NOT NULL AND (contains(lower(translation), 'la') OR contains(lower(translation), 'the')) THEN 'glossary' END AS source, translatable
    FROM p LEFT JOIN an USING (phrase_id) JOIN tr USING (phrase_id) LEFT JOIN e USING (phrase_id)"""
)
def screen_sources(spark: SparkSession, folder: str) -> DataFrame:
    phrases, analysis, translations = _phrases(spark, folder)
    titles = phrases.filter("group_id % 2 = 1").select("phrase_id", F.array(F.lit("la"), F.lit("the")).alias("titles"))
    rows = route.screen_progress(phrases.join(analysis.select("phrase_id", "kind"), "phrase_id", "left"), translations, titles, has_key=True)
    return rows.withColumn("place", F.col("place").cast("long"))


@query("SELECT o_custkey, o_orderstatus AS status, count(*)::BIGINT AS n FROM orders GROUP BY 1, 2")
def status_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return stats.histogram(table(spark, folder, "orders").select("o_custkey", F.col("o_orderstatus").alias("status")), ["o_custkey"], "status")


@query(
    """WITH m AS (SELECT conv_id, substr(text, 1, 20) AS m, min(turn) AS t FROM conversations WHERE role <> 'system' GROUP BY 1, 2)
    SELECT conv_id, substr(string_agg(m, '؛ ' ORDER BY t), 1, 100) AS error_message FROM m GROUP BY 1"""
)
def job_messages(spark: SparkSession, folder: str) -> DataFrame:
    """The cut is the feature: a message column of bounded length."""
    return stats.messages(table(spark, folder, "conversations").filter("role <> 'system'"), ["conv_id"], "turn", "text", 20, 100)


@query(
    """WITH g AS (SELECT conv_id, count(*) AS n, count(DISTINCT turn) AS d, count(*) FILTER (gap) AS gaps FROM (SELECT conv_id, turn, turn <> lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) + 1 AS gap FROM conversations) GROUP BY 1)
    SELECT count(*)::BIGINT AS groups, sum(n)::BIGINT AS total, sum(gaps)::BIGINT AS gaps, count(*) = 114 AND sum(n) = 6236 AND sum(gaps) = 0 AND sum(n) = sum(d) AS complete FROM g"""
)
def corpus_check(spark: SparkSession, folder: str) -> DataFrame:
    return stats.whole_corpus(table(spark, folder, "conversations"), "conv_id", "turn", 114, 6236)


@query(
    """WITH v AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS surah_no, n_name AS surah_name FROM nation), r AS (SELECT event_id, ([ 'سورة NATION_6 — 2', 'سورة  NATION_2 – 1', 'NATION_6 — 2', 'سورة NOWHERE - 3', 'سورة NATION_9 - 4' ])[event_id % 5 + 1] AS reference FROM events)
    SELECT event_id, reference, CASE WHEN event_id % 5 IN (0, 1, 4) THEN surah_no END AS surah_no, CASE event_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 4 THEN 4 END::BIGINT AS ayah_no FROM r LEFT JOIN v ON surah_name = CASE event_id % 5 WHEN 0 THEN 'NATION_6' WHEN 1 THEN 'NATION_2' WHEN 4 THEN 'NATION_9' END"""
)
def verse_references(spark: SparkSession, folder: str) -> DataFrame:
    nations = table(spark, folder, "nation").select((F.col("n_nationkey") + 1).cast("long").alias("surah_no"), F.col("n_name").alias("surah_name"))
    verses = nations.withColumn("ayah_no", F.explode(F.sequence(F.lit(1), F.lit(4))))
    texts = ["سورة NATION_6 — 2", "سورة  NATION_2 – 1", "NATION_6 — 2", "سورة NOWHERE - 3", "سورة NATION_9 - 4"]
    rows = table(spark, folder, "events").select("event_id", F.element_at(F.array(*map(F.lit, texts)), (F.col("event_id") % 5 + 1).cast("int")).alias("reference"))
    return match.parse_references(rows, verses).select("event_id", "reference", "surah_no", F.col("ayah_no").cast("long").alias("ayah_no"))


@query("SELECT a.conv_id AS surah, a.turn AS ayah, b.turn AS near_ayah, b.role AS near_text FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 1 AND a.turn + 3")
def nearby_turns(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select(F.col("conv_id").alias("surah"), F.col("turn").alias("ayah"), F.col("role").alias("text"))
    return match.nearby_verses(turns.select("surah", "ayah"), turns)


@query(
    """WITH i AS (SELECT conv_id, turn, turn % 3 AS n FROM conversations)
    SELECT 'g' || conv_id AS group_key, turn AS id, 's' || turn AS summary, CASE WHEN n > 0 THEN 1 ELSE 0 END::BIGINT AS errors, CASE n WHEN 1 THEN 'حرج' WHEN 2 THEN 'متوسط' END AS severity, CASE n WHEN 1 THEN 90 WHEN 2 THEN 70 END::BIGINT AS confidence, CASE n WHEN 1 THEN true WHEN 2 THEN false END AS review FROM i"""
)
def model_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Answers as a model writes them, one for each conversation, read back as findings; each error is given twice."""
    turn = F.col("turn").cast("string")
    error = F.when(F.col("turn") % 3 == 1, '{"code":"x","severity":"Critical","confidence":"0.9"}').when(F.col("turn") % 3 == 2, '{"code":"y","severity":"?","confidence":"high"}')
    item = F.concat(F.lit('{"id":"'), turn, F.lit('","summary":" s'), turn, F.lit(' ","errors":['), F.coalesce(F.concat(error, F.lit(","), error), F.lit("")), F.lit("]}"))
    answers = table(spark, folder, "conversations").groupBy("conv_id").agg(F.array_join(F.collect_list(item), ",").alias("items"))
    texts = answers.select(F.concat(F.lit("g"), F.col("conv_id").cast("string")).alias("group_key"), F.concat(F.lit("Here [as asked]:\n```json\n["), "items", F.lit("]\n```")).alias("text"))
    first = F.get("errors", F.lit(0))
    return parse.validated(texts).select("group_key", "id", "summary", F.size("errors").cast("long").alias("errors"), first["severity"].alias("severity"), first["confidence"].cast("long").alias("confidence"), first["needs_human_review"].alias("review"))


@query(
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 7.5 ELSE pow(2, event_id % 5) END::DOUBLE AS delay, CASE event_id % 3 WHEN 0 THEN 't' || event_id END AS text, CASE event_id % 3 WHEN 1 THEN 'no candidate (blockReason=SAFETY)' WHEN 2 THEN 'no quota' END AS problem,
        CASE event_id % 3 WHEN 0 THEN event_id ELSE 0 END::BIGINT AS tokens FROM events"""
)
def model_replies(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("event_id")
    good = F.concat(F.lit('{"response":{"candidates":[{"content":{"parts":[{"text":"x","thought":true},{"text":"t'), n.cast("string"), F.lit('"}]}}],"usageMetadata":{"promptTokenCount":'), n.cast("string"), F.lit("}}}"))
    reply = F.when(n % 3 == 0, good).when(n % 3 == 1, '{"response":{"promptFeedback":{"blockReason":"SAFETY"}}}').otherwise('{"error":{"message":"no quota"}}')
    parts = parse.reply_parts(reply)
    body = F.when(n % 3 == 0, '{"retryDelay": "7.5s"}').otherwise("")
    return table(spark, folder, "events").select("event_id", parse.retry_delay(body, n % 5).alias("delay"), parts["text"].alias("text"), parts["problem"].alias("problem"), parts["tokens_in"].cast("long").alias("tokens"))


@query(
    f"""WITH {SHEET}, c AS (SELECT *, CASE WHEN kind = 'title' THEN content END AS t, CASE WHEN kind IN ('hadith', 'athar') THEN 1 ELSE 0 END AS h FROM sh)
    SELECT doc_id, para, ord, coalesce(last_value(t IGNORE NULLS) OVER w, '') AS part, CASE WHEN h = 1 THEN sum(h) OVER w END::BIGINT AS fn, CASE kind WHEN 'quran' THEN 'aya' WHEN 'hadith' THEN kind WHEN 'athar' THEN kind WHEN 'term' THEN kind ELSE 'text' END AS k,
        round_even(CASE WHEN kind = 'citation' THEN 1.0 ELSE confidence END * 100, 0)::INT || '%' AS conf FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY para, ord ROWS UNBOUNDED PRECEDING)"""
)
def screen_segments(spark: SparkSession, folder: str) -> DataFrame:
    return export.screen_rows(_segments(spark, folder)).select("doc_id", "para", "ord", "part", F.col("fn").cast("long").alias("fn"), "k", "conf")


@query(
    f"""WITH {SHEET}, l AS (SELECT DISTINCT doc_id || ':' || seq AS phrase_id, n_nationkey AS glossary_id FROM sh JOIN nation ON n_nationkey = ord % 40)
    SELECT phrase_id, glossary_id::BIGINT AS glossary_id FROM l"""
)
def saved_links(spark: SparkSession, folder: str) -> DataFrame:
    """Terms of phrases that the glossary has; each of a phrase's terms is named twice."""
    term = F.struct(F.concat(F.lit("NATION_"), (F.col("ord") % 40).cast("string"), F.lit(" ")).alias("arabic"), F.lit("").alias("english"), F.lit("").alias("surface"), F.lit("terms").alias("kind"))
    rows = export.sheet_rows(_segments(spark, folder).withColumn("terms", F.array(term, term))).withColumn("phrase_id", F.concat_ws(":", "doc_id", "seq"))
    glossary = table(spark, folder, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.concat(F.lit("NATION_"), F.col("n_nationkey").cast("string")).alias("ar"))
    return export.saved(rows, glossary)[2]


@query(
    """WITH b AS (SELECT o_custkey AS document_id, o_orderkey AS id, o_orderkey AS g, o_orderpriority = '5-LOW' AS note, CASE WHEN o_orderpriority = '5-LOW' THEN NULL WHEN o_orderstatus = 'F' THEN '[' || o_orderkey || ']' END AS m FROM orders),
    n AS (SELECT *, count(*) FILTER (m IS NOT NULL) OVER w AS seen, CASE WHEN note THEN 1 WHEN m IS NOT NULL THEN -1 ELSE 0 END AS d FROM b WINDOW w AS (PARTITION BY document_id ORDER BY g ROWS UNBOUNDED PRECEDING)),
    s AS (SELECT *, sum(d) OVER w AS bal FROM n WINDOW w AS (PARTITION BY document_id ORDER BY g ROWS UNBOUNDED PRECEDING)), x AS (SELECT *, greatest(max(bal) OVER w, 0) AS lost FROM s WINDOW w AS (PARTITION BY document_id ORDER BY g ROWS UNBOUNDED PRECEDING)),
    k AS (SELECT *, greatest(coalesce(max(bal) OVER (PARTITION BY document_id ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS lost_before, (count(*) FILTER (note) OVER (PARTITION BY document_id ORDER BY g ROWS UNBOUNDED PRECEDING)) AS notes FROM x),
    t AS (SELECT *, CASE WHEN note AND lost = lost_before THEN notes - lost END AS take FROM k)
    SELECT a.document_id, a.id::VARCHAR AS id, h.id::VARCHAR AS host, h.m AS marker FROM t a LEFT JOIN (SELECT document_id, id, m, seen FROM t WHERE m IS NOT NULL) h ON h.document_id = a.document_id AND h.seen = a.take WHERE a.note"""
)
def footnote_hosts(spark: SparkSession, folder: str) -> DataFrame:
    """Each footnote takes the first marker before it that is free, or none."""
    o = F.col("o_orderkey")
    note = F.col("o_orderpriority") == "5-LOW"
    text = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("text["), o.cast("string"), F.lit("] more"))).otherwise("text")
    rows = table(spark, folder, "orders").select(F.col("o_custkey").alias("document_id"), o.alias("id"), o.alias("split_group"), F.lit(1).alias("group_order"), F.when(note, "footnote").otherwise("paragraph").alias("type"), text.alias("original_text"))
    return export.footnote_hosts(rows)


@query(
    """WITH b AS (SELECT o_custkey AS document_id, o_orderkey AS id, o_orderkey // 4000 AS g, CASE WHEN o_orderkey % 3 = 0 THEN 'aya' WHEN o_orderkey % 3 = 1 THEN 'p' || (o_orderkey // 4000) ELSE 'x' || o_orderkey END AS v FROM orders),
    c AS (SELECT *, CASE WHEN v = lag(v) OVER w THEN 0 ELSE 1 END AS new FROM b WINDOW w AS (PARTITION BY document_id ORDER BY g, id)) SELECT document_id, id, (sum(new) OVER (PARTITION BY document_id ORDER BY g, id ROWS UNBOUNDED PRECEDING))::BIGINT AS run FROM c"""
)
def book_runs(spark: SparkSession, folder: str) -> DataFrame:
    o = F.col("o_orderkey")
    rows = table(spark, folder, "orders").select(F.col("o_custkey").alias("document_id"), o.alias("id"), F.floor(o / 4000).alias("split_group"), o.alias("group_order"), F.lit("paragraph").alias("type"), F.when(o % 3 == 0, "aya").when(o % 3 == 1, "normal").otherwise("hadith").alias("sub_type"))
    return export.runs(rows).select("document_id", "id", F.col("run").cast("long").alias("run"))


@query(
    """WITH o AS (SELECT event_id, event_type AS k, CASE event_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'FALSE' ELSE 'maybe' END AS v FROM events)
    SELECT event_id, CASE WHEN k IN ('click', 'view') THEN '' ELSE k END AS unknown, CASE WHEN k = 'click' AND v = 'maybe' THEN 'click' ELSE '' END AS wrong, v AS last, CASE WHEN k = 'click' THEN v ELSE 'd' END AS click FROM o"""
)
def options(spark: SparkSession, folder: str) -> DataFrame:
    """Defaults, options and layout laid over one another, and what is wrong with the options."""
    value = F.when(F.col("event_id") % 3 == 0, "true").when(F.col("event_id") % 3 == 1, "FALSE").otherwise("maybe")
    given, known = F.create_map(F.col("event_type"), value), F.array(F.lit("click"), F.lit("view"))
    bad = export.invalid_options(given, known, F.array(F.lit("click")))
    laid = export.preferences(F.create_map(F.lit("click"), F.lit("d")), given, F.create_map(F.lit("last"), value))
    return table(spark, folder, "events").select("event_id", F.array_join(bad["unknown"], ",").alias("unknown"), F.array_join(bad["not_boolean"], ",").alias("wrong"), F.try_element_at(laid, F.lit("last")).alias("last"), F.try_element_at(laid, F.lit("click")).alias("click"))


@query(
    f"""WITH {SHEET}, a AS (SELECT doc_id || ':' || seq AS phrase_id, {cases(export.KIND, 'kind', "'plain'")} AS kind, reason_code, round_even(confidence * 100, 0)::INT AS c, CASE WHEN kind IN ('hadith', 'athar') THEN '' ELSE source END AS reference FROM sh)
    SELECT doc_id, para_no::BIGINT AS para, content, CASE a.kind WHEN 'heading' THEN 'title' WHEN 'plain' THEN 'text' ELSE a.kind END AS kind, reference AS source, a.c / 100.0 AS confidence, a.reason_code FROM sh JOIN a ON a.phrase_id = doc_id || ':' || seq"""
)
def segments_again(spark: SparkSession, folder: str) -> DataFrame:
    """Saved and read back: phrases, analyses and links."""
    rows = export.sheet_rows(_segments(spark, folder)).withColumn("phrase_id", F.concat_ws(":", "doc_id", "seq"))
    phrases, analysis, links = export.saved(rows, spark.createDataFrame([], "id long, ar string"))
    back = export.stored_segments(phrases, analysis, links, spark.createDataFrame([], "id long, ar string, en string"))
    return back.select("doc_id", "para", "content", "kind", "source", "confidence", "reason_code")


@query(
    """WITH m AS (SELECT l_orderkey AS phrase_id, l_suppkey % 25 + 1 AS s, l_linenumber AS a FROM lineitem), v AS (SELECT s_suppkey AS ayah_id, s_nationkey + 1 AS s, s_suppkey % 7 + 1 AS a, s_name AS t FROM supplier)
    SELECT phrase_id, t AS verse FROM m JOIN v ON m.s = v.s AND m.a = v.a WHERE ayah_id % 2 = 0"""
)
def approved_verses(spark: SparkSession, folder: str) -> DataFrame:
    """Approved translations of matched verses under one key; the other half of the verses has none."""
    matches = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("phrase_id"), (F.col("l_suppkey") % 25 + 1).alias("surah_no"), F.col("l_linenumber").alias("ayah_no"))
    supplier = table(spark, folder, "supplier")
    verses = supplier.select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") + 1).alias("surah_no"), (F.col("s_suppkey") % 7 + 1).alias("ayah_no"))
    texts = supplier.select(F.col("s_suppkey").alias("ayah_id"), (F.col("s_suppkey") % 2).alias("key_id"), F.col("s_name").alias("text"))
    return route.approved_verses(matches, verses, texts, 0)
