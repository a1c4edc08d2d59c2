"""Smaller operators over the driver's tables, each with the same statement in SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.similarity import ratio_udf
from ..operators import audit, context, glossary, ngram, prompts, segment
from ..sources.scratch import written
from .relational import PARAGRAPHS, paragraphs_of, plain_form, plain_sql, query, table


@query(
    f"""WITH w AS (SELECT conv_id, turn, string_split({plain_sql('text')}, ' ') AS l FROM conversations), p AS (SELECT DISTINCT l[1] AS a, l[len(l)] AS b FROM w),
    d AS (SELECT a, b, list_reduce(list_transform(range(1, len(a) + 1), lambda i: [ord(a[i])]), lambda row, c: list_concat([0], list_transform(range(1, len(b) + 1),
        lambda j: list_max(list_transform(range(1, j + 1), lambda i: greatest(row[i + 1], CASE WHEN ord(b[i]) = c[1] THEN row[i] + 1 ELSE 0 END))))), list_transform(range(len(b) + 1), lambda x: 0)) AS row FROM p)
    SELECT a, b, round(CASE WHEN len(a) + len(b) = 0 THEN 100 ELSE 200.0 * row[len(b) + 1] / (len(a) + len(b)) END, 6) AS ratio FROM d"""
)
def word_ratios(spark: SparkSession, folder: str) -> DataFrame:
    """The similarity of the first and the last word of each turn: twice the longest common subsequence, of both lengths."""
    words = table(spark, folder, "conversations").select(F.split(plain_form(F.col("text")), " ").alias("l"))
    pairs = words.select(F.element_at("l", 1).alias("a"), F.element_at("l", -1).alias("b")).distinct()
    return pairs.select("a", "b", F.round(ratio_udf("a", "b"), 6).alias("ratio"))


@query(
    f"""WITH {PARAGRAPHS}, names AS (SELECT array_to_string(string_split({plain_sql('text')}, ' ')[1:2], ' ') AS name FROM benchmark)
    SELECT DISTINCT doc_id, para FROM paras JOIN names ON contains(' ' || {plain_sql('text')} || ' ', ' ' || name || ' ')"""
)
def names_contained(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs in which the first two words of some benchmark passage stand in a row."""
    paras = paragraphs_of(table(spark, folder, "documents")).select(F.struct("doc_id", "para").alias("key"), F.split(plain_form(F.col("text")), " ").alias("words"))
    names = table(spark, folder, "benchmark").select(F.slice(F.split(plain_form(F.col("text")), " "), 1, 2).alias("name"))
    return ngram.contains_name(paras, names, "key").select("key.doc_id", "key.para")


@query(
    """WITH e AS (SELECT event_id, user_id, list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS l FROM events),
    r AS (SELECT event_id, list_reverse(coalesce(l, [])) AS l FROM e)
    SELECT event_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:3], ',') AS recent FROM r"""
)
def recent_types(spark: SparkSession, folder: str) -> DataFrame:
    """The last three distinct types among the eight events of a user before each one."""
    recent = context.recent_references(F.col("event_type"), ["user_id"], ["ts", "event_id"])
    return table(spark, folder, "events").select("event_id", F.array_join(recent, ",").alias("recent"))


@query(
    f"""WITH {PARAGRAPHS}, s AS (SELECT doc_id, para, CASE para % 5 WHEN 0 THEN '( ) ' WHEN 1 THEN text[1:20] || ' ( ) ' || text[21:60] WHEN 2 THEN '. () .' ELSE text[1:60] END AS content FROM paras),
    m AS (SELECT *, contains(replace(content, ' ', ''), '()') AS m FROM s), b AS (SELECT doc_id, para, m, CASE WHEN m THEN trim(regexp_replace(content, '\\s*\\(\\s*\\)', '', 'g')) ELSE content END AS content FROM m)
    SELECT doc_id, para, content FROM b WHERE NOT m OR regexp_matches(content, '[\\p{{L}}\\p{{N}}_]')"""
)
def bracket_drop(spark: SparkSession, folder: str) -> DataFrame:
    """Segments without empty brackets; those that have nothing else are gone."""
    para, text = F.col("para"), F.col("text")
    content = F.when(para % 5 == 0, "( ) ").when(para % 5 == 1, F.concat(F.substring(text, 1, 20), F.lit(" ( ) "), F.substring(text, 21, 40))).when(para % 5 == 2, ". () .").otherwise(F.substring(text, 1, 60))
    return segment.drop_empty_brackets(paragraphs_of(table(spark, folder, "documents")).select("doc_id", "para", content.alias("content")))


@query(
    """WITH l AS (SELECT l_orderkey, row_number() OVER w - 1 AS i, CASE l_returnflag WHEN 'N' THEN 'text' ELSE l_returnflag END AS tag FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag)),
    g AS (SELECT *, i - row_number() OVER (PARTITION BY l_orderkey, tag ORDER BY i) AS g FROM l)
    SELECT l_orderkey, min(i)::INT AS start, (max(i) + 1)::INT AS stop, tag FROM g WHERE tag <> 'text' GROUP BY l_orderkey, tag, g"""
)
def tag_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of equal flags in the lines of each order, but for those that count as text."""
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("l"))
    tags = F.transform("l", lambda x: F.when(x["l_returnflag"] == "N", "text").otherwise(x["l_returnflag"]))
    return lines.select("l_orderkey", F.explode(segment.tag_spans(tags)).alias("s")).select("l_orderkey", "s.start", "s.stop", "s.tag")


@query(
    """WITH b AS (SELECT conv_id, turn, 'id: ' || turn || chr(10) || 'kind: ' || role || chr(10) || 'source: ' || text || chr(10) || 'target: ' || replace(text, ' ', '_') || CASE WHEN turn % 3 = 0 THEN chr(10) || 'hints: first; ' || role ELSE '' END AS b FROM conversations)
    SELECT conv_id AS group_key, count(*)::INT AS n, 'Into English (' || count(*) || '), with care:' || chr(10) || string_agg(b, chr(10) || chr(10) ORDER BY turn) AS prompt FROM b GROUP BY conv_id"""
)
def rendered_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """One prompt for the turns of each conversation."""
    hints = F.when(F.col("turn") % 3 == 0, F.array(F.lit("first"), F.col("role"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, folder, "conversations").select(F.col("conv_id").alias("group_key"), F.col("turn").alias("seq"), F.col("role").alias("row_type"), F.col("text").alias("source"), F.replace("text", F.lit(" "), F.lit("_")).alias("target"), hints.alias("hints"))
    return prompts.group_prompts(rows, "Into {language} ({count}), {extra}:\n{items}", "English", "with care")


@query(
    """WITH t AS (SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i, n_name FROM nation WHERE n_nationkey IS NOT NULL)
    SELECT n_regionkey AS number, coalesce(string_agg(n_name, ';' ORDER BY i) FILTER (WHERE (n_regionkey, i) IN ((1, 2), (1, 3), (2, 1), (4, 5))), '') AS terms FROM t GROUP BY n_regionkey"""
)
def listed_terms(spark: SparkSession, folder: str) -> DataFrame:
    """The terms that a reviewer lists by segment and place stay."""
    none = F.lit("")
    term = F.struct("n_nationkey", F.struct(F.col("n_name").alias("arabic"), none.alias("english"), none.alias("kind"), none.alias("label"), none.alias("note"), none.alias("surface")).alias("t"))
    rows = table(spark, folder, "nation").groupBy(F.col("n_regionkey").alias("number")).agg(F.transform(F.array_sort(F.collect_list(term)), lambda x: x["t"]).alias("terms"))
    return glossary.keep_listed(rows, ["1.2", "1.3", "2.1", "4.5", "9.9"]).select("number", F.array_join(F.transform("terms", lambda t: t["arabic"]), ";").alias("terms"))


@query(
    """WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS l FROM conversations),
    c AS (SELECT conv_id, turn, l, array_to_string(l, ' ') AS whole, list_max(list_filter(range(0, len(l) + 1), lambda k: k = 0 OR len(array_to_string(l[1:k], ' ')) + 6 <= 50)) AS k FROM w)
    SELECT conv_id, turn, CASE WHEN len(whole) <= 50 THEN whole WHEN k = 0 THEN '[...]' ELSE array_to_string(l[1:k], ' ') || ' [...]' END AS short FROM c"""
)
def shortened(spark: SparkSession, folder: str) -> DataFrame:
    """The beginning of each turn in fifty characters, cut between words."""
    return table(spark, folder, "conversations").select("conv_id", "turn", T.shorten(F.col("text"), 50).alias("short"))


@query(
    """WITH o AS (SELECT conv_id AS document_id, conv_id * 1000 + turn AS seq, CASE (conv_id * 1000 + turn) % 7 WHEN 3 THEN 'empty' WHEN 4 THEN 'copy' END AS skip FROM conversations),
    g AS (SELECT *, CASE WHEN skip IS NULL THEN (row_number() OVER (PARTITION BY document_id, skip IS NULL ORDER BY seq) - 1) // 20 END AS g FROM o),
    f AS (SELECT *, bool_or(seq % 11 = 0) OVER (PARTITION BY document_id, g) AND skip IS NULL AS failed FROM g),
    r AS (SELECT *, CASE WHEN skip IS NOT NULL THEN 'skipped' WHEN failed THEN 'failed' ELSE 'done' END AS status FROM f),
    n AS (SELECT document_id, count(*) FILTER (status = 'done') AS rows_done, count(*) FILTER (status = 'failed') AS rows_failed, count(*) FILTER (status = 'skipped') AS rows_skipped,
        count(*) FILTER (status = 'skipped') + count(*) FILTER (status = 'done' AND seq % 3 = 0) AS findings, count(DISTINCT g) FILTER (status = 'done') AS groups_done, count(DISTINCT g) FILTER (status = 'failed') AS groups_failed FROM r GROUP BY document_id)
    SELECT document_id, findings::BIGINT AS findings, rows_done, rows_failed, rows_skipped, groups_done, groups_failed, CASE WHEN groups_failed = 0 THEN 'done' WHEN groups_done > 0 THEN 'partial' ELSE 'failed' END AS status FROM n"""
)
def audit_job(spark: SparkSession, folder: str) -> DataFrame:
    """Audit jobs over the turns of each conversation from their rows to their end, with a reply that is always the same."""

    def reply(rows: list[dict]) -> str:
        if any(r["seq"] % 11 == 0 for r in rows):
            return "no answer"
        return json.dumps([{"id": r["seq"], "summary": "seen", "errors": [{"code": "X", "location": "here"}] if r["seq"] % 3 == 0 else []} for r in rows])

    key = F.col("conv_id") * 1000 + F.col("turn")
    source = F.concat(F.lit("turn number "), key.cast("string"))
    target = F.when(key % 7 == 3, "").when(key % 7 == 4, source).otherwise(F.concat(F.lit("wende "), key.cast("string")))
    rows = table(spark, folder, "conversations").select(F.col("conv_id").alias("document_id"), key.cast("string").alias("phrase_id"), key.alias("seq"), source.alias("source"), target.alias("target"), F.lit("text").alias("row_type"))
    config = audit.Config(max_attempts=2)
    # A job is stored before it runs, and after: its rows are read again.
    job = written(audit.create_job(rows, config=config), "job")
    ended = audit.finalize(written(audit.run_job(job, reply, config=config), "job-run"))
    return ended.select("document_id", "findings", "rows_done", "rows_failed", "rows_skipped", "groups_done", "groups_failed", "status")
