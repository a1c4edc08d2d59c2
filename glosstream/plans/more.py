"""Further operators over the driver's tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import audit, context, export, match, parse, segment, upsert
from .relational import paragraphs_of, plain_form, query, table


@query("SELECT 'source' AS facet, source AS value, count(*)::BIGINT AS n FROM documents GROUP BY source UNION ALL SELECT 'lang', lang, count(*)::BIGINT FROM documents GROUP BY lang")
def facets(spark: SparkSession, folder: str) -> DataFrame:
    return export.facets(table(spark, folder, "documents").select("source", "lang"), ["source", "lang"])


@query("SELECT doc_id, source FROM documents WHERE lower(text) LIKE '%license%' OR lower(source) LIKE '%license%'")
def search(spark: SparkSession, folder: str) -> DataFrame:
    return export.search(table(spark, folder, "documents").select("doc_id", "source", "text"), "License", ["text", "source"]).select("doc_id", "source")


@query(
    """WITH u AS (SELECT o_custkey, o_orderkey AS version, o_orderstatus AS status FROM orders UNION ALL SELECT o_custkey, o_orderkey + 1000000, 'X' FROM orders WHERE o_orderkey % 9 = 0)
    SELECT o_custkey, max(version) AS version, arg_max(status, version) AS status FROM u GROUP BY 1"""
)
def latest_wins(spark: SparkSession, folder: str) -> DataFrame:
    old = table(spark, folder, "orders").select("o_custkey", F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("status"))
    new = old.filter("version % 9 = 0").withColumns({"version": F.col("version") + 1000000, "status": F.lit("X")})
    return upsert.latest_wins(old.unionByName(new), ["o_custkey"], "version")


@query(
    """SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER w AS part, (count(*) FILTER (role = 'assistant') OVER w)::BIGINT AS fn
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
)
def carried_section(spark: SparkSession, folder: str) -> DataFrame:
    turns, order = table(spark, folder, "conversations"), (["conv_id"], ["turn"])
    return turns.select("conv_id", "turn", context.carried(F.col("role") == "user", F.col("text"), *order).alias("part"), context.running_number(F.col("role") == "assistant", *order).alias("fn"))


@query("SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events) ORDER BY r, event_type LIMIT 6")
def round_robin(spark: SparkSession, folder: str) -> DataFrame:
    """Six examples, labels in turn: the limit is the feature."""
    return context.round_robin(table(spark, folder, "events").select("event_id", "event_type"), "event_type", ["event_id"], 6)


@query(
    """WITH w AS (SELECT item_id, string_split(lower(text), ' ') AS w FROM benchmark)
    SELECT item_id, array_to_string(list_sort(list_intersect(a, b)), ' ') AS common, len(list_filter(a, lambda x: NOT list_contains(b, x)))::BIGINT AS missing, len(list_distinct(list_concat(a, b)))::BIGINT AS whole
    FROM (SELECT item_id, list_distinct(w[1:len(w) // 2]) AS a, list_distinct(w[len(w) // 2 + 1:]) AS b FROM w)"""
)
def set_operations(spark: SparkSession, folder: str) -> DataFrame:
    """The words of the two halves of each passage."""
    words = F.split(F.lower("text"), " ")
    half = F.floor(F.size(words) / 2).cast("int")
    sets = table(spark, folder, "benchmark").select("item_id", F.array_distinct(F.slice(words, F.lit(1), half)).alias("a"), F.array_distinct(F.slice(words, half + 1, F.size(words))).alias("b"))
    return sets.select("item_id", F.array_join(F.array_sort(F.array_intersect("a", "b")), " ").alias("common"), F.size(F.array_except("a", "b")).cast("long").alias("missing"), F.size(F.array_union("a", "b")).cast("long").alias("whole"))


@query(
    """SELECT event_id, CASE WHEN v IS NULL THEN 70 ELSE greatest(0, least(100, round_even(CASE WHEN v > 0 AND v <= 1 THEN v * 100 ELSE v END, 0)::INTEGER)) END AS confidence
    FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL ELSE (json_extract_string(props, '$.n')::DOUBLE - 20) / CASE WHEN event_id % 2 = 0 THEN 100 ELSE 1 END END AS v FROM events)"""
)
def confidence_values(spark: SparkSession, folder: str) -> DataFrame:
    n = (F.get_json_object("props", "$.n").cast("double") - 20) / F.when(F.col("event_id") % 2 == 0, 100).otherwise(1)
    text = F.when(F.col("event_id") % 4 == 0, "none").otherwise(F.concat(n.cast("string"), F.lit(" %")))
    return table(spark, folder, "events").select("event_id", parse.confidence_column(text).alias("confidence"))


@query("SELECT strftime(o_orderdate, '%d/%m/%Y') AS day, year(o_orderdate)::BIGINT AS year, month(o_orderdate)::BIGINT AS month, count(*)::BIGINT AS n, max(date_diff('day', o_orderdate::DATE, DATE '2000-01-01'))::BIGINT AS age FROM orders GROUP BY 1, 2, 3")
def date_buckets(spark: SparkSession, folder: str) -> DataFrame:
    d = F.col("o_orderdate")
    keyed = table(spark, folder, "orders").select(dates.local_day(d).alias("day"), F.year(d).cast("long").alias("year"), F.month(d).cast("long").alias("month"), F.floor(dates.age_seconds(d.cast("date"), F.lit("2000-01-01")) / 86400).alias("age"))
    return keyed.groupBy("day", "year", "month").agg(F.count(F.lit(1)).alias("n"), F.max("age").alias("age"))


@query(
    """WITH u AS (SELECT l_orderkey AS group_key, min(CASE WHEN l_returnflag = 'R' THEN l_linenumber END) AS won, max(l_linenumber) AS last FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1)
    SELECT group_key, coalesce(won, last)::BIGINT AS attempts, CASE WHEN won IS NOT NULL THEN 'done' WHEN last >= 3 THEN 'failed' ELSE 'pending' END AS status FROM u"""
)
def retry_bookkeeping(spark: SparkSession, folder: str) -> DataFrame:
    calls = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("group_key"), F.col("l_linenumber").alias("attempt"), (F.col("l_returnflag") == "R").alias("ok"))
    return audit.retries(calls, 3).withColumn("attempts", F.col("attempts").cast("long"))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def exists_filter(spark: SparkSession, folder: str) -> DataFrame:
    flagged = table(spark, folder, "orders").filter("o_orderstatus = 'P'").select("o_custkey")
    return table(spark, folder, "customer").select("c_custkey", "c_name").join(flagged, F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query("SELECT o_custkey, array_to_string(list_sort(list_distinct(list(o_orderpriority))), '; ')[1:40] AS priorities, string_agg(DISTINCT o_orderstatus, '' ORDER BY o_orderstatus) AS statuses FROM orders GROUP BY o_custkey")
def message_fold(spark: SparkSession, folder: str) -> DataFrame:
    folded = table(spark, folder, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("p"), F.array_sort(F.collect_set("o_orderstatus")).alias("s"))
    return folded.select("o_custkey", F.substring(F.array_join("p", "; "), 1, 40).alias("priorities"), F.array_join("s", "").alias("statuses"))


@query(
    """SELECT conv_id, turn, processed FROM (SELECT conv_id, turn, role, (count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))::BIGINT AS processed FROM conversations)
    WHERE role <> 'user' OR processed <= 2"""
)
def processed_limit(spark: SparkSession, folder: str) -> DataFrame:
    """A limit on what is processed in each group, not on what is read."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role")
    return context.first_processed(turns, ["conv_id"], ["turn"], 2, F.col("role") != "user").drop("role")


@query(None)
def sentence_units(spark: SparkSession, folder: str) -> DataFrame:
    """Units of every paragraph; the splitter has no SQL, its invariant is tested."""
    paras = paragraphs_of(table(spark, folder, "documents")).select("doc_id", "para", "text", F.lit(False).alias("heading"))
    return segment.units(paras)


@query(None)
def fuzzy_match(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark passages in the paragraphs: candidates by n-grams, verified by similarity and coverage."""
    paras = paragraphs_of(table(spark, folder, "documents")).select((F.col("doc_id") * 1_000_000_000 + F.col("para")).alias("key"), plain_form(F.col("text")).alias("text"), F.lit(False).alias("short"), F.lit("").alias("prefer"))
    corpus = table(spark, folder, "benchmark").select(F.col("item_id").alias("ref_id"), plain_form(F.col("text")).alias("text"), F.lit("").alias("surah"))
    return match.match_texts(paras, corpus, every_record=False, least=match.FUZZY_ANCHOR).select("key", "ref_id", F.round("score", 6).alias("score"))
