"""Aggregations: newest rows, verdicts, breakdowns, common values, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .ranks import numbered

# Severities from the highest.
SEVERITIES = ("critical", "major", "moderate", "minor")
RANK = {s: len(SEVERITIES) - i for i, s in enumerate(SEVERITIES)}


def latest(rows: DataFrame, group: list[str], key: str, values: list[str]) -> DataFrame:
    """The row with the largest key of each group; combined before the shuffle, unlike a window."""
    newest = F.max_by(F.struct(*values), key).alias("__v")
    return rows.groupBy(*group).agg(F.max(key).alias(key), newest).select(*group, key, "__v.*")


def rank_of(severity: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in RANK.items() for x in kv)), severity)


def severity_of(rank: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for s, r in RANK.items() for x in (r, s))), rank)


def verdict_of(rank: Column) -> Column:
    """No error is accepted; the two upper severities are rejected; the others go to review."""
    return F.when(rank.isNull(), "accepted").when(rank >= RANK["major"], "rejected").otherwise("review")


def verdicts(findings: DataFrame, group: list[str]) -> DataFrame:
    """errors, max_severity, verdict, sensitive and needs_review of each group.

    Needs ``severity`` (null: no error) and ``sensitive``.
    """
    rank = rank_of(F.col("severity"))
    top = F.max(rank)
    folded = findings.groupBy(*group).agg(F.count(rank).alias("errors"), top.alias("top"), F.coalesce(F.bool_or("sensitive"), F.lit(False)).alias("sensitive"))
    return folded.select(
        *group, "errors", severity_of(F.col("top")).alias("max_severity"), verdict_of(F.col("top")).alias("verdict"), "sensitive",
        (F.coalesce(F.col("top") == RANK["critical"], F.lit(False)) | F.col("sensitive")).alias("needs_review"),
    )


def percent(part: Column, whole: Column, places: int = 1) -> Column:
    """Half to even, as the statistics sheet rounds; 0 of nothing is 0."""
    return F.when(whole > 0, F.bround(100.0 * part / whole, places)).otherwise(0.0)


def breakdown(rows: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """(value, n, pct) for every value of a closed vocabulary, those that never occur too."""
    spark = rows.sparkSession
    counted = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    dimension = spark.createDataFrame([(v,) for v in values], f"{column} string")
    total = F.sum("n").over(Window.partitionBy())  # one row for each value
    shown = dimension.join(counted, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))
    return shown.select(column, "n", percent(F.col("n"), total).alias("pct"))


def most_common(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Values by falling count, ties by the values themselves, with their place; numbered by ranges, however many values there are."""
    counted = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return numbered(counted, [F.desc("n"), *(F.asc(c) for c in columns)])


def gaps(rows: DataFrame, group: str, number: str) -> DataFrame:
    """n, distinct and gaps of each group; a gap is a number that does not follow the one before."""
    before = F.lag(number).over(Window.partitionBy(group).orderBy(number))
    marked = rows.select(group, number, (F.col(number) != before + 1).alias("gap"))
    return marked.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(number).alias("distinct"), F.count_if("gap").alias("gaps"))


def whole_corpus(rows: DataFrame, group: str, number: str, groups: int, total: int) -> DataFrame:
    """One row: does the corpus have so many groups and rows, without a gap?"""
    checked = gaps(rows, group, number)
    return checked.agg(
        F.count(F.lit(1)).alias("groups"), F.sum("n").alias("total"), F.sum("gaps").alias("gaps"), ((F.count(F.lit(1)) == groups) & (F.sum("n") == total) & (F.sum("gaps") == 0) & (F.sum("n") == F.sum("distinct"))).alias("complete")
    )


def common_words(docs: DataFrame, share: float) -> DataFrame:
    """(word, df) of the words in at least ``share`` of the documents; docs has an array column ``words``."""
    n = docs.count()
    words = docs.select(F.explode(F.array_distinct("words")).alias("word")).filter("word <> ''")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= F.lit(share * n))


def histogram(rows: DataFrame, group: list[str], status: str) -> DataFrame:
    """Counts of the statuses that occur."""
    return rows.groupBy(*group, status).agg(F.count(F.lit(1)).alias("n"))


def messages(rows: DataFrame, group: list[str], order: str, message: str, each: int = 300, most: int = 2000, by: str = "؛ ") -> DataFrame:
    """Distinct messages in order, each and all together cut to a length."""
    listed = rows.filter(F.coalesce(message, F.lit("")) != "").groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(order, F.substring(message, 1, each).alias("m")))).alias("l"))
    return listed.select(*group, F.substring(F.array_join(F.array_distinct(F.transform("l", lambda x: x["m"])), by), 1, most).alias("error_message"))


def observed(rows: DataFrame, name: str, counts: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """The statistics of a pass: rows as they are, and counts of conditions that are known once the rows have been read by an action."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.count_if(c).alias(k) for k, c in counts.items())), seen
