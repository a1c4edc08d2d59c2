"""Operators on ordered rows: neighbours, runs, carries, chunks and numbering.

All windows of one call share a partitioning, so that a chain of them shuffles
once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(group: list[str], order: list[str]):
    return Window.partitionBy(*group).orderBy(*order)


def neighbours(rows: DataFrame, group: list[str], order: list[str], text: str, kind: str) -> DataFrame:
    """Adds ``before`` (the two previous texts, joined), ``prev_kind`` and ``next_kind``."""
    w = ordered(group, order)
    before = F.array_join(F.collect_list(text).over(w.rowsBetween(-2, -1)), " ")
    return rows.withColumns({"before": before, "prev_kind": F.lag(kind).over(w), "next_kind": F.lead(kind).over(w)})


def last_where(condition: Column, value: Column, group: list[str], order: list[str]) -> Column:
    """The value of the nearest earlier row that meets the condition."""
    w = ordered(group, order).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(F.when(condition, value), ignorenulls=True).over(w)


def carried(condition: Column, value: Column, group: list[str], order: list[str]) -> Column:
    """The value of the last row so far, this one included, that meets the condition."""
    w = ordered(group, order).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(F.when(condition, value), ignorenulls=True).over(w)


def continues(value: Column, group: list[str], order: list[str]) -> Column:
    """1 where the row before has the same value, else 0.  Apply it after rows are dropped."""
    return F.when(F.lag(value).over(ordered(group, order)) == value, 1).otherwise(0)


def runs(rows: DataFrame, group: list[str], order: list[str], value: Column) -> DataFrame:
    """Adds ``run``: maximal stretches of equal values, numbered from 1."""
    w = ordered(group, order)
    new = rows.withColumn("__new", F.when(F.lag(value).over(w) == value, 0).otherwise(1))
    return new.withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def running_number(condition: Column, group: list[str], order: list[str]) -> Column:
    """How many rows so far meet the condition: the number of a running footnote."""
    return F.count_if(condition).over(ordered(group, order).rowsBetween(Window.unboundedPreceding, 0))


def recent_references(reference: Column, group: list[str], order: list[str], window: int = 8, keep: int = 3) -> Column:
    """The last ``keep`` distinct references of the ``window`` rows before, the latest first."""
    seen = F.collect_list(reference).over(ordered(group, order).rowsBetween(-window, -1))
    return F.slice(F.array_distinct(F.reverse(seen)), 1, keep)


def chunks(rows: DataFrame, job: str, order: list[str], size: int) -> DataFrame:
    """Adds ``chunk`` (from 0) and ``group_key`` (j<job>-g<nnnnn>, from 1): rows in order, ``size`` to a group."""
    n = F.row_number().over(ordered([job], order)) - 1
    return rows.withColumn("chunk", F.floor(n / size).cast("long")).withColumn("group_key", F.format_string("j%s-g%05d", F.col(job).cast("string"), F.col("chunk")))


def csv_ids(rows: DataFrame, doc: str, para: str, order: str) -> DataFrame:
    """Adds ``para_no`` (dense), ``ord`` (within the paragraph) and ``csv_id``: tens of the paragraph, then tens of what follows its first row."""
    numbered = rows.withColumn("para_no", F.dense_rank().over(ordered([doc], [para])).cast("long")).withColumn("ord", F.row_number().over(ordered([doc, para], [order])).cast("long"))
    tail = F.when(F.col("ord") == 1, "").otherwise(F.concat(F.lit("_"), ((F.col("ord") - 1) * 10).cast("string")))
    return numbered.withColumn("csv_id", F.concat((F.col("para_no") * 10).cast("string"), tail))


def round_robin(rows: DataFrame, label: str, order: list[str], limit: int) -> DataFrame:
    """The first row of each label, then the second of each, and so on, up to ``limit`` rows."""
    return rows.withColumn("__round", F.row_number().over(ordered([label], order))).orderBy("__round", label).limit(limit).drop("__round")


def first_processed(rows: DataFrame, group: list[str], order: list[str], limit: int, skipped: Column) -> DataFrame:
    """Keeps skipped rows and the first ``limit`` others of each group: the limit counts what is processed, not what is read.

    Adds ``processed``, how many of a group's rows were processed so far.
    """
    w = ordered(group, order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("processed", F.count_if(~skipped).over(w)).filter(skipped | (F.col("processed") <= limit))
