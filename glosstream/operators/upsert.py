"""Idempotent imports: reconcile two versions of a table, report what changes, never delete."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame, key: list[str], fields: list[str] | None = None) -> DataFrame:
    """Each key with its action (create, update, unchanged, keep) and the fields it then has.

    Rows that only the old table has are kept.  Nulls equal nulls.  Keys are unique on each side.
    """
    fields = fields or [c for c in new.columns if c not in key]
    a = old.select(*(F.col(k).alias(f"__o_{k}") for k in key), F.struct(*fields).alias("__old"), F.lit(True).alias("__in_old"))
    b = new.select(*key, F.struct(*fields).alias("__new"), F.lit(True).alias("__in_new"))
    joined = a.join(b, reduce(Column.__and__, (F.col(f"__o_{k}") == F.col(k) for k in key)), "full")
    action = F.when(F.col("__in_old").isNull(), "create").when(F.col("__in_new").isNull(), "keep").when(F.col("__old").eqNullSafe(F.col("__new")), "unchanged").otherwise("update")
    pick = lambda c: F.when(F.col("__in_new").isNull(), F.col(f"__old.{c}")).otherwise(F.col(f"__new.{c}")).alias(c)
    return joined.select(*(F.coalesce(k, f"__o_{k}").alias(k) for k in key), action.alias("action"), *map(pick, fields))


def counters(diffed: DataFrame) -> DataFrame:
    """How many rows each action has."""
    return diffed.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def apply(diffed: DataFrame) -> DataFrame:
    """The table after the import."""
    return diffed.drop("action")


def latest_wins(rows: DataFrame, key: list[str], version: str) -> DataFrame:
    """One row for each key, that of the highest version: an upsert as union and rank."""
    others = [c for c in rows.columns if c not in (*key, version)]
    return rows.groupBy(*key).agg(F.max(version).alias(version), F.max_by(F.struct(*others), version).alias("__v")).select(*key, version, "__v.*") if others else rows.groupBy(*key).agg(F.max(version).alias(version))


def with_reasons(rows: DataFrame, rules: list[tuple[Column, str]], key: list[str], order: str) -> DataFrame:
    """Adds ``skip_reason``: the first rule that a row breaks, or ``duplicate`` if an earlier valid row has its key."""
    reason = F.lit(None).cast("string")
    for broken, name in reversed(rules):
        reason = F.when(broken, name).otherwise(reason)
    marked = rows.withColumn("__bad", reason)
    place = F.row_number().over(Window.partitionBy(*key, F.col("__bad").isNull()).orderBy(order))
    return marked.withColumn("skip_reason", F.when(F.col("__bad").isNotNull(), F.col("__bad")).when(place > 1, "duplicate")).drop("__bad")


def free_title(titles: DataFrame, title: str) -> DataFrame:
    """One row: the title itself if it is free, else the first free ``title (n)`` from 2."""
    spark = titles.sparkSession
    taken = titles.filter(F.col("title").startswith(title)).select("title").distinct()
    most = taken.count() + 2  # at most so many suffixes can be taken
    tried = spark.range(1, most + 1).select("id", F.when(F.col("id") == 1, title).otherwise(F.concat(F.lit(f"{title} ("), F.col("id").cast("string"), F.lit(")"))).alias("title"))
    return tried.join(taken, "title", "left_anti").agg(F.min_by("title", "id").alias("title"))


def missing_keys(children: DataFrame, parents: DataFrame, child: str, parent: str) -> DataFrame:
    """Children whose parent does not exist: the check that a foreign key would make."""
    return children.join(parents.select(F.col(parent).alias("__p")), F.col(child) == F.col("__p"), "left_anti")


def default_formats(formats: DataFrame) -> DataFrame:
    """One default for each language: the newest of those marked, else the first format."""
    w = Window.partitionBy("language").orderBy(F.desc(F.col("is_default").cast("int")), F.when(F.col("is_default"), -F.col("id")).otherwise(F.col("id")))
    return formats.withColumn("is_default", F.row_number().over(w) == 1)


def languages_without_format(languages: DataFrame, formats: DataFrame) -> DataFrame:
    return languages.join(formats.select("language").distinct(), "language", "left_anti")
