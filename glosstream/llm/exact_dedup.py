"""Exact deduplication with a heavy-hitter split.

Misra-Gries counters find the digests that are frequent enough to swamp one
task.  Their exact winners (at most ``counters`` rows) are broadcast and their
copies are settled in the map phase; every other digest takes one ordinary
shuffle, in which no group holds more than ``2 / counters`` of all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

#: Misra-Gries counters; also the bound on broadcast rows.
COUNTERS = 1024


def misra_gries(counters: int):
    """For mapInArrow: each partition's digests reduced to at most ``counters`` (digest, count) rows.

    A digest with f of a partition's n rows gets a count of at least f - n / (counters + 1).
    """

    def summarise(batches):
        kept: dict[bytes, int] = {}
        for batch in batches:
            seen = batch.column(0).drop_null().value_counts()
            for digest, n in zip(seen.field("values").to_pylist(), seen.field("counts").to_pylist()):
                kept[digest] = kept.get(digest, 0) + n
            if len(kept) > counters:
                floor = int(np.partition(np.fromiter(kept.values(), np.int64), -counters - 1)[-counters - 1])
                kept = {d: n - floor for d, n in kept.items() if n > floor}
        yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.binary()), pa.array(list(kept.values()), pa.int64())], names=["digest", "n"])

    return summarise


def heavy_digests(digests: DataFrame, rows: int, counters: int = COUNTERS) -> DataFrame:
    """At most ``counters`` digests, with every one that has over 2 / (counters + 1) of the rows.

    The summed counts of all partitions come to at most ``rows``, so that no
    more than ``counters`` digests can exceed ``rows / (counters + 1)``.
    """
    sketch = digests.select("digest").mapInArrow(misra_gries(counters), "digest binary, n long")
    return sketch.groupBy("digest").agg(F.sum("n").alias("n")).filter(F.col("n") * F.lit(counters + 1) > F.lit(rows)).select("digest")


def text_digest(text: Column) -> Column:
    """SHA-256 of a text; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def exact_dedup(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty.  Of equal texts the
    row with the largest doc_id stays.  Defined cases: of rows that repeat the
    winning doc_id one is kept; a null doc_id sorts below every other, and one
    stays if its whole group has none; an empty table gives an empty table;
    other columns of ``docs`` are ignored, whatever their names.
    """
    # The row's number is stored with its digest, and only then used.
    digests = stored(docs.select(F.col("doc_id"), text_digest(F.col("text")).alias("digest")).withColumn("row", F.monotonically_increasing_id()), "digests")
    rows = digests.count()
    heavy = heavy_digests(digests, rows, counters)
    best = F.max(F.struct("doc_id", "row"))
    size = F.count(F.lit(1))
    # Verified: exact sizes and winners of the candidates, combined before the shuffle.
    winners = stored(digests.join(F.broadcast(heavy), "digest", "left_semi").groupBy("digest").agg(best.alias("best"), size.alias("group_size")), "winners")
    settled = digests.join(F.broadcast(winners), "digest", "inner")
    group = Window.partitionBy("digest")
    rest = digests.join(F.broadcast(winners.select("digest")), "digest", "left_anti").select("digest", "doc_id", "row", best.over(group).alias("best"), size.over(group).alias("group_size"))
    both = settled.select("digest", "doc_id", "row", "best", "group_size").unionByName(rest)
    return both.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """``docs`` without the rows that :func:`exact_dedup` does not keep; all columns stay as they are.

    Of rows that agree in doc_id and text, that with the smallest hash of all columns stays.
    """
    marks = exact_dedup(docs, counters).select("doc_id", "kept", F.unhex("text_sha256").alias("digest"))
    return keep_rows(docs, marks)


def keep_rows(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """One row of ``docs`` for each row of ``marks`` (doc_id, digest, kept) that is kept; ``marks`` has one for each row of docs.

    Rows go by doc_id and text: an id alone may have several texts.
    """
    return keep_rows_counted(docs, marks.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("rows"), F.count_if("kept").alias("stay")))


def keep_rows_counted(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """``docs`` where of each pair (doc_id, digest) with so many ``rows``, ``stay`` (0 or 1) stay; rows of other pairs all stay."""
    each = stored(pairs.filter("stay < rows"), "marks")
    marked = docs.withColumn("__digest", text_digest(F.col("text")))

    def without(df: DataFrame, which: DataFrame, how: str) -> DataFrame:
        which = which.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__same"))
        return df.join(which.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__same")), how)

    left = without(marked, each, "left_anti").drop("__digest")
    repeated = each.filter("stay > 0")
    if repeated.isEmpty():
        return left
    # Rows that repeat as a whole: one of each, combined before the shuffle.
    columns = docs.columns
    hashed = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    one = without(marked, repeated, "left_semi").groupBy("doc_id", "__digest").agg(F.min_by(F.struct(*columns), F.xxhash64(*hashed)).alias("__row"))
    return left.unionByName(one.select(*(F.col("__row").getField(c).alias(c) for c in columns)))
