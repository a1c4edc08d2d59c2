"""Line deduplication on levelled sorted runs of line hashes (DataFrame functions only).

A run is a table in sorted buckets of line hashes.  Each batch of documents is
reduced to its distinct lines and merge-anti-joined with the runs: lines that
are in none become a run of their own, so that every line is in one run, and
those that some run has already are noted as seen again.  When a level holds
``fanout`` runs they are compacted into one of the next level.  A line is
dropped from a document when its run and its later sightings come to enough
documents, except in the document that owns it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import bucketed, forget, parts_for, split_join, stored, text_bytes

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\x0c\r"
KEY = ["h1", "h2"]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z in lower case (``lower`` does just that, and faster, where all is ASCII)."""
    bare = F.btrim(line, F.lit(SPACES))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


class LineRuns:
    """Levelled sorted runs and later sightings; rows are (h1, h2, n_docs, owner)."""

    def __init__(self, fanout: int = 4, partitions: int = 12):
        self.fanout, self.partitions, self.levels, self.again, self.batches = fanout, partitions, {}, [], []

    def _run(self, df: DataFrame, what: str = "line-run") -> DataFrame:
        return bucketed(df, what, self.partitions, *KEY)

    def add(self, batch: DataFrame) -> None:
        """Add a batch of (owner, h1, h2), one row for each line of each document; a document is in one batch only."""
        counted = batch.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("owner").alias("owner"))
        # New lines and later sightings are written together, and told apart by a mark.
        marked = self._run(self.marked(counted), "line-batch")
        new, seen = (marked.filter(f).select(*KEY, "n_docs", "owner") for f in ("not known", "known"))
        if self.runs():
            self.again.append(seen)
        self.batches.append(marked)
        self.levels.setdefault(0, []).append(new)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            # Lines are in one run each: compaction only merges.  Runs are read through a filter (of the level below,
            # or one that holds for all rows), which keeps the union off Spark's columnar path: that one claims to be
            # in buckets but is not.
            full = self.levels.pop(level)
            self.levels.setdefault(level + 1, []).append(self._run(reduce(DataFrame.unionByName, full)).filter("n_docs > 0"))
            self.levels.setdefault(level, [])
            if level:
                forget(*full)
            level += 1

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels.values() for run in level]

    def marked(self, batch: DataFrame) -> DataFrame:
        """The batch with ``known``: is the line in some run?  One merge with each run gives the anti-join and its complement."""
        known = F.lit(False)
        for i, run in enumerate(self.runs()):
            batch = batch.join(run.select(*KEY, F.lit(True).alias(f"in{i}")).hint("merge"), KEY, "left")
            known = known | F.col(f"in{i}").isNotNull()
        return batch.select(*KEY, "n_docs", "owner", known.alias("known"))

    def unseen(self, batch: DataFrame) -> DataFrame:
        """Rows of a batch whose line is in no run yet: a merge anti-join with each of them."""
        return reduce(lambda left, run: left.join(run.hint("merge"), KEY, "left_anti"), self.runs(), batch)

    def lines(self, min_docs: int) -> DataFrame:
        """Lines of at least so many documents.  Only those that were seen again are added up with what their run has."""
        runs = reduce(DataFrame.unionByName, self.runs())
        if not self.again:
            return runs.filter(F.col("n_docs") >= min_docs)
        later = stored(reduce(DataFrame.unionByName, self.again).groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("owner").alias("owner")), "line-later")
        first = reduce(DataFrame.unionByName, [run.join(later.select(F.col("h1"), F.col("h2"), F.col("n_docs").alias("more"), F.col("owner").alias("last")), KEY, "left") for run in self.runs()])
        summed = first.select(*KEY, (F.col("n_docs") + F.coalesce("more", F.lit(0))).alias("n_docs"), F.greatest("owner", "last").alias("owner"))
        return summed.filter(F.col("n_docs") >= min_docs)

    def forget(self) -> None:
        forget(*self.runs(), *self.batches)


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 2, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, kept_sha256 (and kept_text on request).

    Keys of at least ``min_chars`` code points in at least ``min_docs``
    documents lose all their lines but those in the document with the largest
    doc_id.  Defined cases: a null or empty text is one empty line; a text that
    loses all lines is empty; a null doc_id never owns a line, and its rows
    lose no line; rows that repeat a doc_id are one document in
    the counts and each lose their own lines; an empty table gives an empty table.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("version"))
    spark = docs.sparkSession
    parts = max(parts_for(text_bytes(docs), 64 << 20), int(spark.conf.get("spark.sql.shuffle.partitions")))
    named = docs.filter(F.col("doc_id").isNotNull())
    keyed = named.select("doc_id", "version", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keyed = keyed.filter(F.length("line") >= min_chars).select("doc_id", "version", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    lines = stored(
        keyed.select("doc_id", "version", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key", F.length("key")).alias("h2"), F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch")),
        "lines", "batch",
    )
    runs = LineRuns(fanout, parts)
    for b in range(batches):
        # A line counts once for each document, and its rows are all in one batch, which is a folder.
        runs.add(lines.filter(F.col("batch") == b).groupBy("doc_id", *KEY).agg(F.min("pos")).select(F.col("doc_id").alias("owner"), *KEY))
    frequent = stored(runs.lines(min_docs).select(*KEY, "owner", F.col("n_docs").alias("n")), "frequent-lines")
    runs.forget()
    found = split_join(lines.select("doc_id", "version", "pos", *KEY), frequent, KEY, lines.count())
    drops = found.filter(F.col("doc_id") != F.col("owner")).groupBy("doc_id", "version").agg(F.collect_set("pos").alias("drop"))
    split = named.join(drops.hint("shuffle_hash"), ["doc_id", "version"], "left").select("doc_id", lines_of(F.col("text")).alias("lines"), "drop")
    nameless = docs.filter(F.col("doc_id").isNull()).select("doc_id", lines_of(F.col("text")).alias("lines"), F.lit(None).cast("array<int>").alias("drop"))
    split = split.unionByName(nameless)
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    kept = F.when(F.col("drop").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(stay, lambda p: F.get(F.col("lines"), p)), "\n"))
    out = split.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept_text"))
    out = out.withColumn("kept_sha256", F.sha2(F.col("kept_text").cast("binary"), 256))
    return out if with_text else out.drop("kept_text")
