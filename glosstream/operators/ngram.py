"""Candidate generation by shared n-grams: explode, equi-join, count, keep the best.

An engine does not turn a fuzzy join into this shape by itself.  The reference
side is broadcast only while its rows are few; beyond that the join shuffles on
the gram.  Frequent grams of the reference count like all others, but are not
joined on (see :func:`top_hits`).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ngrams
from ..sources.scratch import written

#: A reference table of at most so many rows is broadcast.
BROADCAST_ROWS = 200_000
#: Grams of more than so many items, and of more than this share of all rows, are heavy.
HEAVY_LEAST, HEAVY_SHARE = 10_000, 1000
#: A list of heavy grams that more keys share is not joined on.
OFTEN = 10_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has no more than so many rows; looks at rows + 1 at most."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def postings(items: DataFrame, key: str, n: int, words: str = "words") -> DataFrame:
    """(gram, key), once for each gram and key."""
    return items.select(key, F.explode(F.array_distinct(ngrams(F.col(words), n))).alias("gram"))


def candidates(queries: DataFrame, items: DataFrame, key: str, item: str, n: int, top: int) -> DataFrame:
    """(key, item, hits, rn): the ``top`` items that share most n-grams; ties go to the smaller item.

    Queries and items have an array column ``words``; fewer than n words give no grams.
    """
    return top_hits(postings(queries, key, n), postings(items, item, n), [key], item, top)


def tiered_candidates(queries: DataFrame, items: DataFrame, key: str, item: str, sizes: tuple[int, ...], top: int) -> DataFrame:
    """Candidates by the first n of ``sizes`` that gives any; adds the column ``tier``.

    One pass: grams of all sizes are joined together, and the first size with a
    hit counts, so that neither side is read once for each size.
    """
    tagged = lambda words, n: F.transform(F.array_distinct(ngrams(words, n)), lambda g: F.struct(F.lit(n).alias("tier"), F.concat(F.lit(f"{n} "), g).alias("gram")))
    grams = lambda words: F.explode(F.flatten(F.array(*(tagged(words, n) for n in sizes)))).alias("g")
    index = items.select(item, grams(F.col("words"))).select(item, "g.gram")
    found = top_hits(queries.select(key, grams(F.col("words"))).select(key, "g.tier", "g.gram"), index, [key, "tier"], item, top)
    order = F.array_position(F.array(*map(F.lit, sizes)), F.col("tier"))
    first = F.min(order).over(Window.partitionBy(key))
    return found.withColumn("__first", first).filter(order == F.col("__first")).select(key, item, "hits", "rn", F.col("tier").cast("long").alias("tier"))


def top_hits(grams: DataFrame, index: DataFrame, keys: list[str], item: str, top: int, least: int = HEAVY_LEAST) -> DataFrame:
    """(keys, item, hits, rn): for each key of grams(keys, gram) the ``top`` items of index(item, gram) that share most; ties go to the smaller item.

    Grams that stand in more than ``least`` items and in a thousandth of the
    index's rows (so that they are a thousand at most) are heavy: joining on
    them would meet nearly all items in one task.  They are left out of the join
    and counted by comparing the short lists of heavy grams of a key and an item
    that meet otherwise.  Items that a key meets by heavy grams alone count by
    their list only: of items with the same list the ``top`` smallest can be
    among the best, so that lists are joined and not items.  No gram is dropped.
    """
    sizes = index.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    limit = max(least, sizes["rows"] // HEAVY_SHARE)
    few = sizes["rows"] <= BROADCAST_ROWS
    if sizes["most"] <= limit:
        return _ranked(grams.join(F.broadcast(index) if few else index, "gram").groupBy(*keys, item).agg(F.count(F.lit(1)).alias("hits")), keys, item, top)
    heavy = index.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select("gram")  # HEAVY_SHARE rows at most
    near = F.broadcast if few else lambda df: df
    lists = lambda df, by: df.join(F.broadcast(heavy), "gram", "left_semi").groupBy(*by).agg(F.array_sort(F.collect_set("gram")).alias("heavy"))
    mine, theirs = written(lists(grams, keys), "heavy-lists"), near(lists(index, [item]))
    light = grams.join(F.broadcast(heavy), "gram", "left_anti").join(near(index.join(F.broadcast(heavy), "gram", "left_anti")), "gram").groupBy(*keys, item).agg(F.count(F.lit(1)).alias("hits"))
    both = light.join(mine, keys, "left").join(theirs.withColumnRenamed("heavy", "other"), item, "left")
    met = both.select(*keys, item, (F.col("hits") + F.coalesce(F.size(F.array_intersect("heavy", "other")), F.lit(0))).alias("hits"))
    # Of each list the smallest items; then, for each list of a key, the best of all items by their lists.
    smallest = theirs.withColumn("__r", F.row_number().over(Window.partitionBy("heavy").orderBy(item))).filter(F.col("__r") <= top)
    kinds = smallest.groupBy("heavy").agg(F.array_sort(F.collect_list(item)).alias("items")).withColumn("kind", F.get("items", F.lit(0)))
    # Lists are told apart by their first key or item, so that pairs of lists are pairs of these; all of one list stay in a partition.
    asked = mine.groupBy("heavy").agg(F.min(F.struct(*keys)).alias("asked"), F.count(F.lit(1)).alias("n"))
    parts = int(grams.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = asked.select("asked", "heavy").repartition(parts, "asked").select("asked", F.explode("heavy").alias("gram")).join(near(kinds.select("kind", F.explode("heavy").alias("gram"))), "gram")
    # An item behind ``top`` lists with a smaller one of as many hits is not among the best.
    leading = _ranked(shared.groupBy("asked", "kind").agg(F.count(F.lit(1)).alias("hits")), ["asked"], "kind", top)
    each = leading.drop("rn").join(near(kinds.select("kind", "items")), "kind").select("asked", "hits", F.explode("items").alias(item))
    found = _ranked(each, ["asked"], item, top).groupBy("asked").agg(F.collect_list(F.struct(item, "hits")).alias("best"))
    best = written(asked.join(found, "asked").drop("asked"), "heavy-best")
    # A list of very many keys is broadcast: there are few of these.
    often = F.broadcast(best.filter(F.col("n") > OFTEN))
    rare = mine.join(often, "heavy", "left_anti").join(best.filter(F.col("n") <= OFTEN), "heavy")
    alone = mine.join(often, "heavy").unionByName(rare).select(*keys, F.inline("best"))
    return _ranked(met.unionByName(alone.select(*keys, item, "hits")).groupBy(*keys, item).agg(F.max("hits").alias("hits")), keys, item, top)


def _ranked(counted: DataFrame, keys: list[str], item: str, top: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("hits"), F.asc(item)))
    return counted.withColumn("rn", rank.cast("long")).filter(F.col("rn") <= top).select(*keys, item, "hits", "rn")


def coverage(query: Column, reference: Column) -> Column:
    """The share of distinct query words that the reference has."""
    return F.size(F.array_intersect(query, reference)) / F.size(F.array_distinct(query))


def contains_name(texts: DataFrame, names: DataFrame, key: str, words: str = "words") -> DataFrame:
    """Keys of the texts in which some name occurs as whole consecutive words; names has an array column ``name``."""
    sizes = [r[0] for r in names.select(F.size("name").alias("n")).distinct().filter("n > 0").orderBy("n").collect()]
    joined = names.select(F.array_join("name", " ").alias("gram")).distinct()
    if not sizes:
        return texts.select(key).limit(0)
    grams = texts.select(key, F.explode(F.array_distinct(F.concat(*(ngrams(F.col(words), n) for n in sizes)))).alias("gram"))
    return grams.join(small(joined), "gram", "left_semi").select(key).distinct()
