"""Texts of a group that some other text of it does not resemble, without comparing all pairs."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Texts of a group that are compared in one call with as many others.
BLOCK = 64
#: From this length on the matcher leaves frequent letters out, and shared stretches bound nothing.
JUNK_FROM = 200


def unlike(a: str, b: str, least: float) -> bool:
    """Is Ratcliff and Obershelp's ratio below ``least``?  Its upper bounds by lengths and by letters are tried first."""
    matcher = SequenceMatcher(None, a, b)
    return matcher.real_quick_ratio() < least or matcher.quick_ratio() < least or matcher.ratio() < least


def _unlike_udf(least: float):
    @F.pandas_udf("boolean")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else unlike(x, y, least) for x, y in zip(a, b)], dtype="object")

    return run


def _stretch_udf():
    @F.pandas_udf("start int, stop int")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        """Where the longest stretch of letters that a and b share stands in a."""
        found = [SequenceMatcher(None, x, y, autojunk=False).find_longest_match() for x, y in zip(a, b)]
        return pd.DataFrame({"start": [m.a for m in found], "stop": [m.a + m.size for m in found]}, dtype="int32")

    return run


def _blocks_udf(least: float):
    @F.pandas_udf("array<string>")
    def run(mine: pd.Series, others: pd.Series) -> pd.Series:
        """Those of ``mine`` that some of the others do not resemble; texts are (first, s), and the earlier one comes first."""
        out = []
        for texts, rest in zip(mine, others):
            found = []
            for t in texts:
                pairs = ((t, o) if t["first"] < o["first"] else (o, t) for o in rest if o["s"] != t["s"])
                if any(unlike(a["s"], b["s"], least) for a, b in pairs):
                    found.append(t["s"])
            out.append(found)
        return pd.Series(out)

    return run


def unlike_texts(texts: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """(key, s): texts of a key that at least one other of its texts resembles less than ``least``.

    texts(key, s, first) has distinct s in a key; of two texts that with the
    smaller ``first`` is compared with the other.  In turn: lengths that are too
    far from the shortest or longest of the key; one comparison with the key's
    first text; one with the first text that this one does not resemble.  Texts
    that are still open resemble both.  Where all of a key's texts do, and share
    a stretch of the first that is long enough for any two of them, they all
    resemble one another.  Only what is open then meets the others of its key,
    in pairs of blocks, and a text is done with the first that it does not
    resemble.
    """
    differs = _unlike_udf(least)
    n = F.length("s")
    keys = texts.groupBy("key").agg(F.count(F.lit(1)).alias("n_texts"), F.min(n).alias("low"), F.max(n).alias("high"), F.min(F.struct("first", "s")).alias("pivot")).filter("n_texts > 1")
    each = texts.join(keys, "key")
    short, long = 2 * F.col("low") / (n + F.col("low")), 2 * n / (n + F.col("high"))
    by_length = F.coalesce((short < least) | (long < least), F.lit(False))
    other = F.col("s") != F.col("pivot.s")
    seen = each.withColumns({"sure": by_length, "against": F.when(other, F.col("pivot.s"))}).withColumn("away", F.coalesce(differs("against", "s"), F.lit(False)))
    first = written(seen.select("key", "s", "first", "n_texts", "high", "pivot", "sure", "away"), "unlike-first")
    far = first.filter("away").groupBy("key").agg(F.min(F.struct("first", "s")).alias("far"))
    judged = first.join(far, "key", "left").withColumn("flagged", F.col("sure") | F.col("away") | (~(F.col("s") != F.col("pivot.s")) & F.col("far").isNotNull()))
    open_ = judged.withColumn("a", F.when(~F.col("flagged") & F.col("far").isNotNull(), F.when(F.col("far.first") < F.col("first"), F.col("far.s")).otherwise(F.col("s"))))
    second = written(open_.withColumn("b", F.when(F.col("far.first") < F.col("first"), F.col("s")).otherwise(F.col("far.s"))).withColumn("flagged", F.col("flagged") | F.coalesce(differs("a", "b"), F.lit(False))).select("key", "s", "first", "n_texts", "high", "pivot", "flagged"), "unlike-second")
    rest = second.filter("not flagged")
    # Keys none of whose texts is unlike another so far: a stretch that all share may settle them.
    calm = second.groupBy("key").agg(F.bool_or("flagged").alias("any"), F.max("high").alias("longest")).filter(~F.col("any") & (F.col("longest") < JUNK_FROM)).select("key")
    stretches = written(rest.join(calm, "key", "left_semi").select("key", "s", "high", _stretch_udf()(F.col("pivot.s"), F.col("s")).alias("at")), "unlike-stretches")
    common = stretches.groupBy("key").agg(F.max("at.start").alias("start"), F.min("at.stop").alias("stop"))
    kept = F.least("stop", "at.stop") - F.greatest("start", "at.start")
    settled = stretches.join(common, "key").filter(2 * kept / (F.length("s") + F.col("high")) >= least).select("key", "s")
    hard = rest.join(settled, ["key", "s"], "left_anti")
    # Blocks by hash: no key is numbered in one task.
    at = F.pmod(F.xxhash64("s"), F.ceil(F.col("n_texts") / block)).alias("block")
    dealt = lambda df, name: df.select("key", "s", "first", at).groupBy("key", "block").agg(F.collect_list(F.struct("first", "s")).alias(name)).drop("block")
    pairs = dealt(hard, "mine").join(dealt(first.join(hard.select("key").distinct(), "key", "left_semi"), "others"), "key").repartition("key", F.xxhash64("mine"), F.xxhash64("others"))
    late = pairs.select("key", F.explode(_blocks_udf(least)("mine", "others")).alias("s")).distinct()
    return second.filter("flagged").select("key", "s").unionByName(late)
