"""Order statistics over whole tables: dense numbering by ranges, exact quantiles by refined histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Bins of a histogram, and so the most rows that a step of a quantile gives the driver.
BINS = 1024


def numbered(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """rows with their place in the order, from 1, over the whole table.

    A window without partitions sorts the table in one task.  Here ranges of the
    order are sorted in parallel and written; a range's first place is the sum
    of the sizes of those before it.  Only that sum runs in one task, over one
    row for each range.
    """
    low = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    settled = written(ranged, "numbered").withColumns({"__range": F.shiftright("__id", 33), "__at": low})
    sizes = settled.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(F.lit(1)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__range", F.coalesce(before, F.lit(0)).alias("__before"))  # one row for each range
    joined = settled.join(F.broadcast(starts), "__range")
    return joined.withColumn(name, (F.col("__before") + F.col("__at") + 1).cast("long")).select(*rows.columns, name)


def order_statistics(values: DataFrame, column: str, ranks: list[int], bins: int = BINS) -> list[float]:
    """The values (doubles, not null) at some ranks, counted from 0, exactly.

    The range that holds a rank is cut into ``bins`` bins; each comes back with
    its count and its smallest and largest value, and that which holds the rank
    is cut again, until its values are all equal.  A pass is one aggregation
    with map-side sums; no task sees more than a histogram, and the driver gets
    one.  Values that spread evenly take two or three passes.
    """
    v = F.col(column).cast("double")
    return [_at_rank(values.select(v.alias("v")), rank, bins) for rank in ranks]


def _at_rank(values: DataFrame, rank: int, bins: int) -> float:
    low, high = values.agg(F.min("v"), F.max("v")).first()
    while low != high:
        width = high / bins - low / bins  # no overflow
        at = F.least(F.floor((F.col("v") / bins - F.lit(low / bins)) / F.lit(width / bins)), F.lit(bins - 1)) if width > 0 else F.lit(0)
        # Rounding may make neighbours share a bin; two values at the ends never do.
        at = F.when(F.col("v") == low, F.lit(-1)).when(F.col("v") == high, F.lit(bins)).otherwise(at)
        inside = values.filter(F.col("v").between(low, high))
        histogram = inside.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("low").collect()  # bins + 2 rows at most
        for b in histogram:
            if rank < b["n"]:
                low, high = b["low"], b["high"]
                break
            rank -= b["n"]
    return low


def median(values: DataFrame, column: str, bins: int = BINS) -> tuple[int, float | None]:
    """(number of values, median): of an even number the mean of the two in the middle; null values do not count."""
    real = written(values.select(column).filter(F.col(column).isNotNull()), "median")  # read in every pass
    n = real.count()
    if not n:
        return 0, None
    middle = order_statistics(real, column, sorted({(n - 1) // 2, n // 2}), bins)
    return n, (middle[0] + middle[-1]) / 2
