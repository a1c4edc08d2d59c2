"""Decision lists over ordered units in which a unit may depend on what the one before it became."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .context import ordered

#: A rule: condition, and what a unit becomes.  A null condition does not hold.
Rule = tuple[Column, str]


def first_of(rules: list[Rule], otherwise: str) -> Column:
    """What the first rule says whose condition holds."""
    return reduce(lambda rest, rule: F.when(F.coalesce(rule[0], F.lit(False)), rule[1]).otherwise(rest), reversed(rules), F.lit(otherwise))


def decide(units: DataFrame, group: list[str], order: list[str], plain: Column, behind: Column, mark: str, name: str = "kind") -> DataFrame:
    """units with ``kind``: ``behind`` where the unit before became ``mark``, else ``plain``; a group's first unit is plain.

    Both outcomes are columns of their own row.  Whether a unit becomes the mark
    is then one of four functions of whether the one before did: always, never,
    the same, the opposite.  Units of the first two kinds are fixed points;
    behind one, what holds is its value, turned over once for each opposite
    since.  So the chain is two running windows, and no state is carried by
    Python or held for a group as a whole.
    """
    w = ordered(group, order)
    before, so_far = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    a, b = F.coalesce(plain == mark, F.lit(False)), F.coalesce(behind == mark, F.lit(False))
    first = F.lag(F.lit(1)).over(w).isNull()
    known = units.withColumns({"__plain": plain, "__behind": behind, "__a": a, "__b": b, "__first": first})
    turned = known.withColumn("__turns", F.sum(F.when(F.col("__a") & ~F.col("__b"), 1).otherwise(0)).over(so_far))
    # A first unit is fixed as well: nothing is before it.
    fixed = F.when(F.col("__first") | (F.col("__a") == F.col("__b")), F.struct(F.col("__a").alias("value"), F.col("__turns").alias("turns")))
    held = turned.withColumns({"__fixed": F.last(fixed, ignorenulls=True).over(before), "__before": F.lag("__turns").over(w)})
    odd = (F.col("__before") - F.col("__fixed.turns")) % 2 == 1
    previous = F.coalesce(F.col("__fixed.value") != odd, F.lit(False))
    return held.withColumn(name, F.when(previous, F.col("__behind")).otherwise(F.col("__plain"))).select(*units.columns, name)
