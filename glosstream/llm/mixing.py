"""Mixing sources to target weights by Pfair scheduling.

Documents of a source form blocks.  In the ideal mix all sources flow at once,
each at its weight's share of those that are not yet used up.  Block j of a
source is released in the slot in which the ideal reaches j blocks and due when
it reaches j + 1; in each slot the released block with the earliest deadline
goes next, so that at every slot, also after sources have run dry, each source
is less than one block away from the ideal.  Times are worked out from the exact
weights in whole numbers, for all blocks of the plan; blocks are then looked up
in parallel.
"""

from __future__ import annotations

import heapq
from array import array
from bisect import bisect_right
from collections.abc import Mapping
from fractions import Fraction
from itertools import accumulate
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

#: Rows of a block at least; and blocks of the whole plan at most, beyond which blocks grow.
BLOCK_ROWS, PLAN_LIMIT = 64, 2_000_000
PERIOD = 4096
#: Rows of a source that are numbered together, about.
BUCKET_ROWS = 500
#: Buckets that are added up together.
SHELF = 4096
#: The plan is broadcast up to this size, joined by a shuffle beyond it.
BROADCAST_BYTES = 16 << 20
#: Blocks of a source in a row of the plan.
PLAN_BLOCKS = 512
TEMPERATURE = 0.7


def whole_shares(weights: list[float], period: int) -> list[int]:
    """Shares of at least 1 that sum to the period, by largest remainder; too coarse for a plan, which takes weights as they are."""
    total = sum(weights)
    free = period - len(weights)
    exact = [w / total * free for w in weights]
    out = [int(x) for x in exact]
    for i in sorted(range(len(out)), key=lambda i: (out[i] - exact[i], i))[: free - sum(out)]:
        out[i] += 1
    return [k + 1 for k in out]


def edf(blocks: list[int], shares: list[int]) -> list[array]:
    """For each source the slots of its blocks: earliest deadline first among the released.

    The ideal has min(n, a * v) blocks of a source of n blocks and share a at
    virtual time v; block j of it begins when the ideal of all sources comes to
    the sum of min(n, a * v) for v = j / share.
    """
    order = sorted(range(len(blocks)), key=lambda i: Fraction(blocks[i], shares[i]))
    dry = [Fraction(blocks[i], shares[i]) for i in order]
    used = [0, *accumulate(blocks[i] for i in order)]
    flow = [*accumulate((shares[i] for i in reversed(order)), initial=0)][::-1]

    dried = [0] * len(blocks)

    def begins(j: int, i: int) -> int:
        """When the ideal reaches j blocks of source i, times its share; j must not decrease."""
        at = dried[i]
        if at < len(dry) and dry[at].numerator * shares[i] <= j * dry[at].denominator:
            at = dried[i] = bisect_right(dry, Fraction(j, shares[i]), at)
        return used[at] * shares[i] + j * flow[at]

    slots = [array("q") for _ in blocks]
    waiting = [(0, i) for i, n in enumerate(blocks) if n]
    ready: list[tuple[int, int]] = []
    due = [begins(1, i) for i in range(len(blocks))]
    for t in range(sum(blocks)):
        while waiting and waiting[0][0] <= t:
            _, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-due[i] // shares[i]), i))
        deadline, i = heapq.heappop(ready)
        assert t < deadline
        slots[i].append(t)
        if len(slots[i]) < blocks[i]:
            heapq.heappush(waiting, (due[i] // shares[i], i))
            due[i] = begins(len(slots[i]) + 1, i)
    return slots


def edf_period(shares: list[int], period: int) -> list[list[int]]:
    """For each source the slots of its blocks in one period, to which the shares sum."""
    return [list(s) for s in edf(shares, shares)]


def phases(blocks: Mapping[str, int], weights: Mapping[str, float], period: int = PERIOD) -> list[dict]:
    """The plan: for each source the first block and slot, the number of blocks and their slots from there.

    Sources of positive weight are one phase, those without weight another one
    behind it, in equal shares.  Needs only the number of blocks of each source;
    work and memory grow with the number of blocks.  ``period`` has no effect:
    the schedule of exact weights does not repeat.
    """
    names = sorted(s for s, n in blocks.items() if n > 0)
    start, plan = 0, []
    for weighted in (True, False):
        mine = [s for s in names if (weights.get(s, 0.0) > 0) == weighted]
        exact = [Fraction(weights[s]) if weighted else Fraction(1) for s in mine]
        scale = lcm(*(w.denominator for w in exact))
        counts = [blocks[s] for s in mine]
        total = sum(counts)
        for s, n, t in zip(mine, counts, edf(counts, [int(w * scale) for w in exact])):
            plan.append({"source": s, "base": 0, "start": start, "share": n, "period": total, "slots": t})
        start += total
    return plan


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, block_rows: int = BLOCK_ROWS, period: int = PERIOD, temperature: float = TEMPERATURE, plan_limit: int = PLAN_LIMIT) -> DataFrame:
    """Every row of ``docs`` with all its columns and its place in the mix: ``mix_slot``, ``mix_place``, ``mix_block``.

    Ordered by (mix_slot, mix_place), sources alternate by weight; within a
    source the order is that of a hash of doc_id.  ``weights`` names the sources
    (default: number of documents to the power ``temperature``); a source
    without a weight only goes when all others are done.  ``period`` has no
    effect.  A table of more than ``plan_limit`` blocks gets larger blocks, so
    that the plan on the driver is bounded whatever the number of rows; sources
    then keep to less than one of those.  Defined cases: null is
    a source of its own; null doc_id and text are ordinary rows; rows that
    repeat get places of their own; an empty table gives an empty table; columns
    named mix_* are replaced.
    """
    docs = docs.drop("mix_slot", "mix_place", "mix_block")
    spark = docs.sparkSession
    columns = docs.columns
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    order = F.xxhash64(F.lit(11), F.col("doc_id"))
    rows = docs.count()
    block_rows = max(block_rows, -(-rows // plan_limit))
    buckets = max(1, -(-rows // BUCKET_ROWS))
    keyed = docs.withColumn("__key", key).withColumn("__h", order).withColumn("__bucket", F.pmod(F.xxhash64("__h"), F.lit(buckets)))
    # A source's rows are numbered bucket by bucket, so that no source meets in one task.
    sizes = stored(keyed.groupBy("__key", "__bucket").agg(F.count(F.lit(1)).alias("__n")), "mix-sizes")
    # Offsets by shelf, then inside each shelf: the buckets of a source do not meet in one task either.
    shelved = sizes.withColumn("__shelf", F.floor(F.col("__bucket") / SHELF))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sums = shelved.groupBy("__key", "__shelf").agg(F.sum("__n").alias("__m"))
    sums = sums.select("__key", "__shelf", F.coalesce(F.sum("__m").over(before("__key", "__shelf")), F.lit(0)).alias("__start_of_shelf"))
    inside = F.coalesce(F.sum("__n").over(before("__key", "__shelf", "__bucket")), F.lit(0))
    offsets = shelved.withColumn("__inside", inside).join(sums, ["__key", "__shelf"]).select("__key", "__bucket", (F.col("__inside") + F.col("__start_of_shelf")).alias("__offset"))
    totals = {r["__key"]: r["n"] for r in sizes.groupBy("__key").agg(F.sum("__n").alias("n")).collect()}
    if weights is None:
        wanted = {s: n**temperature for s, n in totals.items()}
    else:
        wanted = {"n" if s is None else f"s{s}": w for s, w in weights.items()}
    plan = phases({s: -(-n // block_rows) for s, n in totals.items()}, wanted, period)
    parts = [(p["source"], at // PLAN_BLOCKS, p["start"], p["slots"][at : at + PLAN_BLOCKS]) for p in plan for at in range(0, len(p["slots"]), PLAN_BLOCKS)]
    columns_of = zip(("__key", "__part", "__start", "__slots"), zip(*parts) if parts else [()] * 4, (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())))
    table = spark.createDataFrame(pa.table({name: pa.array(values, kind) for name, values, kind in columns_of}))
    numbered = keyed.withColumn("__r", F.row_number().over(Window.partitionBy("__key", "__bucket").orderBy("__h", "doc_id")) - 1).join(offsets, ["__key", "__bucket"])
    numbered = numbered.withColumn("__rank", F.col("__offset") + F.col("__r")).withColumn("mix_block", F.floor(F.col("__rank") / block_rows)).withColumn("mix_place", (F.col("__rank") % block_rows).cast("int"))
    numbered = numbered.withColumn("__part", F.floor(F.col("mix_block") / PLAN_BLOCKS))
    small = sum(len(p["slots"]) for p in plan) * 8 <= BROADCAST_BYTES
    placed = numbered.join(F.broadcast(table) if small else table, ["__key", "__part"])
    slot = F.col("__start") + F.get("__slots", (F.col("mix_block") % PLAN_BLOCKS).cast("int"))
    return placed.select(*columns, slot.cast("long").alias("mix_slot"), "mix_place", F.col("mix_block").cast("long").alias("mix_block"))


def mixed_order(docs: DataFrame, **how) -> DataFrame:
    """The mix without texts: doc_id, source, mix_slot, mix_place, mix_block."""
    return mix(docs.select("doc_id", "source"), **how)
