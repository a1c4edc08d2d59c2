"""Connected components of an edge table, without collecting it (alternating large-star and small-star)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import forget, split_join, stored


def _least(pairs: DataFrame, rows: int) -> DataFrame:
    """Each pair (u, v) with m, the least of u and its partners.  Hot nodes are combined before the shuffle, and split."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    return split_join(pairs, least, "u", rows).select("u", "v", F.least("u", "m").alias("m"))


def _stars(batches):
    """The edges (u, v) of each batch as stars: every node with the least one that it reaches within the batch."""
    for batch in batches:
        edge = np.stack([batch.column(i).to_numpy() for i in range(2)])
        nodes, at = np.unique(edge, return_inverse=True)
        a, b = at.reshape(edge.shape)
        least = np.arange(len(nodes))
        while True:
            low = np.minimum(least[a], least[b])
            new = least.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            np.minimum.at(new, least[a], low)
            np.minimum.at(new, least[b], low)
            new = new[new]
            if (new == least).all():
                break
            least = new
        moved = np.flatnonzero(least != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[least[moved]])], names=["u", "v"])


def _settled(edges: DataFrame) -> bool:
    """Are the edges stars already: each u has one v, and no v is a u?"""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e")).select("e.*")
    counts = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return counts.filter("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``, long numbers; root is the smallest node of its component.

    Edges are first drawn together to stars batch by batch.  Rounds of large and
    small stars go on until all are stars.  A round at least halves the distance
    of a node to its root along a path, and the number of edges never grows, so
    that they end: after about the logarithm of the longest path, squared at worst.
    """
    local = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).mapInArrow(_stars, "u long, v long")
    now = stored(local.distinct(), "edges")
    rows = now.count()
    while rows and not _settled(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both, 2 * rows).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = _least(large, rows)
        then, now = now, stored(low.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "edges")
        forget(then)
        rows = now.count()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
