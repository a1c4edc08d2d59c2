"""Approximate nearest neighbours by collision-counting hashing.

Every vector has its value on each of m random lines; a shard of the vectors
keeps one sorted array for each line.  Around a query's value on a line lies a
window; a vector in it collides with the query there.  Virtual rehashing widens
all windows with the radius looked at, and only the widened ends are counted.
Vectors that collide on enough lines are verified by their true cosine.  A
vector within the radius is missed with a probability of at most ``miss``; when
the k-th verified one lies within the radius, or all are verified, the query is
done.  Nothing else ends a search, so that it needs no limit on candidates.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import parts_for

#: Vectors of a shard: about 100 MB of arrays with 96 lines and 64 components.
SHARD_ROWS = 1 << 16
#: Queries of a shard that are counted together.
BLOCK = 64


@dataclass(frozen=True)
class Search:
    """``lines`` projections, windows of ``width`` standard deviations on both sides, first radius and its growth."""

    k: int = 5
    lines: int = 96
    width: float = 1.2
    miss: float = 0.02
    radius: float = 0.25
    growth: float = 1.5
    seed: int = 20240229

    @property
    def threshold(self) -> int:
        """The most collisions that a vector at the radius reaches with a probability of 1 - miss or more."""
        p = math.erf(self.width / math.sqrt(2))
        less = 0.0
        for hits in range(self.lines + 1):
            less += math.comb(self.lines, hits) * p**hits * (1 - p) ** (self.lines - hits)
            if less > self.miss:
                return hits
        return self.lines

    def directions(self, size: int) -> np.ndarray:
        return np.random.default_rng([self.seed, size]).standard_normal((size, self.lines))


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


def _in_range(x: np.ndarray) -> np.ndarray:
    """Vectors whose length leaves the range of doubles are scaled, which leaves their cosines."""
    with np.errstate(over="ignore", under="ignore"):
        size = _lengths(x)
    odd = ~np.isfinite(size) | (size < 1e-150)
    if odd.any():
        x = x.copy()
        x[odd] /= np.abs(x[odd]).max(1, keepdims=True)
    return x


class Shard:
    """The sorted arrays of some vectors of one size."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, search: Search):
        self.ids, self.search, self.x = ids, search, _in_range(vectors)
        self.size = _lengths(self.x)
        self.lines = search.directions(vectors.shape[1])
        at = ((self.x / self.size[:, None]) @ self.lines).T
        self.order = np.argsort(at, 1, kind="stable").astype(np.int32)
        self.at = np.take_along_axis(at, self.order, 1)

    def nearest(self, ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, cosine): the k nearest verified rows of each query, nearest first."""
        out = [self._block(lo, ids[lo : lo + BLOCK], vectors[lo : lo + BLOCK]) for lo in range(0, len(ids), BLOCK)]
        return tuple(np.concatenate([o[i] for o in out]) for i in range(3))

    def _block(self, base: int, ids: np.ndarray, vectors: np.ndarray):
        s, n, m = self.search, len(self.ids), self.search.lines
        q = _in_range(vectors)
        sizes = _lengths(q)
        centre = ((q / sizes[:, None]) @ self.lines).T
        radius = np.full(len(ids), s.radius)
        low = np.stack([np.searchsorted(a, c) for a, c in zip(self.at, centre)])
        high = low.copy()
        counts = np.zeros((len(ids), n), np.int16 if m < 1 << 15 else np.int32)
        verified = np.zeros((len(ids), n), bool)
        rows, scores = [np.zeros(0, np.int64)] * len(ids), [np.zeros(0)] * len(ids)
        active = np.arange(len(ids))
        while len(active):
            wide = s.width * radius[active]
            lo = np.stack([np.searchsorted(a, c - wide) for a, c in zip(self.at, centre[:, active])])
            hi = np.stack([np.searchsorted(a, c + wide, "right") for a, c in zip(self.at, centre[:, active])])
            going = []
            for at, i in enumerate(active.tolist()):
                if radius[i] < 2:
                    ends = [self.order[j, a:b] for j, a, b in zip(range(m), lo[:, at].tolist(), low[:, i].tolist())]
                    ends += [self.order[j, a:b] for j, a, b in zip(range(m), high[:, i].tolist(), hi[:, at].tolist())]
                    counts[i] += np.bincount(np.concatenate(ends), minlength=n).astype(counts.dtype)
                    new = np.flatnonzero((counts[i] >= s.threshold) & ~verified[i])
                else:  # no two directions are further apart
                    new = np.flatnonzero(~verified[i])
                verified[i, new] = True
                new = new[self.ids[new] != ids[i]]
                cosine = (self.x[new] * q[i]).sum(1) / (self.size[new] * sizes[i])
                row, score = np.concatenate([rows[i], new]), np.concatenate([scores[i], cosine])
                best = np.lexsort((self.ids[row], -score))[: s.k]
                rows[i], scores[i] = row[best], score[best]
                far = math.sqrt(max(0.0, 2 - 2 * scores[i][-1])) if len(best) == s.k else math.inf
                if radius[i] < 2 and far > radius[i]:
                    # Once k are known, no radius beyond the k-th is of use.
                    radius[i] = min(radius[i] * s.growth, far * (1 + 1e-9), 2.0)
                    going.append(i)
            low[:, active], high[:, active] = lo, hi
            active = np.array(going, np.int64)
        found = np.repeat(np.arange(len(ids)), [len(r) for r in rows]) + base
        return found, np.concatenate(rows), np.concatenate(scores)


_FOUND = pa.schema([("query_id", pa.int64()), ("version", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _matrices(batch: pa.RecordBatch):
    """(ids, versions, matrix) of a batch's vectors, for each size that occurs."""
    ids, versions = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "version"))
    column = batch.column("vector")
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        mine = np.flatnonzero(sizes == size)
        yield int(size), ids[mine], versions[mine], column.take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _searched(search: Search):
    def run(batches):
        """Rows come by shard, its vectors before the queries: it is built once, and queries pass by in batches."""
        at, waiting, shards = None, {}, {}
        for whole in batches:
            keys = whole.column("shard").to_numpy() * 2 + whole.column("queries").to_numpy(zero_copy_only=False)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if lo == hi:
                    continue
                batch, key = whole.slice(lo, hi - lo), int(keys[lo])
                if at is None or key // 2 != at:
                    at, waiting, shards = key // 2, {}, {}
                for size, ids, versions, x in _matrices(batch):
                    if key % 2 == 0:
                        waiting.setdefault(size, []).append((ids, x))
                        continue
                    if size in waiting:
                        parts = waiting.pop(size)
                        shards[size] = Shard(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), search)
                    if size in shards:
                        query, row, score = shards[size].nearest(ids, x)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(versions[query]), pa.array(shards[size].ids[row]), pa.array(score)], schema=_FOUND)

    return run


def nearest_vectors(vectors: DataFrame, is_query: Column, id_column: str = "vec_id", vector_column: str = "embedding", search: Search = Search(), shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Each query's nearest rows found: query_id, rank, vec_id, score (cosine), by score, then by id.

    Defined cases: vectors that are null, empty, zero or hold null or
    non-finite components take no part, nor do rows without id; rows that
    repeat an id and its vector count once; an id with several vectors is a
    query with each of them, ranked apart, and a candidate with each; a query
    meets vectors of its own size only, and none of its own id; with fewer than
    k others it gets them all; an empty table gives no rows; other columns are
    ignored.
    """
    spark = vectors.sparkSession
    v = F.col(vector_column)
    sound = v.isNotNull() & F.col(id_column).isNotNull() & F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))) & F.exists(v, lambda c: c != 0)
    kept = vectors.withColumn("glosstream_query", F.coalesce(is_query, F.lit(False))).filter(sound)
    kept = kept.select(F.col(id_column).cast("long").alias("id"), v.alias("vector"), "glosstream_query").distinct()
    kept = kept.select("id", F.xxhash64("vector").alias("version"), "vector", "glosstream_query")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = parts_for(vectors.count(), shard_rows, least)
    mine = kept.select(F.pmod(F.xxhash64("id", "version"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("queries"), "id", "version", "vector")
    asks = kept.filter("glosstream_query").select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("queries"), "id", "version", "vector")
    dealt = mine.unionByName(asks).repartition(least if shards <= least else max(least, shards // 4), "shard").sortWithinPartitions("shard", "queries")
    found = dealt.mapInArrow(_searched(search), "query_id long, version long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "version").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= search.k).select("query_id", "rank", "vec_id", "score")


def nearest_to_fiftieths(vectors: DataFrame) -> DataFrame:
    """The five nearest of every row whose vec_id is divisible by 50."""
    return nearest_vectors(vectors, F.col("vec_id") % 50 == 0)
