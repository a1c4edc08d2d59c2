"""Exact n-gram Jaccard self-join in a metric space.

Documents are sets of word shingles under the Jaccard distance, which obeys the
triangle inequality.  Documents with equal sets are one point.  Then:

1. Points that cannot have a neighbour are set aside.  Of two linked points, the
   shingles with the smallest hashes are mostly common; a point too few of whose
   smallest shingles occur in any other point is alone.
2. Regions: the distance to the empty set orders points into rings by size; each
   ring also takes the points of the next (the window in which neighbours can
   lie).  Within a ring, points that agree on a whole cell of the shingle
   universe meet; enough cells are laid out that linked points agree on one.
   Regions that touch in a possible link are joined together.
3. Inside a region, pivots create Voronoi cells.  A point at distance d from its
   own pivot is also copied to each cell whose pivot is no farther than
   d + 2 * radius: by the triangle inequality no neighbour is missed.  Cells are
   split again with pivots of their own until they are small, and joined exactly.
   Regions too large for a task are split in the same way across the cluster.

Links are kept as spanning trees; components come from those.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .exact_dedup import keep_rows_counted, text_digest
from .exchange import packed, unpacked
from .hashing import gram_starts, grams, mix, slices, text_buffer, Words
from .storage import forget, parts_for, split_join, stored, text_bytes

#: Bytes of text whose keys one shard holds.
SHARD_TEXT = 12 << 20
#: Shingles that one task joins at a time (8 bytes each).
REGION_SHINGLES = 3_000_000
LEAF = 48
CLASSES = 64
#: Keys that are packed at a time: with one owner for each they take 100 bytes each.
PACKED_KEYS = 1 << 18
#: Bytes of cell keys, with their heads, that one shard holds; a shingle of a candidate sends up to so many where every key has a shard of its own.
CELL_BYTES, CELL_SHINGLE = 16 << 20, 64
#: Candidates whose ids are broadcast at most; beyond it they are shuffled.
BROADCAST_IDS = 1_000_000
_C1, _C2, _C3, _C4 = (np.uint64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89))


@dataclass(frozen=True)
class Rule:
    """Sets of k-word shingles link when den * |x & y| >= num * |x | y|."""

    k: int = 3
    num: int = 90
    den: int = 100

    def smallest(self, n):
        """The fewest shingles of a partner of a set of n."""
        return -(-self.num * n // self.den)

    def absent(self, n):
        """The most shingles of a set of n that a partner lacks."""
        return n - self.smallest(n)

    def overlap(self, n):
        """The shingles beyond absent(n) that are looked at: as many must be common."""
        return np.maximum(1, n // 5)

    def differ(self, both):
        """The most shingles that are in one of two linked sets only, with so many in the two together."""
        return both - 2 * -(-self.num * both // (self.num + self.den))

    def differ_up_to(self, both):
        """The most with no more than so many in the two together: ``differ`` grows only from one even or odd number to the next."""
        return np.maximum(self.differ(both), self.differ(both - 1))

    @property
    def radius(self) -> float:
        return 1 - self.num / self.den


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and their n + 1 bounds."""
    words = Words(*text_buffer(column), True)
    counts, n = words.counts, len(column)
    of = words.text_of()
    starts = gram_starts(words, k)
    hashes, owner = grams(words.hash, k)[starts], of[starts]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        whole = np.array([grams(words.hash[words.first[i] : words.first[i + 1]], int(counts[i]))[0] for i in short], np.uint64)
        hashes, owner = np.concatenate([hashes, whole]), np.concatenate([owner, short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(n + 1))


def fingerprints(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set; 0 for the empty set."""
    n = np.diff(first)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes ^ _C1), out=total[1:])
    return np.where(n > 0, mix(total[first[1:]] - total[first[:-1]] + n.astype(np.uint64)), np.uint64(0))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x, np.uint64).view(np.int64))


def _points(k: int):
    """n_shingles and point (a digest of the set) of every row, behind its columns other than the text, which is the second."""

    def run(batches):
        for batch in batches:
            for at, n in slices(batch.column(1)):
                part = batch.slice(at, n)
                hashes, first = shingle_sets(part.column(1), k)
                own = [i for i in range(part.num_columns) if i != 1]
                columns = [*(part.column(i) for i in own), pa.array(np.diff(first)), _signed(fingerprints(hashes, first))]
                yield pa.RecordBatch.from_arrays(columns, names=[*(part.schema.names[i] for i in own), "n_shingles", "point"])

    return run


def _pack(shard: np.ndarray, owner: np.ndarray, keys: np.ndarray, heads: np.ndarray, shards: int):
    """Rows (shard, blob): the heads of the owners that have keys there, how many each has, and the keys.

    owner must not decrease.  heads has one row of bytes for each owner.
    """
    order = np.argsort(shard.astype(np.uint32), kind="stable")
    shard, owner, keys = shard[order], owner[order], keys[order]
    bounds = np.searchsorted(shard, np.arange(shards + 1))
    ids, blobs = [], []
    for s in np.flatnonzero(np.diff(bounds)):
        lo, hi = bounds[s], bounds[s + 1]
        who, n = np.unique(owner[lo:hi], return_counts=True)
        ids.append(int(s))
        blobs.append(np.array([len(who)], np.uint32).tobytes() + n.astype(np.uint32).tobytes() + heads[who].tobytes() + keys[lo:hi].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], names=["shard", "blob"])


def _unpack(blobs: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, the index of the owner of each, and the owners' heads."""
    keys, counts, heads = [], [], []
    for blob in blobs:
        raw = blob.as_buffer()
        n = int(np.frombuffer(raw, np.uint32, 1)[0])
        counts.append(np.frombuffer(raw, np.uint32, n, 4))
        heads.append(np.frombuffer(raw, np.uint8, n * width, 4 + 4 * n).reshape(n, width))
        at = 4 + n * (4 + width)
        keys.append(np.frombuffer(bytes(memoryview(raw)[at:]), np.uint64))
    counts = np.concatenate(counts)
    return np.concatenate(keys), np.repeat(np.arange(len(counts)), counts), np.concatenate(heads)


def _smallest_keys(rule: Rule, shards: int):
    """Of each point the absent + overlap smallest shingles, by shard.

    Slices are packed together until they have PACKED_KEYS keys: the more shards
    there are, the more often a point's head is sent.
    """

    def pack(sets: list[tuple], fps: list[np.ndarray], least: list[np.ndarray]):
        fps, least = np.concatenate(fps), np.concatenate(least)
        _, where = np.unique(fps, return_index=True)
        keys, take = np.concatenate([s[0] for s in sets]), np.concatenate([s[1] for s in sets])
        mine = np.zeros(len(take), bool)  # copies among them add nothing
        mine[where] = True
        keys, owner = keys[np.repeat(mine, take)], np.repeat(np.arange(len(take)), np.where(mine, take, 0))
        return _pack((keys % np.uint64(shards)).astype(np.int64), owner, keys, np.stack([fps, least], 1).view(np.uint8), shards)

    def run(batches):
        for batch in batches:
            sets, fps, least, held = [], [], [], 0
            for at, n in slices(batch.column(0)):
                hashes, first = shingle_sets(batch.column(0).slice(at, n), rule.k)
                size = np.diff(first)
                take = np.minimum(size, rule.absent(size) + rule.overlap(size))
                rank = np.arange(len(hashes)) - np.repeat(first[:-1], size)
                sets.append((hashes[rank < np.repeat(take, size)], take))
                fps.append(fingerprints(hashes, first))
                least.append(rule.overlap(rule.smallest(size)).astype(np.uint64))
                held += len(sets[-1][0])
                if held >= PACKED_KEYS:
                    yield pack(sets, fps, least)
                    sets, fps, least, held = [], [], [], 0
            if sets:
                yield pack(sets, fps, least)

    return run


def _shared_keys(buckets: int):
    """By bucket of points: how many of a point's keys here another point has too, and how many it needs in all."""

    def run(table: pa.Table) -> pa.Table:
        keys, owner, heads = _unpack(table["blob"], 16)
        heads = np.ascontiguousarray(heads).view(np.uint64)
        fps = heads[owner, 0]
        order = np.lexsort((fps, keys))
        keys, fps, owner = keys[order], fps[order], owner[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (fps[1:] != fps[:-1])
        keys, fps, owner = keys[new], fps[new], owner[new]
        same = keys[1:] == keys[:-1]
        shared = np.zeros(len(keys), bool)
        shared[1:] |= same
        shared[:-1] |= same
        fp, at, n = np.unique(fps[shared], return_index=True, return_counts=True)
        return packed(0, (fp % np.uint64(buckets)).astype(np.int64), [fp, n.astype(np.uint32), heads[owner[shared][at], 1].astype(np.uint32)], buckets)[0].select(["shard", "blob"])

    return run


def _enough(table: pa.Table) -> pa.Table:
    """Points with as many shared keys as a neighbour would share."""
    parts = [unpacked(b.as_py(), [np.uint64, np.uint32, np.uint32]) for b in table["blob"]]
    fps, n, least = (np.concatenate([p[i] for p in parts]) for i in range(3))
    fp, at, inverse = np.unique(fps, return_index=True, return_inverse=True)
    return pa.table({"fp": _signed(fp[np.bincount(inverse, n) >= least[at]])})


def _set_rows(k: int):
    """fp, n and the set itself of each text."""

    def run(batches):
        for batch in batches:
            for at, n in slices(batch.column(0)):
                hashes, first = shingle_sets(batch.column(0).slice(at, n), k)
                fp = fingerprints(hashes, first)
                raw = [hashes[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([_signed(fp), pa.array(np.diff(first)), pa.array(raw, pa.binary())], names=["fp", "n", "items"])

    return run


def rings(rule: Rule, most: int) -> np.ndarray:
    """First sizes of the rings: a partner lies in the same ring or the next."""
    out = [1]
    while out[-1] <= most:
        out.append(out[-1] * rule.den // rule.num + 1)
    out.append(out[-1] * rule.den // rule.num + 1)
    return np.array(out)


def signatures(items: np.ndarray, ring: int, bounds: np.ndarray, rule: Rule) -> np.ndarray:
    """Digests of the cells of one ring pair that a point may share whole with a partner.

    Linked sets of the rings differ in at most T shingles, so of m > T cells at
    least m - T agree.  The smallest cells may be left out as long as they are
    fewer than that.
    """
    differ = int(rule.differ_up_to(2 * (bounds[ring + 2] - 1)))
    cells = differ + 1 + differ // 2
    salt = mix(np.array([ring], np.uint64) + _C3)[0]
    cell = (mix(items ^ salt) % np.uint64(cells)).astype(np.int64)
    size = np.bincount(cell, minlength=cells)
    digest = np.zeros(cells, np.uint64)
    np.add.at(digest, cell, mix(items ^ _C4))
    smaller = np.concatenate([[0], np.cumsum(np.bincount(np.minimum(size, 8), minlength=9))])  # cells of fewer than q
    least = int(np.flatnonzero(smaller[:9] <= cells - differ - 1)[-1])
    use = np.flatnonzero(size >= least)
    return mix(digest[use] + mix(use.astype(np.uint64) + salt))


def _sketch(items: np.ndarray) -> np.ndarray:
    """Shingles by class; the sum of differences never exceeds the number of differing shingles."""
    return np.minimum(np.bincount((mix(items ^ _C2) % np.uint64(CLASSES)).astype(np.int64), minlength=CLASSES), 255).astype(np.uint8)


def _cell_keys(rule: Rule, bounds: np.ndarray, shards: int):
    """The cells of each point, by shard; some points are packed at a time, as a head goes to each shard that has a key of its point."""

    def pack(heads: list[bytes], keys: list[np.ndarray]):
        owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        keys = np.concatenate(keys)
        return _pack((keys % np.uint64(shards)).astype(np.int64), owner, keys, np.frombuffer(b"".join(heads), np.uint8).reshape(-1, 12 + CLASSES), shards)

    def run(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            sizes = batch.column(1).to_numpy(zero_copy_only=False)
            heads, keys, held = [], [], 0
            for i, raw in enumerate(batch.column(2)):
                items = np.frombuffer(raw.as_buffer(), np.uint64)
                if not len(items):
                    continue
                ring = int(np.searchsorted(bounds, sizes[i], "right")) - 1
                heads.append(fps[i].tobytes() + np.uint32(sizes[i]).tobytes() + _sketch(items).tobytes())
                keys.append(np.concatenate([signatures(items, r, bounds, rule) for r in (ring - 1, ring) if r >= 0]))
                held += len(keys[-1])
                if held >= PACKED_KEYS:
                    yield pack(heads, keys)
                    heads, keys, held = [], [], 0
            if held:
                yield pack(heads, keys)

    return run


class Forest:
    """Union-find that keeps the edges it needed."""

    def __init__(self, n: int):
        self.up, self.edges = list(range(n)), []

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def link(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.edges.append((i, j))


def _meet(rule: Rule):
    """Possible links of points that agree on a cell, as a spanning forest of a shard: (a, b)."""

    def run(table: pa.Table) -> pa.Table:
        keys, owner, heads = _unpack(table["blob"], 12 + CLASSES)
        fp = np.ascontiguousarray(heads[:, :8]).view(np.uint64).ravel()
        _, point, index = np.unique(fp, return_index=True, return_inverse=True)
        fp, size, sketch = fp[point], np.ascontiguousarray(heads[point, 8:12]).view(np.uint32).ravel().astype(np.int64), heads[point, 12:].astype(np.int16)
        owner = index[owner]
        order = np.lexsort((owner, keys))
        keys, owner = keys[order], owner[order]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        ends = np.append(at[1:], len(keys))
        forest = Forest(len(fp))
        for lo, hi in zip(at[ends - at > 1], ends[ends - at > 1]):
            rest = np.unique(owner[lo:hi])
            while len(rest) > 1:
                # Grow one tree: all that may link with its front, until nothing more does.
                front, rest = [rest[0]], rest[1:]
                while front and len(rest):
                    x = front.pop()
                    both = size[rest] + size[x]
                    near = (size[rest] >= rule.smallest(size[x])) & (size[x] >= rule.smallest(size[rest])) & (np.abs(sketch[rest] - sketch[x]).sum(1) <= rule.differ(both))
                    for y in rest[near]:
                        forest.link(int(x), int(y))
                    front += list(rest[near])
                    rest = rest[~near]
        edges = np.array(forest.edges, np.int64).reshape(-1, 2)
        return pa.table({"a": _signed(fp[edges[:, 0]]), "b": _signed(fp[edges[:, 1]])})

    return run


class Region:
    """Points of one region with the exact join by Voronoi cells."""

    def __init__(self, sets: list[np.ndarray], rule: Rule, seed: int = 1):
        self.rule = rule
        self.size = np.array([len(s) for s in sets], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        self.items, self.of_item = np.unique(np.concatenate(sets), return_inverse=True)
        self.forest = Forest(len(sets))
        self.mark = np.zeros(len(self.items), bool)
        self.rng = np.random.default_rng(seed)

    def common(self, x: int, others: np.ndarray) -> np.ndarray:
        """|x & y| for each y."""
        mine = self.of_item[self.first[x] : self.first[x + 1]]
        self.mark[mine] = True
        size = self.size[others]
        bounds = np.cumsum(size) - size
        flat = self.of_item[np.repeat(self.first[others] - bounds, size) + np.arange(size.sum())]
        out = np.add.reduceat(self.mark[flat].astype(np.int64), bounds)
        self.mark[mine] = False
        return out

    def join(self) -> list[tuple[int, int]]:
        todo = [np.arange(len(self.size))]
        while todo:
            cell = todo.pop()
            if len(cell) <= LEAF:
                self.leaf(cell)
            else:
                todo += self.split(cell)
        return self.forest.edges

    def leaf(self, cell: np.ndarray) -> None:
        """Each point against those after it that are not linked with it already."""
        rule = self.rule
        for i, x in enumerate(cell[:-1]):
            root = self.forest.root(int(x))
            rest = np.array([y for y in cell[i + 1 :] if self.forest.root(int(y)) != root], np.int64)
            rest = rest[(self.size[rest] >= rule.smallest(self.size[x])) & (self.size[x] >= rule.smallest(self.size[rest]))]
            if len(rest):
                shared = self.common(int(x), rest)
                for y in rest[rule.den * shared >= rule.num * (self.size[rest] + self.size[x] - shared)]:
                    self.forest.link(int(x), int(y))

    def split(self, cell: np.ndarray) -> list[np.ndarray]:
        """Voronoi cells of random pivots with their windows; a cell that pivots do not divide is joined as it is."""
        pivots = self.rng.choice(cell, min(len(cell), 2 + int(np.sqrt(len(cell)) / 2)), replace=False)
        far = np.empty((len(cell), len(pivots)))
        rule = self.rule
        for j, p in enumerate(pivots):
            shared = self.common(int(p), cell)
            union = self.size[cell] + self.size[p] - shared
            far[:, j] = 1 - shared / union
            for y in cell[rule.den * shared >= rule.num * union]:
                self.forest.link(int(p), int(y))
        own = far.min(1)
        home = far.argmin(1)
        out = []
        for j in range(len(pivots)):
            inside = far[:, j] <= own + 2 * rule.radius + 1e-9
            if not (home == j).any():
                continue
            part = cell[inside]
            if len(np.unique([self.forest.root(int(x)) for x in part])) == 1:
                continue  # all linked already
            if len(part) > 0.7 * len(cell):
                self.leaf(part[np.argsort(far[inside, j], kind="stable")])
            else:
                out.append(part)
        return out


def _join_regions(rule: Rule):
    """Links of the points of each region in the table, as spanning trees."""

    def run(table: pa.Table) -> pa.Table:
        fp = table["fp"].to_numpy().view(np.uint64)
        region = table["region"].to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["items"]]
        order = np.lexsort((fp, region))
        bounds = np.flatnonzero(np.concatenate([[True], region[order][1:] != region[order][:-1], [True]]))
        a, b = [], []
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            _, once = np.unique(fp[order[lo:hi]], return_index=True)
            mine = order[lo:hi][once]
            if len(mine) > 1:
                for i, j in Region([sets[m] for m in mine], rule).join():
                    a.append(fp[mine[i]])
                    b.append(fp[mine[j]])
        return pa.table({"a": _signed(np.array(a, np.uint64)), "b": _signed(np.array(b, np.uint64))})

    return run


def _far_apart(rule: Rule, pivots: dict[int, list[np.ndarray]]):
    """Copies of each point of a large region to the cells where a neighbour may have its home, some points at a time."""

    def rows(fps: list, regions: list, items: list, sizes: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array(regions, pa.int64()), pa.array(items, pa.binary()), pa.array(sizes, pa.int64())], names=["fp", "region", "items", "n"])

    def run(batches):
        for batch in batches:
            fps, regions, items, out, held = [], [], [], [], 0
            for fp, region, raw in zip(batch.column(0), batch.column(1), batch.column(2)):
                mine, whole = np.frombuffer(raw.as_buffer(), np.uint64), raw.as_py()
                far = []
                for p in pivots[region.as_py()]:
                    at = np.minimum(np.searchsorted(p, mine), len(p) - 1)
                    shared = int((p[at] == mine).sum())
                    far.append(1 - shared / (len(p) + len(mine) - shared))
                far = np.array(far)
                for j in np.flatnonzero(far <= far.min() + 2 * rule.radius + 1e-9):
                    fps.append(fp.as_py())
                    items.append(whole)
                    regions.append(int(mix(np.array([region.as_py()], np.int64).view(np.uint64) + np.uint64(j + 1)).view(np.int64)[0]))
                    out.append(len(mine))
                if (held := held + len(mine) * len(far)) >= PACKED_KEYS:
                    yield rows(fps, regions, items, out)
                    fps, regions, items, out, held = [], [], [], [], 0
            if out:
                yield rows(fps, regions, items, out)

    return run


def _block_pairs(large: DataFrame, blocks: int) -> DataFrame:
    """Each point of block i in the pairs (i, j) and (j, i): every two points meet, and no task holds more than two blocks."""
    block = F.pmod(F.xxhash64("fp"), F.lit(blocks))
    paired = large.withColumn("__i", block).withColumn("__j", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return paired.select("fp", F.xxhash64("region", F.least("__i", "__j"), F.greatest("__i", "__j")).alias("region"), "items", "n")


def _regions_to_links(placed: DataFrame, rule: Rule) -> DataFrame:
    """Join all regions of (fp, region, items, n); those beyond REGION_SHINGLES are split across the cluster first."""
    spark = placed.sparkSession
    kinds = "fp long, region long, items binary, n long"
    sizes = placed.groupBy("region").agg(F.sum("n").alias("total"))
    small = placed
    for level in range(3):
        large = stored(sizes.filter(F.col("total") > REGION_SHINGLES), "large-regions")
        n_large, most, whole = large.agg(F.count(F.lit(1)), F.max("total"), F.sum("total")).first()
        if not n_large:
            break
        keep = small.join(large.select("region"), "region", "left_anti").select("fp", "region", "items", "n")
        split = small.join(large.select("region"), "region", "left_semi").select("fp", "region", "items", "n")
        blocks, cells = int(-(-2 * most // REGION_SHINGLES)), None
        if level < 2 and n_large <= 64:
            # Pivots: the points of a region with the smallest hashes, in proportion to its size (at most 32).
            found = {}
            for r in large.collect():
                rows = split.filter(F.col("region") == r["region"]).orderBy(F.xxhash64("fp")).limit(int(min(32, 2 + 2 * r["total"] // REGION_SHINGLES))).select("items").collect()
                found[r["region"]] = [np.frombuffer(bytes(x["items"]), np.uint64) for x in rows]
            cells = split.mapInArrow(_far_apart(rule, found), kinds)
            # Points that are near to all pivots go to all cells, which pivots do not make smaller: pairs of blocks copy them less often.
            if cells.agg(F.sum("n")).first()[0] > blocks * whole:
                cells = None
        if cells is None:
            small = keep.unionByName(_block_pairs(split, blocks))
            break
        small = stored(keep.unionByName(cells), "split-regions")
        sizes = small.groupBy("region").agg(F.sum("n").alias("total"))
    total = small.agg(F.sum("n")).first()[0] or 0
    bins = max(parts_for(int(total), REGION_SHINGLES // 2), int(spark.conf.get("spark.sql.shuffle.partitions")))
    binned = small.select(F.pmod(F.xxhash64("region"), F.lit(bins)).alias("bin"), "fp", "region", "items")
    return binned.groupBy("bin").applyInArrow(_join_regions(rule), "a long, b long")


def linked_points(docs: DataFrame, rule: Rule, digests: bool = False) -> tuple[DataFrame, DataFrame]:
    """(points, roots): each row's doc_id, n_shingles and point; and for points with links their component's root.

    With ``digests`` points have the texts' digests too, as ``digest``.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", *([text_digest(F.col("text")).alias("digest")] if digests else []))
    docs = docs.select("doc_id", "text")
    kind = dict(docs.dtypes)["doc_id"]
    shards = max(parts_for(text_bytes(docs), SHARD_TEXT), int(spark.conf.get("spark.sql.shuffle.partitions")))
    points = stored(rows.mapInArrow(_points(rule.k), f"doc_id {kind}, {'digest binary, ' if digests else ''}n_shingles long, point long"), "points")
    classes = points.filter("n_shingles > 0").groupBy("point").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("size"))
    shared = docs.select("text").mapInArrow(_smallest_keys(rule, shards), "shard int, blob binary").groupBy("shard").applyInArrow(_shared_keys(shards), "shard int, blob binary")
    near = shared.groupBy("shard").applyInArrow(_enough, "fp long")
    candidates = stored(near.join(classes, near["fp"] == classes["point"]).select("rep", "size"), "candidates")
    n, most, total, unnamed = candidates.agg(F.count(F.lit(1)), F.max("size"), F.sum("size"), F.count_if(F.col("rep").isNull())).first()
    ids = candidates.select(F.col("rep").alias("__rep")).distinct()
    ids = F.broadcast(ids) if n <= BROADCAST_IDS else ids.hint("shuffle_hash")
    named = docs.join(ids, F.col("doc_id") == F.col("__rep"), "left_semi").select("text")
    if unnamed:  # texts that only rows without doc_id have
        named = named.unionByName(docs.filter("doc_id is null").select("text").distinct())
    sets = stored(named.mapInArrow(_set_rows(rule.k), "fp long, n long, items binary"), "sets")
    if sets.count() > n + unnamed:  # rows that repeat an id
        once = stored(sets.groupBy("fp").agg(F.first("n").alias("n"), F.first("items").alias("items")), "sets")
        forget(sets)
        sets = once
    bounds = rings(rule, int(most or 1))
    few = max(parts_for(CELL_SHINGLE * int(total or 0), CELL_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = sets.filter("n > 0 and n <= %d" % int(most or 1)).mapInArrow(_cell_keys(rule, bounds, few), "shard int, blob binary")
    regions = components(keyed.groupBy("shard").applyInArrow(_meet(rule), "a long, b long"))
    placed = sets.join(regions, sets["fp"] == regions["node"]).select("fp", F.col("root").alias("region"), "items", "n")
    roots = stored(components(_regions_to_links(placed, rule)), "roots")
    forget(candidates, sets)
    return points, roots


def jaccard_components(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    component_id is the smallest doc_id reachable by links, the document's own
    included.  Defined cases: a null, empty or word-free text has no shingles
    and is linked with nothing; a text of fewer words than a shingle is one
    shingle; rows with a null doc_id are linked like others but never give
    their id, and a component of such rows alone has the id null; rows that
    repeat are linked; an empty table gives an empty table.
    """
    return _named(*linked_points(docs, rule))


def _named(points: DataFrame, roots: DataFrame, *more: str) -> DataFrame:
    """doc_id, n_shingles, component_id and the columns ``more`` of every row of the points."""
    classes = points.filter("n_shingles > 0").groupBy("point").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows"))
    # Points without links are a component each; only those with links are joined by their root, and big components are split.
    linked = stored(classes.join(roots, classes["point"] == roots["node"]).select("point", "root", "rep"), "linked")
    least = linked.groupBy("root").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = split_join(linked.select("point", "root"), least, "root", linked.count()).select("point", "component_id")
    alone = classes.join(roots, classes["point"] == roots["node"], "left_anti").select("point", F.col("rep").alias("component_id"))
    every = stored(named.unionByName(alone).select(F.col("point").alias("__fp"), "component_id"), "components")
    forget(linked, roots)
    out = points.join(every, (points["point"] == every["__fp"]) & (points["n_shingles"] > 0), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), *more)


def drop_near_copies(docs: DataFrame, rule: Rule = Rule(5, 80, 100)) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest doc_id; texts without words all stay.

    Defined cases: of rows without doc_id in a component of their own, that with
    the smallest text digest stays; rows that repeat a doc_id go or stay by
    their text, and of those in one component one stays; columns stay as they are.
    """
    points, roots = linked_points(docs, rule, digests=True)
    marks = points.filter("n_shingles > 0").groupBy("point", "doc_id", "digest").agg(F.count(F.lit(1)).alias("rows"))
    placed = stored(marks.join(roots, marks["point"] == roots["node"], "left").select("doc_id", "digest", "rows", F.coalesce("root", "point").alias("root")), "placed")
    # The first of each component; a null doc_id comes last.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest"))
    least = placed.groupBy("root").agg(first.alias("first"), F.count(F.lit(1)).alias("n"))
    rows = placed.count()
    chosen = split_join(placed, least, "root", rows)
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))
    forget(points, roots)
    # As many marks as rows would be wasteful: a pair of doc_id and text has its number of rows.
    return keep_rows_counted(docs, chosen.select("doc_id", "digest", "rows", stays.cast("long").alias("stay")))
