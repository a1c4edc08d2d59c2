"""Substring deduplication by relative Lempel-Ziv parsing.

All texts together are the reference.  It is cut into blocks by a hash of its
word windows, and each block is indexed: sorted digests of its windows, each
with the smallest doc_id that holds it and the place there.  A document asks
every block that its windows fall into.  Parsing is greedy: a factor begins at a
window of an earlier document and extends along that document, word by word, as
long as the next window is found at the next place of the same source.  Where
it ends, windows across its boundary are looked at too, so that a factor that
straddles it goes on from there; the union of factors is exactly the text
covered by repeated windows.

Blocks by window and not by stretch of text keep the work linear: a document
does not have to be laid beside every part of the corpus.  Before that, each
window is represented by its least 8-gram (a minimiser, equal for equal
windows); windows whose minimiser occurs in one document only are left out.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import PACKED, answers, dealt, gathered, packed, unpacked
from .hashing import Words, gram_starts, grams, text_buffer

WINDOW, ANCHOR = 13, 8
#: Text of a batch: a Python worker needs about thirty times as much.
BATCH_TEXT = 4 << 20
_LAST = np.iinfo(np.int64).max


class Parsed:
    """Windows and minimisers of one batch of documents."""

    def __init__(self, table: pa.Table, window: int, anchor: int):
        self.batch = table["batch"][0].as_py()
        self.ids = table["doc_id"].cast(pa.int64()).fill_null(_LAST).to_numpy()
        self.texts = table["text"]
        self.words = Words(*text_buffer(table["text"]), False)
        self.window = window
        self.start = gram_starts(self.words, window)
        least = grams(self.words.hash, anchor)
        self.least = least[self.start]
        for j in range(1, window - anchor + 1):
            np.minimum(self.least, least[self.start + j], out=self.least)
        self.of = self.words.text_of()[self.start]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct minimisers, and whether several of these documents hold each."""
        new = np.ones(len(self.least), bool)
        new[1:] = (self.least[1:] != self.least[:-1]) | (self.of[1:] != self.of[:-1])
        key, of = self.least[new], self.of[new]
        order = np.argsort(key)
        key, of = key[order], of[order]
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        if not len(at):
            return key, np.zeros(0, bool)
        return key[at], np.minimum.reduceat(of, at) != np.maximum.reduceat(of, at)

    def shared(self, keys: np.ndarray, alive: np.ndarray) -> None:
        """Digests of the windows whose minimiser other documents hold, and the least doc_id here of each."""
        use = alive[np.searchsorted(keys, self.least)] if len(keys) else np.zeros(0, bool)
        self.start, self.of = self.start[use], self.of[use]
        digest = grams(self.words.hash, self.window)[self.start]
        second = (grams(self.words.hash, self.window, True)[self.start] >> np.uint64(32)).astype(np.uint32)
        ids = self.ids[self.of]
        order = np.lexsort((ids, second, digest))
        new = np.ones(len(order), bool)
        d, s = digest[order], second[order]
        new[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1])
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.cumsum(new) - 1
        self.digest, self.second, self.first_id = d[new], s[new], ids[order][new]
        self.first_at = (self.start - self.words.first[self.of]).astype(np.uint32)[order][new]


def factors(at: np.ndarray, of: np.ndarray, source: np.ndarray, place: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Greedy factors as (text, from, to, source, place in the source), from the windows that repeat.

    ``at`` are the windows' first words, increasing over all texts; ``of`` their
    texts; ``source`` and ``place`` where the index has them.  A factor takes
    windows as long as each follows the one before here and in its source.  One
    that begins inside the factor before it straddles its boundary and keeps
    what lies behind it, so that factors are disjoint.
    """
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (of[1:] != of[:-1]) | (source[1:] != source[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1 if len(first) else first
    text, start, stop = of[first], at[first].copy(), at[last] + window
    straddles = np.zeros(len(first), bool)
    straddles[1:] = (text[1:] == text[:-1]) & (start[1:] < stop[:-1])
    cut = np.zeros(len(first), np.int64)
    cut[straddles] = stop[np.flatnonzero(straddles) - 1] - start[straddles]
    return text, start + cut, stop, source[first], place[first].astype(np.int64) + cut


def _anchor_requests(window: int, anchor: int, shards: int):
    def run(table: pa.Table) -> pa.Table:
        parsed = Parsed(table, window, anchor)
        keys, several = parsed.anchors()
        return packed(parsed.batch, (keys % np.uint64(shards)).astype(np.int64), [keys, several], shards)[0]

    return run


def _anchors_alive(blobs: list[bytes]) -> list[bytes]:
    """A bit for each minimiser: do two documents hold it?"""
    parts = [unpacked(b, [np.uint64, bool]) for b in blobs]
    _, inverse, n = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True, return_counts=True)
    alive = n > 1
    alive[inverse[np.concatenate([p[1] for p in parts])]] = True
    bounds = np.cumsum([len(p[0]) for p in parts])[:-1]
    return [p.tobytes() for p in np.split(alive[inverse], bounds)]


def _again(left: pa.Table, right: pa.Table, window: int, anchor: int, shards: int) -> Parsed:
    parsed = Parsed(left, window, anchor)
    keys, _ = parsed.anchors()
    order = np.argsort((keys % np.uint64(shards)).astype(np.uint32), kind="stable")
    parsed.shared(keys, gathered(right, order, np.dtype(bool)))
    return parsed


def _window_requests(window: int, anchor: int, shards: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"batch": pa.array([], pa.int64()), "shard": pa.array([], pa.int32()), "blob": pa.array([], pa.binary())})
        parsed = _again(left, right, window, anchor, shards)
        return packed(parsed.batch, (parsed.digest % np.uint64(shards)).astype(np.int64), [parsed.digest, parsed.second, parsed.first_id, parsed.first_at], shards)[0]

    return run


def _indexed_block(blobs: list[bytes]) -> list[bytes]:
    """For each window asked for: does a document with a smaller doc_id hold it?  And of those the smallest, and where."""
    parts = [unpacked(b, [np.uint64, np.uint32, np.int64, np.uint32]) for b in blobs]
    digest, second, ids, place = (np.concatenate([p[i] for p in parts]) for i in range(4))
    order = np.lexsort((ids, second, digest))
    new = np.ones(len(order), bool)
    d, s = digest[order], second[order]
    new[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1])
    least = np.empty(len(order), np.int64)
    least[order] = order[new][np.cumsum(new) - 1]
    earlier = ids > ids[least]
    cuts = np.cumsum([len(p[0]) for p in parts])[:-1]
    return [e.tobytes() + ids[at[e]].tobytes() + place[at[e]].tobytes() for e, at in zip(np.split(earlier, cuts), np.split(least, cuts))]


def _sources(replies: pa.Table, order: np.ndarray, shard: np.ndarray, parsed: Parsed) -> tuple[np.ndarray, np.ndarray]:
    """The smallest doc_id that holds each of the batch's distinct windows, and the place there."""
    source, place = parsed.first_id.copy(), parsed.first_at.copy()
    replies = replies.sort_by("shard")
    sizes = np.bincount(shard, minlength=1)
    at = 0
    for s, blob in zip(replies["shard"].to_pylist(), replies["blob"]):
        raw, n = blob.as_py(), int(sizes[s])
        mine = order[at : at + n][np.frombuffer(raw, bool, n)]
        source[mine] = np.frombuffer(raw, np.int64, len(mine), n)
        place[mine] = np.frombuffer(raw, np.uint32, len(mine), n + 8 * len(mine))
        at += n
    return source, place


def _factored(window: int, anchor: int, shards: int, with_text: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        first = right.filter(pa.compute.equal(right["round"], 1))
        parsed = _again(left, first, window, anchor, shards) if left.num_rows else None
        if parsed is None:
            return _rows(left["doc_id"], [], [], [], [np.zeros(0, np.int64)] * 5, with_text, [])
        shard = (parsed.digest % np.uint64(shards)).astype(np.int64)
        source, place = _sources(right.filter(pa.compute.equal(right["round"], 2)), np.argsort(shard.astype(np.uint32), kind="stable"), shard, parsed)
        hit = parsed.ids[parsed.of] > source[parsed.group]
        found = factors(parsed.start[hit], parsed.of[hit], source[parsed.group[hit]], place[parsed.group[hit]], window)
        at = parsed.words.first
        edge = np.zeros(int(at[-1]) + 1, np.int64)
        edge[found[1]] += 1
        edge[found[2]] -= 1
        stays = np.cumsum(edge)[:-1] == 0
        before = np.concatenate([[0], np.cumsum(~stays)])
        removed = before[at[1:]] - before[at[:-1]]
        digests, texts = [], []
        for i, text in enumerate(parsed.texts):
            words = (text.as_py() or "").encode().split()
            kept = b" ".join(compress(words, stays[at[i] : at[i + 1]]) if removed[i] else words)
            digests.append(hashlib.sha256(kept).hexdigest())
            texts.append(kept.decode() if with_text else None)
        inside = (found[0], found[1] - at[found[0]], found[2] - at[found[0]], *found[3:])
        return _rows(left["doc_id"], np.diff(at).astype(np.int64), removed, digests, inside, with_text, texts)

    return run


def _rows(ids: pa.ChunkedArray, n_words, removed, digests, found, with_text: bool, texts) -> pa.Table:
    text, *columns = found
    kinds = [("start", pa.int64()), ("stop", pa.int64()), ("source", pa.int64()), ("source_start", pa.int64())]
    offsets = np.searchsorted(text, np.arange(len(ids) + 1)).astype(np.int32)
    spans = pa.StructArray.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, kinds)], [name for name, _ in kinds])
    out = {
        "doc_id": ids,
        "n_words": pa.array(n_words, pa.int64()),
        "n_removed": pa.array(removed, pa.int64()),
        "kept_sha256": pa.array(digests, pa.string()),
        "spans": pa.ListArray.from_arrays(pa.array(offsets), spans),
    }
    if with_text:
        out["kept_text"] = pa.array(list(texts), pa.string())
    return pa.table(out)


def substring_dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, spans (and kept_text on request).

    Spans are the factors: disjoint word positions [start, stop) and where they
    come from, document ``source`` from its word ``source_start`` on; together
    they cover the windows of ``window`` words that documents with smaller ids
    hold.  Defined cases: doc_id must be a whole number (another type raises
    TypeError); a null or empty text has no words and the digest of the empty
    string; texts shorter than a window lose nothing; rows that repeat a doc_id
    are not earlier than one another; a null doc_id is later than every other
    but 2**63 - 1, which ranks like it; an empty table gives an empty table;
    other columns are ignored.
    """
    kind = dict(docs.dtypes)["doc_id"]
    if kind not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError(f"doc_id orders the documents and must be a whole number, not {kind}")
    x, _, shards = dealt(docs, BATCH_TEXT)
    by = x.groupBy("batch")
    alive = answers(by.applyInArrow(_anchor_requests(window, anchor, shards), PACKED), _anchors_alive)
    asked = by.cogroup(alive.groupBy("batch")).applyInArrow(_window_requests(window, anchor, shards), PACKED)
    earlier = answers(asked, _indexed_block)
    both = alive.withColumn("round", F.lit(1)).unionByName(earlier.withColumn("round", F.lit(2)))
    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, spans array<struct<start: long, stop: long, source: long, source_start: long>>" + ", kept_text string" * with_text
    return by.cogroup(both.groupBy("batch")).applyInArrow(_factored(window, anchor, shards, with_text), schema)
