"""Phrase collocations: candidates from a sketch's upper bounds, counted exactly by automata.

Texts are dealt into batches.  A batch sends the cells of a hash sketch that
its words, and then its phrases of words that may be frequent, fall into; a
shard adds up its cells over all batches and answers which reach the least
count.  Cells only ever count too much, so that no frequent phrase is missed.
Each batch then compiles those of its own phrases that may be frequent into
automata, every word guarded by a delimiter on both sides, scans its texts for
all overlapping matches, and the matches of all batches are summed.  An
automaton holds what one batch of texts holds, however many phrases there are.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .exchange import PACKED, answers
from .hashing import Words, grams, mix, text_buffer
from .storage import parts_for, stored, text_bytes

MIN_COUNT = 100
LONGEST = 5
TOP = 2000
BATCH_TEXT = 8 << 20
#: Cells of one shard of the sketch, and bytes of text for which there is one.
CELLS, BYTES_PER_CELL = 4 << 20, 4
ENDS_PIECE = b".,;:!?\n\x0b\x0c\r"
_APART = np.zeros(256, bool)
_APART[[9, 32, *ENDS_PIECE]] = True
_ENDS = np.zeros(256, bool)
_ENDS[list(ENDS_PIECE)] = True
_PLAIN = bytes(10 if c in ENDS_PIECE else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_REQUEST = pa.schema([("batch", pa.int64()), ("shard", pa.int32()), ("blob", pa.binary())])
_PACKED_COUNTS = pa.schema([("shard", pa.int32()), ("part", pa.int64()), ("lang", pa.string()), ("phrase", pa.list_(pa.string())), ("f", pa.list_(pa.int64()))])
#: Batches whose counts are added up in one task, before those sums are.
SUMMED = 1024


def guarded(texts: list[bytes]) -> bytes:
    """The texts with A-Z in lower case, one space on both sides of every word and a line break between pieces."""
    flat = re.sub(rb" +", b" ", b"\n".join([b"", *texts, b""]).translate(_PLAIN))
    return re.sub(rb"\n+", b" \n ", flat.replace(b" \n", b"\n").replace(b"\n ", b"\n"))


class Sketch:
    """Cells of one hash row, in shards; a batch's counts stop at ``most``, which changes no decision about ``most``."""

    def __init__(self, shards: int, most: int):
        self.shards, self.most, self.kind = shards, most, np.min_scalar_type(most)

    def cells(self, hashes: np.ndarray) -> np.ndarray:
        return hashes % np.uint64(self.shards * CELLS)

    def request(self, batch: int, cells: np.ndarray, counts: np.ndarray) -> pa.Table:
        """One row for each shard that has some of the sorted distinct cells."""
        shard = cells // np.uint64(CELLS)
        at = np.flatnonzero(np.diff(shard, prepend=shard[:1] + np.uint64(1)))
        blobs = [self._packed(c % np.uint64(CELLS), n) for c, n in zip(np.split(cells, at[1:]), np.split(counts, at[1:]))] if len(at) else []
        return pa.table([pa.array(np.full(len(at), batch, np.int64)), pa.array(shard[at].astype(np.int32)), pa.array(blobs, pa.binary())], schema=_REQUEST)

    def _packed(self, offsets: np.ndarray, counts: np.ndarray) -> bytes:
        """The width of gaps (1 or 2 bytes), gaps and counts; a wider gap takes steps of no count."""
        gaps = np.diff(offsets, prepend=np.uint64(0))
        width = 1 if offsets[-1] < 128 * len(offsets) else 2
        far = np.uint64(256**width - 1)
        steps = gaps // far
        at = np.arange(len(gaps)) + np.cumsum(steps).astype(np.int64)
        size = int(at[-1]) + 1
        gap, count = np.full(size, far, f"u{width}"), np.zeros(size, self.kind)
        gap[at] = gaps - steps * far
        count[at] = np.minimum(counts, self.most)
        return bytes([width]) + gap.tobytes() + count.tobytes()

    def _opened(self, blob: bytes) -> tuple[np.ndarray, np.ndarray]:
        width = blob[0]
        size = (len(blob) - 1) // (width + self.kind.itemsize)
        count = np.frombuffer(blob, self.kind, size, 1 + width * size)
        real = count > 0
        return np.cumsum(np.frombuffer(blob, f"u{width}", size, 1), dtype=np.int64)[real], count[real]

    def answer(self, blobs: list[bytes]) -> list[bytes]:
        """A bit for each cell asked for: can its count be ``most`` or more?"""
        total = np.zeros(CELLS, np.uint32)
        for blob in blobs:
            at, count = self._opened(blob)
            total[at] = np.minimum(total[at] + count, self.most)
        return [np.packbits(total[self._opened(b)[0]] >= self.most).tobytes() for b in blobs]

    def frequent(self, replies: pa.Table, cells: np.ndarray) -> np.ndarray:
        """The answers, in the order of the batch's cells."""
        sizes = dict(zip(*(a.tolist() for a in np.unique(cells // np.uint64(CELLS), return_counts=True))))
        replies = replies.sort_by("shard")
        bits = [np.unpackbits(np.frombuffer(b.as_py(), np.uint8), count=sizes[s]) for s, b in zip(replies["shard"].to_pylist(), replies["blob"])]
        return np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)


class Batch:
    """The words of a batch: hashes that tell languages apart, and how many words follow in the piece."""

    def __init__(self, table: pa.Table, longest: int):
        self.batch, self.longest = table["batch"][0].as_py(), longest
        table = table.sort_by("lang")
        self.langs, self.texts = table["lang"].to_pylist(), table["text"]
        self.words = Words(*text_buffer(table["text"].combine_chunks()), True, _APART)
        salt = {lang: int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little") for lang in set(self.langs)}
        w, n = self.words, len(self.words.start)
        self.hash = mix(w.hash + np.repeat(np.array([salt[lang] for lang in self.langs], np.uint64), w.counts))
        ends = np.concatenate([[0], np.cumsum(_ENDS[w.data], dtype=np.int64)])
        last = np.ones(n, bool)
        if n:
            last[:-1] = ends[w.start[1:]] > ends[w.end[:-1]]
            last[w.first[1:][w.counts > 0] - 1] = True
        stop = np.flatnonzero(last)
        #: Words from each one on to the end of its piece, itself included.
        self.left = stop[np.searchsorted(stop, np.arange(n))] - np.arange(n) + 1 if n else np.zeros(0, np.int64)

    def word_cells(self, sketch: Sketch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.unique(sketch.cells(self.hash), return_inverse=True, return_counts=True)

    def frequent_words(self, sketch: Sketch, replies: pa.Table) -> np.ndarray:
        cells, of, _ = self.word_cells(sketch)
        return sketch.frequent(replies, cells)[of] if len(cells) else np.zeros(0, bool)

    def phrases(self, frequent: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For 2, 3, .. words: where phrases of words that may be frequent start, and their hashes."""
        bad = np.append(np.flatnonzero(~frequent), len(frequent))
        run = np.minimum(self.left, bad[np.searchsorted(bad, np.arange(len(frequent)))] - np.arange(len(frequent)))
        out = []
        for k in range(2, self.longest + 1):
            at = np.flatnonzero(run >= k)
            out.append((at, grams(self.hash, k)[at] + np.uint64(k)))
        return out

    def word(self, i: int) -> bytes:
        return self.words.data[self.words.start[i] : self.words.end[i]].tobytes().translate(_PLAIN)


def _nothing() -> pa.Table:
    return _REQUEST.empty_table()


def _word_requests(sketch: Sketch, longest: int):
    def run(table: pa.Table) -> pa.Table:
        b = Batch(table, longest)
        cells, _, counts = b.word_cells(sketch)
        return sketch.request(b.batch, cells, counts)

    return run


def _phrase_requests(words: Sketch, phrases: Sketch, longest: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _nothing()
        b = Batch(left, longest)
        found = b.phrases(b.frequent_words(words, right))
        cells, counts = np.unique(phrases.cells(np.concatenate([h for _, h in found])), return_counts=True)
        return phrases.request(b.batch, cells, counts)

    return run


def _counted(words: Sketch, phrases: Sketch, longest: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _PACKED_COUNTS.empty_table()
        b = Batch(left, longest)
        often = b.frequent_words(words, right.filter(pc.equal(right["round"], 1)))
        found = b.phrases(often)
        cells, of = np.unique(phrases.cells(np.concatenate([h for _, h in found])), return_inverse=True)
        hot = phrases.frequent(right.filter(pc.equal(right["round"], 2)), cells)[of] if len(cells) else np.zeros(0, bool)
        first = np.flatnonzero(often)
        starts = [(1, *_distinct(first, b.hash[first]))]
        shorter, done = often, 0
        for k, (at, h) in enumerate(found, 2):
            keep = hot[done : done + len(at)]
            done += len(at)
            at, h = at[keep], h[keep]
            # A phrase is no more frequent than its parts.
            keep = shorter[at] & shorter[at + 1]
            at, h = at[keep], h[keep]
            shorter = np.zeros(len(often), bool)
            shorter[at] = True
            starts.append((k, *_distinct(at, h)))
        bounds = [i for i, lang in enumerate(b.langs) if i == 0 or lang != b.langs[i - 1]] + [len(b.langs)]
        return pa.concat_tables([_of_language(b, lo, hi, starts, phrases.shards) for lo, hi in zip(bounds, bounds[1:])])

    return run


def _distinct(at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal hashes the first place, and the hashes."""
    hashes, first = np.unique(h, return_index=True)
    return at[first], hashes


def _of_language(b: Batch, lo: int, hi: int, starts: list[tuple[int, np.ndarray, np.ndarray]], shards: int) -> pa.Table:
    """Exact counts in texts lo to hi, which are of one language: all words (phrase null), frequent words, and phrases by automaton; one row a shard of the sums."""
    begin, end = int(b.words.first[lo]), int(b.words.first[hi])
    flat = guarded([t.as_py().encode() for t in b.texts[lo:hi]])
    each = Counter(flat.split(b" "))
    names, counts, hashes = [None], [end - begin], [np.zeros(1, np.uint64)]
    automaton, phrases = ahocorasick.Automaton(ahocorasick.STORE_INTS), 0
    for k, at, h in starts:
        mine = (at >= begin) & (at < end)
        hashes.append(h[mine])
        for i in at[mine].tolist():
            text = b" ".join([b.word(j) for j in range(i, i + k)])
            names.append(text.decode())
            if k == 1:
                counts.append(each[text])
            else:
                automaton.add_word(f" {names[-1]} ", phrases)
                phrases += 1
    if phrases:
        automaton.make_automaton()
        counts += np.bincount(np.fromiter((i for _, i in automaton.iter(flat.decode())), np.int64), minlength=phrases).tolist()
    shard = mix(np.concatenate(hashes)) % np.uint64(shards)
    order = np.argsort(shard, kind="stable")
    at = np.flatnonzero(np.diff(shard[order], prepend=shard[order[:1]] + np.uint64(1)))
    offsets = pa.array(np.append(at, len(order)), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(c, kind).take(pa.array(order))) for c, kind in ((names, pa.string()), (counts, pa.int64()))]
    return pa.table([pa.array(shard[order[at]].astype(np.int32)), pa.array(np.full(len(at), b.batch // SUMMED)), pa.array([b.langs[lo]] * len(at)), *lists], schema=_PACKED_COUNTS)


def _summed(table: pa.Table) -> pa.Table:
    """The counts of one shard over some batches."""
    phrase, f = (table[c].combine_chunks() for c in ("phrase", "f"))
    lang = table["lang"].combine_chunks().take(pc.list_parent_indices(phrase))
    flat = pa.table({"lang": lang, "phrase": phrase.flatten(), "f": f.flatten()})
    return flat.group_by(["lang", "phrase"]).aggregate([("f", "sum")]).select(["lang", "phrase", "f_sum"]).rename_columns(["lang", "phrase", "f"])


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, batch_text: int = BATCH_TEXT) -> DataFrame:
    """(lang, phrase, words, f): all phrases of 1 to ``longest`` words with ``min_count`` or more occurrences in a language, and its number of words (phrase null, words 0)."""
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    size, least = text_bytes(docs), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    batches, shards = parts_for(size, batch_text, least), parts_for(size, CELLS * BYTES_PER_CELL)
    # The task that reads a row is part of the hash, so that rows that repeat spread too; a task that runs again deals them as before.
    at = F.pmod(F.xxhash64("lang", "text", F.spark_partition_id()), F.lit(batches))
    x = docs.select(at.alias("batch"), "lang", "text").repartition(max(least, batches // 2), "batch")
    words, phrases = Sketch(shards, min_count), Sketch(shards, min_count)
    by = x.groupBy("batch")
    frequent = answers(by.applyInArrow(_word_requests(words, longest), PACKED), words.answer)
    hot = answers(by.cogroup(frequent.groupBy("batch")).applyInArrow(_phrase_requests(words, phrases, longest), PACKED), phrases.answer)
    both = frequent.withColumn("round", F.lit(1)).unionByName(hot.withColumn("round", F.lit(2)))
    packed = by.cogroup(both.groupBy("batch")).applyInArrow(_counted(words, phrases, longest), "shard int, part long, lang string, phrase array<string>, f array<long>")
    counted = packed.groupBy("shard", "part").applyInArrow(_summed, "lang string, phrase string, f long")
    summed = counted.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter((F.col("f") >= min_count) | F.col("phrase").isNull())
    return summed.select("lang", "phrase", F.coalesce(F.size(F.split("phrase", " ")), F.lit(0)).alias("words"), "f")


def scored_phrases(counts: DataFrame, longest: int = LONGEST, percent: int = 100) -> DataFrame:
    """(lang, phrase, a, l, r, n, score, inside) of the candidates among ``counts``.

    The cut with the lowest score counts, the first of equal ones; ``inside``
    says that a longer candidate which holds the phrase has ``percent`` of its
    count.
    """
    totals = counts.filter("phrase is null").select("lang", F.col("f").alias("n"))
    parts = counts.filter("phrase is not null").select("lang", "phrase", "words", "f")
    found = parts.filter("words > 1").withColumn("each", F.split("phrase", " "))
    piece = lambda i, n: F.array_join(F.slice("each", i, n), " ")
    cut = F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(k.alias("k"), piece(F.lit(1), k).alias("first"), piece(k + 1, F.col("words") - k).alias("rest")))
    cuts = found.select("lang", "phrase", F.col("f").alias("a"), F.inline(cut))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    # There are few languages, but nothing says how few: the join is left to the planner.
    score = F.expr("(cast(1000 as decimal(4, 0)) * (cast(a as decimal(16, 0)) * cast(n as decimal(16, 0)))) div (cast(l as decimal(16, 0)) * cast(r as decimal(16, 0)))")
    cuts = cuts.join(totals, "lang").select("lang", "phrase", "a", "l", "r", "n", score.alias("score"), "k")
    lowest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("c")).select("lang", "phrase", "c.a", "c.l", "c.r", "c.n", "c.score")
    inner = [(i, n) for n in range(2, longest) for i in range(1, longest - n + 2)]
    inside = F.filter(F.array(*[F.when(F.lit(i + n - 1) <= F.col("words"), F.when(F.col("words") > n, piece(i, n))) for i, n in inner]), lambda p: p.isNotNull())
    longer = found.filter("words > 2").select("lang", "f", F.explode(F.array_distinct(inside)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    covered = F.coalesce(F.lit(100) * F.col("longer") >= F.lit(percent) * F.col("a"), F.lit(False))
    return lowest.join(longer, ["lang", "phrase"], "left").select(*lowest.columns, covered.alias("inside"))


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP, percent: int = 100, batch_text: int = BATCH_TEXT) -> DataFrame:
    """Each language's ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    Defined cases: a null text is empty, a null lang is ``und``, as a lang of
    that name; rows that repeat count each time; a language without a candidate,
    and an empty table, give no rows; phrases whose count is under ``min_count``
    are no candidates and cover nothing; equal scores and counts go by the
    phrase's bytes; other columns are ignored.
    """
    counts = stored(phrase_counts(docs, min_count, longest, batch_text), "phrase-counts")
    found = scored_phrases(counts, longest, percent).filter(~F.col("inside"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return found.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
