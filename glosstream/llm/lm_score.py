"""Language-model scoring with a corpus-wide n-gram trie.

The model is a bigram model with Dirichlet smoothing: with c the counts in the
teaching texts, P1(w) = (c(w) + 1) / (N + V + 1) and
P(w | v) = (c(v, w) + m(v) * P1(w)) / (c(v) + m(v)), where the prior's mass is
m(v) = MASS + SHARE * c(v).  Each word is followed by another or by the end, so
that c(v) is also the count of its successors.  Both c(v, w) / (c(v) + m(v)) and
m(v) / (c(v) + m(v)) are quantised and kept in Elias-Fano tries, one for each
shard of contexts.  Frequent contexts are cut into pieces that go to different
shards; the smoothing needs a context's count only, so that pieces and wholes
give the same probabilities.
The model grows with the corpus and is never in one place: batches of documents
ask the shards for the counts of their words, then for the codes of their
bigrams.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .elias_fano import ID_BITS, VALUES, Trie, quantise
from .exchange import PACKED, answers, dealt, gathered, packed, unpacked
from .hashing import Words, mix, text_buffer

#: Prior mass of the unigram model in each context, and for each occurrence of the context.
MASS, SHARE = 10.0, 0.7
#: Occurrences of a context in one piece at most.
PIECE = 100_000
END, BEGIN = (np.uint64(x) for x in (0x8A5CD789635D2DFF, 0x121FD2155C472F96))


class Tokens:
    """The tokens of one batch: words in lower case and an end for each text."""

    def __init__(self, table: pa.Table):
        self.batch = table["batch"][0].as_py()
        words = Words(*text_buffer(table["text"]), True)
        n = words.counts
        self.first = words.first + np.arange(len(words.first))
        token = np.empty(self.first[-1], np.uint64)
        end = np.zeros(len(token), bool)
        end[self.first[1:] - 1] = True
        token[end], token[~end] = END, words.hash
        self.teaches = np.repeat(table["teaches"].to_numpy().astype(bool), n + 1)
        code, words = pd.factorize(token)
        order = np.argsort(words)
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        self.words, self.word_at = words[order], rank[code]
        self.word_counts = np.bincount(self.word_at, self.teaches, len(words)).astype(np.int64)

    def bigrams(self) -> None:
        """Distinct (context, word) by their places, their count here, and where each token's is; BEGIN has the place behind all words."""
        size = np.int64(len(self.words))
        context = np.empty(len(self.word_at), np.int64)
        context[1:] = self.word_at[:-1]
        context[self.first[:-1]] = size
        self.pair_at, pair = pd.factorize(context * size + self.word_at)
        self.pair_counts = np.bincount(self.pair_at, self.teaches, len(pair)).astype(np.int64)
        self.context, self.word = pair // size, pair % size


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return (keys % np.uint64(shards)).astype(np.int64)


def _word_requests(shards: int):
    def run(table: pa.Table) -> pa.Table:
        tokens = Tokens(table)
        return packed(tokens.batch, _shard(tokens.words, shards), [tokens.words, tokens.word_counts], shards)[0]

    return run


def _word_counts(blobs: list[bytes]) -> list[bytes]:
    """Twice the corpus-wide count of each word asked for, and 1 more if several batches have the word."""
    parts = [unpacked(b, [np.uint64, np.int64]) for b in blobs]
    words, inverse, asked = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True, return_counts=True)
    total = np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(words)).astype(np.int64)
    total = (2 * total + (asked > 1))[inverse]
    return [p.tobytes() for p in np.split(total, np.cumsum([len(p[0]) for p in parts])[:-1])]


class Asked(Tokens):
    """Tokens with the counts of their words: what remains to be asked about bigrams."""

    def __init__(self, table: pa.Table, replies: pa.Table, shards: int, docs_taught: int, mass: float, piece: int):
        super().__init__(table)
        self.piece = piece
        order = np.argsort(_shard(self.words, shards).astype(np.uint32), kind="stable")
        replied = gathered(replies, order, np.dtype(np.int64))
        self.counts = replied >> 1
        self.bigrams()
        # Every taught text has one beginning, so the count of BEGIN is that of the taught texts.
        self.total = np.append(self.counts, docs_taught)[self.context]
        key = np.append(self.words, BEGIN)[self.context]
        ids = self.words[self.word] >> np.uint64(64 - ID_BITS)
        # A context that no other batch has is complete here: its trie is local.
        self.local = np.append(replied & 1 == 0, False)[self.context]
        pieces = -(-self.total // piece)
        self.keys = mix(key + np.where(pieces > 1, ids % np.maximum(pieces, 1).astype(np.uint64), np.uint64(0)) * np.uint64(0x9E3779B97F4A7C15))
        self.ids = ids
        self.codes = np.zeros((len(self.keys), 2), np.uint8)
        mine = np.flatnonzero(self.local & (self.total > 0))
        if len(mine):
            self.codes[mine] = _local(self.keys[mine], ids[mine], self.pair_counts[mine], self.total[mine], mass)
        self.out = np.flatnonzero(~self.local)
        self.out = self.out[np.lexsort((ids[self.out], self.keys[self.out]))]

    def request(self, shards: int) -> tuple[pa.Table, np.ndarray]:
        """Contexts, how many words each asks about, and ids and counts of those.

        Ids take five bytes; counts above 254 are sent apart.  A context that is
        whole in one shard has the sum of its counts as its total; only those in
        pieces bring theirs.
        """
        keys = self.keys[self.out]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        at = np.flatnonzero(new)
        runs = np.diff(np.append(at, len(keys)))
        shard = _shard(keys[at], shards)
        order = np.argsort(shard.astype(np.uint32), kind="stable")
        bounds = np.searchsorted(shard[order], np.arange(shards + 1))
        rank = np.empty(len(at), np.int64)
        rank[order] = np.arange(len(at))
        each = np.argsort(np.repeat(rank, runs), kind="stable")  # entries in the order of shards
        ends = np.concatenate([[0], np.cumsum(runs[order])])
        ids = self.ids[self.out][each].view(np.uint8).reshape(-1, 8)[:, :5]
        counts = self.pair_counts[self.out][each]
        small, big = np.minimum(counts, 255).astype(np.uint8), counts[counts > 254]
        big_at = np.concatenate([[0], np.cumsum(counts > 254)])
        totals = self.total[self.out][at]
        totals[totals <= self.piece] = 0
        ids_, blobs = [], []
        for s in np.flatnonzero(np.diff(bounds)):
            o = order[bounds[s] : bounds[s + 1]]
            a, b = ends[bounds[s]], ends[bounds[s + 1]]
            cut = np.flatnonzero(totals[o])
            ids_.append(int(s))
            blobs.append(
                np.array([len(o), b - a, big_at[b] - big_at[a], len(cut)], np.int64).tobytes()
                + keys[at[o]].tobytes() + cut.astype(np.int64).tobytes() + totals[o[cut]].tobytes() + runs[o].astype(np.uint32).tobytes()
                + big[big_at[a] : big_at[b]].tobytes() + small[a:b].tobytes() + ids[a:b].tobytes()
            )
        return pa.table({"batch": pa.array(np.full(len(ids_), self.batch, np.int64)), "shard": pa.array(ids_, pa.int32()), "blob": pa.array(blobs, pa.binary())}), self.out[each]


def _opened(blob: bytes) -> tuple[np.ndarray, ...]:
    """keys, totals (0: the sum of the counts), ids and counts of each entry."""
    n, m, b, c = np.frombuffer(blob, np.int64, 4).tolist()
    keys, totals, at = np.frombuffer(blob, np.uint64, n, 32), np.zeros(n, np.int64), 32 + 8 * n
    totals[np.frombuffer(blob, np.int64, c, at)] = np.frombuffer(blob, np.int64, c, at + 8 * c)
    at += 16 * c
    runs = np.frombuffer(blob, np.uint32, n, at)
    at += 4 * n
    big = np.frombuffer(bytes(blob[at : at + 8 * b]), np.int64)
    at += 8 * b
    counts = np.frombuffer(blob, np.uint8, m, at).astype(np.int64)
    ids = np.zeros((m, 8), np.uint8)
    ids[:, :5] = np.frombuffer(blob, np.uint8, 5 * m, at + m).reshape(m, 5)
    counts[counts == 255] = big
    return np.repeat(keys, runs), np.repeat(totals, runs), ids.view(np.uint64).ravel(), counts


def _codes(total: np.ndarray, every: np.ndarray, mass: float) -> tuple[np.ndarray, np.ndarray]:
    """The codes of a bigram and of its context, from its count and the context's."""
    prior = mass + SHARE * every
    return quantise(total / (every + prior)), quantise(prior / (every + prior))


def _local(keys: np.ndarray, ids: np.ndarray, counts: np.ndarray, totals: np.ndarray, mass: float) -> np.ndarray:
    """The codes of distinct bigrams whose contexts no other batch has, in their order: what a trie of them would answer."""
    out = np.stack(_codes(counts, totals, mass), 1)
    out[counts == 0, 0] = 0
    return out


def _trie(keys: np.ndarray, ids: np.ndarray, counts: np.ndarray, totals: np.ndarray, mass: float) -> Trie:
    """The trie of all bigrams that occur: counts of equal (key, id) are summed."""
    order = np.lexsort((ids, keys))
    keys, ids, counts, totals = keys[order], ids[order], counts[order], totals[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
    at = np.flatnonzero(new)
    total = np.add.reduceat(counts, at) if len(at) else counts
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else at
    sums = np.repeat(np.add.reduceat(counts, first), np.diff(np.append(first, len(keys)))) if len(keys) else totals
    totals = np.where(totals > 0, totals, sums)
    seen = total > 0
    at, total = at[seen], total[seen]
    return Trie.of(keys[at], ids[at], *_codes(total, totals[at], mass))


def _bigram_codes(mass: float):
    def run(blobs: list[bytes]) -> list[bytes]:
        parts = [_opened(b) for b in blobs]
        keys, totals, ids, counts = (np.concatenate([p[i] for p in parts]) for i in range(4))
        # The levels are one flat buffer, as they would be mapped from a file.
        trie = Trie.open(memoryview(_trie(keys, ids, counts, totals, mass).to_bytes()))
        del keys, totals, ids, counts
        # All codes, then all those of contexts: these repeat, and compress well on the way.
        return [trie.find(p[0], p[2]).T.tobytes() for p in parts]

    return run


def _nothing(names: list[str], schema: pa.Schema) -> pa.Table:
    return pa.table({n: pa.array([], schema.field(n).type) for n in names}, schema=schema)


_REQUEST = pa.schema([("batch", pa.int64()), ("shard", pa.int32()), ("blob", pa.binary())])


def _bigram_requests(shards: int, docs_taught: int, mass: float, piece: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _nothing(_REQUEST.names, _REQUEST)
        return Asked(left, right, shards, docs_taught, mass, piece).request(shards)[0]

    return run


def _scored(shards: int, docs_taught: int, mass: float, piece: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        kinds = [left.schema.field("doc_id").type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        out = pa.schema(list(zip(names, kinds)))
        if not left.num_rows:
            return _nothing(out.names, out)
        n, v = np.frombuffer(right.filter(pc.equal(right["round"], 3))["blob"][0].as_py(), np.int64).tolist()
        asked = Asked(left, right.filter(pc.equal(right["round"], 1)), shards, docs_taught, mass, piece)
        order = asked.request(shards)[1]
        replies = [np.frombuffer(b.as_py(), np.uint8).reshape(2, -1) for b in right.filter(pc.equal(right["round"], 2)).sort_by("shard")["blob"]]
        if replies:
            asked.codes[order] = np.concatenate(replies, 1).T
        p1 = (asked.counts + 1) / (n + v + 1)
        back = np.where(asked.codes[:, 1] > 0, VALUES[asked.codes[:, 1]], 1.0)
        p = VALUES[asked.codes[:, 0]] + back * p1[asked.word]
        first = asked.first
        known = np.concatenate([[0], np.cumsum((asked.counts > 0)[asked.word_at])])
        base, score = np.log10(p1)[asked.word_at], np.log10(p)[asked.pair_at]
        return pa.table(
            [left["doc_id"], left["held_out"], pa.array(np.diff(first)), pa.array(known[first[1:]] - known[first[:-1]]), pa.array(np.full(left.num_rows, n, np.int64)), pa.array(_exact(base, first)), pa.array(_exact(score, first))],
            schema=out,
        )

    return run


def _exact(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of x by text, each added up on its own: sums over the whole batch would lose digits."""
    return np.add.reduceat(x, first[:-1])


def _sizes(table: pa.Table) -> pa.Table:
    """A shard's part of N and V, from what the batches ask about words."""
    parts = [unpacked(b.as_py(), [np.uint64, np.int64]) for b in table["blob"]]
    words, counts = (np.concatenate([p[i] for p in parts]) for i in range(2))
    return pa.table({"n": pa.array([int(counts.sum())]), "v": pa.array([len(np.unique(words[counts > 0]))])})


def _corpus_size(asked: DataFrame, batches: int) -> DataFrame:
    """(batch, shard, blob) with N and V, the tokens and distinct tokens that teach, once for each batch."""
    both = asked.groupBy("shard").applyInArrow(_sizes, "n long, v long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v"))

    def rows(tables):
        for t in tables:
            for n, v in zip(t.column(0).to_pylist(), t.column(1).to_pylist()):
                blob = np.array([n, v], np.int64).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(batches)), pa.array(np.zeros(batches, np.int32)), pa.array([blob] * batches, pa.binary())], names=["batch", "shard", "blob"])

    return both.mapInArrow(rows, PACKED)


def lm_scores(docs: DataFrame, held_out: F.Column, mass: float = MASS, piece: int = PIECE) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows that are not held out teach.  Defined cases: a null or empty text is
    one token, its end; rows that repeat teach each time; a null ``held_out``
    (from a null doc_id) teaches; if nothing teaches, every probability is that
    of an unknown token, 1; doc_id may have any type; an empty table gives an
    empty table.
    """
    teaches = ~F.coalesce(held_out, F.lit(False))
    marked = docs.select("doc_id", "text", held_out.alias("held_out"))
    x, batches, shards = dealt(marked)
    texts = docs.select("doc_id").filter(teaches).count()
    x = x.withColumn("held_out", ~teaches).withColumn("teaches", teaches)
    by = x.groupBy("batch")
    asked = by.applyInArrow(_word_requests(shards), PACKED)
    counts = answers(asked, _word_counts)
    codes = answers(by.cogroup(counts.groupBy("batch")).applyInArrow(_bigram_requests(shards, texts, mass, piece), PACKED), _bigram_codes(mass))
    every = counts.withColumn("round", F.lit(1)).unionByName(codes.withColumn("round", F.lit(2))).unionByName(_corpus_size(asked, batches).withColumn("round", F.lit(3)))
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return by.cogroup(every.groupBy("batch")).applyInArrow(_scored(shards, texts, mass, piece), schema)


def lm_score(docs: DataFrame) -> DataFrame:
    """Scores by a model of the documents whose crc32(doc_id) mod 7 is not 2."""
    return lm_scores(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)


def model_shards(docs: DataFrame, mass: float = MASS, piece: int = PIECE) -> DataFrame:
    """The model of all of ``docs`` for other uses: (shard, trie), each trie a flat buffer for ``Trie.open``.

    Contexts that one batch knows completely are part of these tries too.
    """
    x, _, shards = dealt(docs.select("doc_id", "text"))
    texts = docs.count()
    x = x.withColumn("held_out", F.lit(False)).withColumn("teaches", F.lit(True))
    by = x.groupBy("batch")
    counts = answers(by.applyInArrow(_word_requests(shards), PACKED), _word_counts)

    def every(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _nothing(_REQUEST.names, _REQUEST)
        asked = Asked(left, right, shards, texts, mass, piece)
        asked.out = np.lexsort((asked.ids, asked.keys))
        return asked.request(shards)[0]

    def build(table: pa.Table) -> pa.Table:
        parts = [_opened(b.as_py()) for b in table["blob"]]
        keys, totals, ids, counted = (np.concatenate([p[i] for p in parts]) for i in range(4))
        return pa.table({"shard": table["shard"][:1], "trie": pa.array([_trie(keys, ids, counted, totals, mass).to_bytes()], pa.binary())})

    return by.cogroup(counts.groupBy("batch")).applyInArrow(every, PACKED).groupBy("shard").applyInArrow(build, "shard int, trie binary")
