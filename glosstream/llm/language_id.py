"""Language identification by interpolated Kneser-Ney character models.

Each language has a character n-gram model over its words (with a boundary on
both sides), smoothed by interpolated Kneser-Ney with one absolute discount an
order.  N-grams live in sorted hash arrays that all languages share, with one
column of probabilities a language.  A text gets the language with the lowest
cross-entropy a character; texts that no language explains about as well as its
own training texts are rejected, by a limit calibrated on held-back texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hashing import mix, slices
from .storage import stored

ORDER = 5
#: Bound on the texts that teach a language: those with the smallest hashes of doc_id and text.
TEXTS_PER_LANGUAGE = 1000
#: The number of rows by language is broadcast up to so many languages.
BROADCAST_LANGUAGES = 10_000
#: Words whose costs a process keeps at a time.
CACHED_WORDS = 200_000
#: The tables of all languages go to every executor up to this size; more languages than that need several calls.
TABLE_BYTES = 512 << 20
NOT_LETTERS = r"[^\p{L}\p{M}]+"
LETTER = r"\p{L}"
_SEED = np.uint64(0x51ED270B7F3A2C1D)


def words_in(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct lower-case words of the texts; for each running word its index there, and the texts' bounds."""
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")), NOT_LETTERS, " ")
    lists = pc.split_pattern(plain, " ")
    first = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), first


def has_letter(words: pa.Array) -> np.ndarray:
    """A word of marks alone is none."""
    return pc.match_substring_regex(words, LETTER).to_numpy(zero_copy_only=False) if len(words) else np.zeros(0, bool)


def _codes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, each between two boundaries (0), and where each begins."""
    text = words.to_pylist()
    joined = "\x00".join(text)
    flat = np.frombuffer(("\x00" + joined + "\x00").encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, text), np.int64, len(text))
    return flat, np.concatenate([[0], np.cumsum(sizes + 1)])


def _grams(flat: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the (up to) n characters that end at each position but the first boundary, and of their history.

    A history never reaches over a word's leading boundary.
    """
    size = len(flat)
    owner = np.searchsorted(starts[:-1], np.arange(1, size), "left") - 1  # a boundary ends the word before it
    room = np.arange(1, size) - starts[:-1][owner]  # characters before, the boundary included
    key = np.full(size - 1, _SEED)
    for back in range(n - 1, 0, -1):
        use = room >= back
        prior = np.zeros(size - 1, np.uint64)
        prior[back - 1 :] = flat[: size - back]
        key = np.where(use, mix(key * np.uint64(0x100000001B3) + prior + np.uint64(1)), key)
    history = key + np.uint64(n)
    return mix(history * np.uint64(0x100000001B3) + flat[1:] + np.uint64(1)), history


@dataclass
class CharModels:
    """For each order: sorted hashes of n-grams and of histories, with a row of numbers for each and a column a language."""

    langs: list[str]
    order: int
    gram_keys: list[np.ndarray]
    gram_parts: list[np.ndarray]
    history_keys: list[np.ndarray]
    history_weights: list[np.ndarray]
    floor: float
    limits: np.ndarray | None = None

    def cached_costs(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As word_costs; words seen before in this process are not worked out again."""
        cache = self.__dict__.setdefault("_cache", {})
        if len(cache) > CACHED_WORDS:
            cache.clear()
        if not cache:
            self._rows = np.zeros((0, len(self.langs) + 1))
        text = words.to_pylist()
        new = [w for w in text if w not in cache]
        if new:
            costs, size = self.word_costs(pa.array(new, words.type))
            cache.update(zip(new, range(len(self._rows), len(self._rows) + len(new))))
            self._rows = np.concatenate([self._rows, np.column_stack([costs, size])])
        rows = self._rows[np.fromiter(map(cache.__getitem__, text), np.int64, len(text))]
        return rows[:, :-1], rows[:, -1]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_cache", "_rows")}

    def word_costs(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each distinct word: nats by language, and characters (the end included)."""
        if not len(words):
            return np.zeros((0, len(self.langs))), np.zeros(0)
        flat, starts = _codes(words)
        p = np.full((len(flat) - 1, len(self.langs)), self.floor)
        for n in range(1, self.order + 1):
            grams, history = _grams(flat, starts, n)
            p = _row(self.gram_keys[n - 1], self.gram_parts[n - 1], grams, 0.0) + _row(self.history_keys[n - 1], self.history_weights[n - 1], history, 1.0) * p
        costs = -np.log(p)
        size = np.diff(starts)
        return np.add.reduceat(costs, starts[:-1], axis=0), size

    def entropies(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Nats a character by language for each text, and its characters; texts without letters have 0 characters."""
        words, index, first = words_in(column)
        costs, size = self.cached_costs(words)
        empty = ~has_letter(words)
        size = np.where(empty, 0, size)
        costs[empty] = 0
        n = len(first) - 1
        of = np.repeat(np.arange(n), np.diff(first))
        chars = np.bincount(of, size[index], n)
        total = np.stack([np.bincount(of, costs[:, k][index], n) for k in range(len(self.langs))], 1) if self.langs else np.zeros((n, 0))
        return total / np.maximum(chars, 1)[:, None], chars

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, confidence (0 to 1) and rejection of each text."""
        nats, chars = self.entropies(column)
        n = len(chars)
        if not self.langs:
            return ["und"] * n, np.zeros(n), np.ones(n, bool)
        best = nats.argmin(1)
        # The share of the best language if each character halves its weight of evidence with length.
        evidence = -nats * np.sqrt(np.maximum(chars, 1))[:, None]
        evidence -= evidence.max(1, keepdims=True)
        share = 1 / np.exp(evidence).sum(1)
        known = chars > 0
        over = np.zeros(n, bool) if self.limits is None else nats[np.arange(n), best] > self.limits[best] + 2.0 / np.sqrt(np.maximum(chars, 1))
        langs = [self.langs[b] if k else "und" for b, k in zip(best, known)]
        return langs, np.where(known, np.where(over, share / 2, share), 0.0), over | ~known


def _row(keys: np.ndarray, rows: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    """Rows of the sorted hash array for the wanted keys."""
    if not len(keys):
        return np.full((len(wanted), rows.shape[1]), missing)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    found = keys[at] == wanted
    out = rows[at]
    out[~found] = missing
    return out


def fit(vocabulary: dict[str, tuple[pa.Array, np.ndarray]], order: int = ORDER) -> CharModels:
    """Interpolated Kneser-Ney for each language, from its distinct words and how often each occurs; no limits yet."""
    langs = sorted(vocabulary)
    per: list[list[tuple]] = []
    charset = 1
    for lang in langs:
        words, weight = vocabulary[lang]
        orders = []
        if len(words):
            flat, starts = _codes(words)
            charset = max(charset, len(np.unique(flat)) + 1)
            occurs = np.repeat(weight, np.diff(starts))
            above: np.ndarray | None = None
            for n in range(order, 0, -1):
                grams, history = _grams(flat, starts, n)
                keys, at, inverse = np.unique(grams, return_index=True, return_inverse=True)
                if n == order:
                    counts = np.bincount(inverse, occurs)
                else:  # continuation counts: the distinct longer n-grams that end in this one
                    counts = np.bincount(inverse[above], minlength=len(keys)).astype(float)
                ones, twos = (counts == 1).sum(), (counts == 2).sum()
                discount = ones / (ones + 2 * twos) if ones and twos else 0.5
                hist = history[at]
                hkeys, hinv = np.unique(hist, return_inverse=True)
                total, kinds = np.bincount(hinv, counts), np.bincount(hinv)
                orders.append((keys, np.maximum(counts - discount, 0) / total[hinv], hkeys, discount * kinds / total))
                above = at
            orders.reverse()
        per.append(orders)
    gram_keys, gram_parts, history_keys, history_weights = [], [], [], []
    for n in range(order):
        for keys_out, rows_out, a, missing in ((gram_keys, gram_parts, 0, 0.0), (history_keys, history_weights, 2, 1.0)):
            keys = np.unique(np.concatenate([o[n][a] for o in per if o] or [np.zeros(0, np.uint64)]))
            rows = np.full((len(keys), len(langs)), missing)
            for k, o in enumerate(per):
                if o:
                    rows[np.searchsorted(keys, o[n][a]), k] = o[n][a + 1]
            keys_out.append(keys)
            rows_out.append(rows)
    return CharModels(langs, order, gram_keys, gram_parts, history_keys, history_weights, 1.0 / (charset + 1000))


def limits_of(own: list[np.ndarray]) -> np.ndarray:
    """By language the limit of rejection, from the nats a character of its held-back texts."""
    return np.array([float(np.quantile(x, 0.99)) + 0.25 if len(x) else 0.0 for x in own])


def counted(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct words of the texts, and how often each occurs."""
    words, index, _ = words_in(texts)
    keep = has_letter(words)
    return words.filter(pa.array(keep)), np.bincount(index, minlength=len(words))[keep]


def train(texts: dict[str, pa.Array], order: int = ORDER) -> CharModels:
    """Models from texts at hand; the last of every eight is held back to calibrate rejection."""
    last = {lang: np.arange(len(column)) % 8 == 7 if len(column) >= 8 else None for lang, column in texts.items()}
    models = fit({lang: counted(column if last[lang] is None else column.filter(pa.array(~last[lang]))) for lang, column in texts.items()}, order)
    own = []
    for k, lang in enumerate(models.langs):
        nats, chars = models.entropies(texts[lang] if last[lang] is None else texts[lang].filter(pa.array(last[lang])))
        own.append(nats[chars > 0, k])
    models.limits = limits_of(own)
    return models


def teaching_texts(docs: DataFrame, held_out: F.Column, texts: int = TEXTS_PER_LANGUAGE) -> DataFrame:
    """(lang, text, teaches, calibrates): by language ``texts`` texts, the smallest hashes of doc_id and text first, whatever their length.

    A text that an id repeats counts once, so that a language of few ids and
    many texts is learned like any other.  The last of every eight calibrates;
    of fewer than eight all do both.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out).select("doc_id", "lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    marks = rows.groupBy("lang", "h").agg(F.min("doc_id").alias("id"))
    # Only about four times as many texts as are wanted are ranked, so that no language meets in one task.
    # Hashes of distinct texts are even: fewer than a quarter of those expected below the bar never are.
    share = marks.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select(F.col("lang").alias("__lang"), (F.lit(2.0**64) * 4 * texts / F.col("n") - 2.0**63).alias("bar"))
    share = stored(share, "language-shares")
    few = share.count() <= BROADCAST_LANGUAGES
    near = marks.join(F.broadcast(share) if few else share, F.col("lang") == F.col("__lang")).filter(F.col("h") < F.col("bar"))
    rank, size = F.row_number().over(Window.partitionBy("lang").orderBy("h")), F.count(F.lit(1)).over(Window.partitionBy("lang"))
    ranked = near.select("lang", "h", "id", rank.alias("r"), (size < 8).alias("few")).filter(F.col("r") <= texts)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("id", "h")) % 8 == 0
    ranked = ranked.withColumn("place", place)
    chosen = ranked.select(F.col("lang").alias("__lang"), F.col("h").alias("__h"), (F.col("few") | ~F.col("place")).alias("teaches"), (F.col("few") | F.col("place")).alias("calibrates"))
    found = rows.join(F.broadcast(chosen) if few else chosen, (F.col("h") == F.col("__h")) & (F.col("lang") == F.col("__lang")))
    return stored(found.dropDuplicates(["lang", "h"]).select("lang", "text", "teaches", "calibrates"), "teaching-texts")


def learned(teaching: DataFrame) -> CharModels:
    """Models and limits; words are counted where the texts are, and only distinct words come to the driver."""

    def count(batches):
        for batch in batches:
            for lang in batch.column(0).unique().to_pylist():
                mine = batch.column(1).filter(pc.equal(batch.column(0), lang))
                for at, n in slices(mine, 1 << 20):
                    words, weight = counted(mine.slice(at, n))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), words.cast(pa.string()), pa.array(weight, pa.int64())], names=["lang", "word", "n"])

    sums = teaching.filter("teaches").select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    vocabulary = {}
    for r in teaching.select("lang").distinct().collect():
        own = sums.filter(pc.equal(sums["lang"], r["lang"])).sort_by("word")
        vocabulary[r["lang"]] = own["word"].cast(pa.large_string()).combine_chunks(), own["n"].to_numpy()
    models = fit(vocabulary)
    size = sum(a.nbytes for part in (models.gram_keys, models.gram_parts, models.history_keys, models.history_weights) for a in part)
    if size > TABLE_BYTES:
        raise ValueError(f"the tables of {len(models.langs)} languages take {size >> 20} MB, more than TABLE_BYTES: identify groups of languages in turn")

    def weigh(batches):
        for batch in batches:
            for at, n in slices(batch.column(1), 1 << 20):
                part = batch.slice(at, n)
                nats, chars = models.entropies(part.column(1))
                k = np.array([models.langs.index(x) for x in part.column(0).to_pylist()], np.int64)
                own = pa.RecordBatch.from_arrays([part.column(0), pa.array(nats[np.arange(len(k)), k])], names=["lang", "nats"])
                yield own.filter(pa.array(chars > 0))

    own = teaching.filter("calibrates").select("lang", "text").mapInArrow(weigh, "lang string, nats double").toArrow() if models.langs else None
    models.limits = limits_of([own.filter(pc.equal(own["lang"], lang))["nats"].to_numpy() for lang in models.langs])
    return models


def identify(docs: DataFrame, models: CharModels) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row and whole text."""

    def run(batches):
        for batch in batches:
            for at, n in slices(batch.column(1), 1 << 20):
                part = batch.slice(at, n)
                langs, score, rejected = models.predict(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def language_id(docs: DataFrame, texts: int = TEXTS_PER_LANGUAGE) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, rejected.

    Only texts with a language and with crc32(doc_id) mod 4 other than 2 teach.
    Defined cases: ``und`` with score 0 if the text is null or has no letter
    (marks without a letter are none), or if nothing could be learned;
    ``rejected`` marks these and texts that no model explains, whose score is
    halved; ties go to the first language by name; a null doc_id is not held
    out; a text that repeats with its doc_id teaches once; repeated rows get
    repeated results; an empty table gives an empty table.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    models = learned(teaching_texts(docs, held_out, texts))
    return identify(docs, models).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
