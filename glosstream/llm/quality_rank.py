"""Quality classifier: Bradley-Terry ranking from preference pairs.

Documents labelled good are preferred to documents labelled poor.  The score of
a document is w·x; the chance that a beats b is sigmoid(w·(x_a - x_b)), and w is
learned by logistic loss on the feature differences of pairs.  A sigmoid fitted
on the same labels turns scores into 0..1, and a filter keeps what lies above a
score quantile of the labelled rows or above a fixed score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import Words, slices, text_buffer

#: Bound on the labelled rows that the fit uses, by the smallest hashes of doc_id.
FIT_ROWS = 12_000
PAIRS = 60_000

_CLASS = np.zeros(256, np.uint8)  # kinds of bytes
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[9, 11, 12, 13, 32]] = 4
_CLASS[10] = 5
_CLASS[[ord(c) for c in ".,;:'\"?-()"]] = 6
_CLASS[128:192] = 8  # the later bytes of a character
_CLASS[192:] = 9
_OTHER_ASCII = [c for c in range(33, 127) if _CLASS[c] == 0]
_CLASS[_OTHER_ASCII] = 7
_SYMBOLS = "#$%&*|!@<>{}[]\\/=+_~^"
NAMES = (
    ["log_bytes", "log_words", "word_bytes", "long_words", "short_words", "upper_words", "digit_words", "symbol_ends", "lone_symbols", "distinct_words", "top_word", "repeat_next", "log_lines", "line_bytes", "distinct_lines", "stops"]
    + [f"class_{i}" for i in range(10)]
    + [f"sym_{i}" for i in range(len(_SYMBOLS))]
)


def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over the ranges first[i]:first[i+1]."""
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def _distinct(groups: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each group the number of distinct keys and the count of the commonest."""
    order = np.lexsort((keys, groups))
    g, k = groups[order], keys[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(g)))
    top = np.zeros(n, np.int64)
    np.maximum.at(top, g[at], runs)
    return np.bincount(g[at], minlength=n), top


def features(column: pa.Array) -> np.ndarray:
    """One row of NAMES for each text, from the whole text; an empty text has zeros."""
    data, offsets = text_buffer(column)
    n = len(offsets) - 1
    words = Words(data, offsets, False)
    lengths = np.diff(offsets).astype(float)
    count = words.counts.astype(float)
    size, of = (words.end - words.start).astype(float), words.text_of()
    per_byte, per_word = np.maximum(lengths, 1), np.maximum(count, 1)
    kinds = _CLASS[data]
    seen = np.bincount(np.repeat(np.arange(n) * 256, np.diff(offsets)) + data, minlength=n * 256).reshape(n, 256)
    share = [seen[:, _CLASS == i].sum(1) / per_byte for i in range(10)]
    symbol = [seen[:, ord(c)] / per_byte for c in _SYMBOLS]
    head = kinds[words.start] if len(words.start) else np.zeros(0, np.uint8)
    tail = kinds[words.end - 1] if len(words.start) else np.zeros(0, np.uint8)
    upper = np.zeros(len(data) + 1)
    np.cumsum(kinds == 2, out=upper[1:])
    uppers = upper[words.end] - upper[words.start]
    distinct, top = _distinct(of, words.hash, n)
    same = np.zeros(len(of))
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (of[1:] == of[:-1])
    breaks = np.flatnonzero(data == 10)
    line_of = np.searchsorted(breaks, words.start)  # words are in lines of their text
    line = line_of.astype(np.uint64) * np.uint64(2) + np.uint64(0)
    new_line = np.ones(len(of), bool)
    new_line[1:] = (line[1:] != line[:-1]) | (of[1:] != of[:-1])
    starts = np.flatnonzero(new_line)
    lines = np.maximum(np.bincount(of[starts], minlength=n), 1).astype(float) if len(starts) else np.ones(n)
    if len(starts):
        digest = np.add.reduceat(words.hash * (np.arange(len(of)) - np.repeat(starts, np.diff(np.append(starts, len(of)))) + 1).astype(np.uint64), starts)
        lines_distinct, _ = _distinct(of[starts], digest, n)
    else:
        lines_distinct = np.zeros(n)
    mean = lambda x: _per_text(x, words.first) / per_word
    columns = [
        np.log1p(lengths), np.log1p(count), mean(size) / 10, mean(size > 12), mean(size <= 3), mean((uppers >= 2) & (uppers >= 0.5 * size)), mean(head == 3), mean(tail == 7), mean((head == 7) & (size <= 2)),
        distinct / per_word, top / per_word, mean(same), np.log1p(lines), np.log1p(lengths / lines), lines_distinct / lines, mean((tail == 6)),
        *share, *symbol,
    ]
    out = np.stack(columns, 1)
    out[lengths == 0] = 0
    return out


@dataclass
class Ranker:
    """score(x) = sigmoid(slope * w·(x - mean) / scale + offset)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float
    offset: float
    quantiles: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.offset, -40, 40)))

    def threshold(self, quantile: float) -> float:
        """The score below which that share of the labelled rows lies."""
        return float(np.quantile(self.quantiles, quantile))


def _sigmoid(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the sigmoid of scores, by Newton's method with step halving.

    Targets lie a little inside 0 and 1, so that separable labels do not saturate it.
    """
    good, poor = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (poor + 2))
    x = np.stack([raw, np.ones(len(raw))], 1)

    def loss(v: np.ndarray) -> float:
        s = x @ v
        return float((np.logaddexp(0, s) - target * s).mean())

    v = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -40, 40)))
        gradient = x.T @ (p - target) / len(y)
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(y) + 1e-9 * np.eye(2)
        step, size = np.linalg.solve(curve, gradient), 1.0
        while size > 1e-6 and loss(v - size * step) > loss(v):
            size /= 2
        v = v - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return float(v[0]), float(v[1])


def fit_ranker(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, l2: float = 1e-3, steps: int = 30) -> Ranker:
    """Newton's method on sum log(1 + exp(-w·(x_good - x_poor))) over random preference pairs.

    Without both labels every document gets the share of good ones as its score.
    """
    width = x.shape[1] if x.ndim == 2 else len(NAMES)
    good, poor = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(poor):
        base = (len(good) + 0.5) / (len(y) + 1)
        return Ranker(np.zeros(width), np.ones(width), np.zeros(width), 0.0, float(np.log(base / (1 - base))), np.array([base]))
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(5)
    # Each document takes part about equally often.
    diff = z[np.resize(rng.permutation(good), pairs)] - z[rng.permutation(np.resize(rng.permutation(poor), pairs))]
    w = np.zeros(width)
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -40, 40)))  # chance of the wrong order
        gradient = l2 * w - diff.T @ p / pairs
        curve = (diff * (p * (1 - p))[:, None]).T @ diff / pairs + l2 * np.eye(width)
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    raw = z @ w
    slope, offset = _sigmoid(raw, y)
    ranker = Ranker(mean, scale, w, slope, offset, np.zeros(0))
    ranker.quantiles = np.quantile(ranker.score(x), np.linspace(0, 1, 1001))
    return ranker


def learn(docs: DataFrame, labels: DataFrame, held_out: F.Column | None = None, rows: int = FIT_ROWS) -> Ranker:
    """Fit on at most ``rows`` labelled documents (those with the smallest hashes of doc_id) that are not held out.

    A document with several labels, or one of null, teaches nothing.
    """
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("r")).filter("q = r and q in (0, 1)")
    if held_out is not None:
        marks = marks.filter(~held_out)
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select(F.col("doc_id").alias("__id"), "q")

    def measure(batches):
        for batch in batches:
            for at, n in slices(batch.column(0)):
                x = features(batch.column(0).slice(at, n))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(at, n).cast(pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], names=["q", "x"])

    marked = docs.select("doc_id", "text").join(F.broadcast(marks), F.col("doc_id") == F.col("__id")).select("text", "q", "doc_id")
    found = marked.select("text", "q").mapInArrow(measure, "q int, x array<double>").toPandas()
    x = np.array(found["x"].tolist(), float).reshape(len(found), len(NAMES))
    y = found["q"].to_numpy(float)
    order = np.lexsort((*x.T[:4], y)) if len(y) else np.zeros(0, int)  # the same fit, however the rows arrive
    return fit_ranker(x[order] if len(y) else np.zeros((0, len(NAMES))), y[order])


def score_texts(docs: DataFrame, ranker: Ranker, column: str = "text", name: str = "score") -> DataFrame:
    """(doc_id, score) for every row."""

    def run(batches):
        for batch in batches:
            for at, n in slices(batch.column(1)):
                part = batch.slice(at, n)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ranker.score(features(part.column(1))), pa.float64())], names=["doc_id", name])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", column).mapInArrow(run, f"doc_id {kind}, {name} double")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Only documents whose crc32(doc_id) mod 5 is not 0 teach.  Defined cases:
    null and empty texts have all features 0 and the score that follows from
    them; without labels of both kinds the score is the share of good ones;
    a null doc_id is not held out; repeated rows get repeated results; an empty
    table gives an empty table.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    ranker = learn(docs, labels, held_out, fit_rows)
    scored = score_texts(docs, ranker)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float | None = 0.3, quantile: float | None = None, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``docs`` without those that score below the threshold, or below that quantile of the labelled rows' scores.

    Columns stay as they are; null and empty texts are scored like any other.
    """
    ranker = learn(docs, labels, None, fit_rows)
    bar = ranker.threshold(quantile) if quantile is not None else threshold
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, n) for i, n in slices(batch.column(at))):
                yield part.filter(pa.array(ranker.score(features(part.column(at))) >= bar))

    return docs.mapInArrow(run, docs.schema)
