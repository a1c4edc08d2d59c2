"""Places in texts: where footnotes belong, and which stretch of a corpus given words stand for."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.arrays import let
from ..functions.similarity import ratio_udf

#: Fixed value: brackets with nothing inside, and the space before them, are no part of a text's letters.
EMPTY_BRACKETS = "(?U)\\s*\\(\\s*\\)"
#: Fixed value: mean similarity of words from which a window counts.
ALIKE = 85.0
#: Queries of a group that meet its words in one row, and words that are looked up at once.
ASKED, AT_ONCE = 10_000, 1 << 18


def letters(content: Column) -> Column:
    """What anchors are compared with: no white space, guillemets or empty brackets."""
    # Most texts have no bracket: they are not searched for empty ones.
    return T.anchor_key(F.when(content.contains("("), T.replace(content, EMPTY_BRACKETS)).otherwise(content))


def offset_behind(content: Column, k: Column) -> Column:
    """How many characters of the content stand before the end of its k-th letter (see :func:`letters`)."""
    # Each letter with what is none before it; brackets with nothing inside are tried first.
    pieces = F.regexp_extract_all(content, F.lit("(?Us)((?:\\s*\\(\\s*\\)|[\\s«»])*+.)"))
    return F.length(F.array_join(F.slice(pieces, F.lit(1), k.cast("int")), ""))


def place_notes(segments: DataFrame, notes: DataFrame) -> DataFrame:
    """(doc_id, para, n, number, ord, at): the segment of its paragraph that each note's mark goes into, and behind how many characters.

    segments(doc_id, para, ord, content), notes(doc_id, para, n, anchor).  The
    segments' letters, laid end to end, are the paragraph's; an anchor is looked
    up there behind the one before it, and the place found falls into the
    segment whose range of prefix sums holds it.  A note with an empty anchor
    goes to the beginning of the first segment, one that is not found to the end
    of the last; notes of paragraphs without segments are left out.  Null
    contents and anchors count as empty.  Numbers run through the document.
    """
    paragraph = ["doc_id", "para"]
    w = Window.partitionBy(*paragraph).orderBy("ord")
    content = F.coalesce("content", F.lit(""))
    kept = segments.select(*paragraph, "ord", content.alias("content"), letters(content).alias("letters"))
    kept = kept.withColumns({"stop": F.sum(F.length("letters")).over(w), "first": F.lag("ord").over(w).isNull(), "last": F.lead("ord").over(w).isNull()}).withColumn("start", F.col("stop") - F.length("letters"))
    joined = kept.groupBy(*paragraph).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "letters"))), lambda s: s["letters"]), "").alias("joined"))
    asked = notes.groupBy(*paragraph).agg(F.array_sort(F.collect_list(F.struct("n", F.coalesce("anchor", F.lit("")).alias("anchor")))).alias("notes")).join(joined, paragraph)

    def find(done: Column, note: Column) -> Column:
        """Ends of the anchors so far: -1 for an empty one, 0 for one that is not there."""
        at = F.position(note["anchor"], F.col("joined"), done["behind"] + 1)
        end = F.when(note["anchor"] == "", F.lit(-1)).when(at > 0, at + F.length(note["anchor"]) - 1).otherwise(0)
        return let(end, lambda e: F.struct(F.greatest(done["behind"], e).alias("behind"), F.concat(done["ends"], F.array(F.struct(note["n"].alias("n"), e.alias("end")))).alias("ends")))

    kind = notes.schema["n"].dataType.simpleString()
    start = F.struct(F.lit(0).alias("behind"), F.array().cast(f"array<struct<n:{kind},end:int>>").alias("ends"))
    found = asked.select(*paragraph, F.explode(F.aggregate("notes", start, find, lambda done: done["ends"])).alias("e")).select(*paragraph, "e.n", "e.end")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("para", "n"))
    numbered = found.withColumn("number", number)
    end = F.col("end")
    inside = (end > F.col("start")) & (end <= F.col("stop"))
    hosts = numbered.join(kept, paragraph).filter(F.when(end > 0, inside).when(end == 0, F.col("last")).otherwise(F.col("first")))
    at = F.when(end > 0, offset_behind(F.col("content"), end - F.col("start"))).when(end == 0, F.length("content")).otherwise(0)
    return hosts.select(*paragraph, "n", "number", "ord", at.cast("int").alias("at"))


def with_notes(segments: DataFrame, notes: DataFrame) -> DataFrame:
    """segments with their marks [number], and the notes as segments (footnote true) behind their paragraph: doc_id, para, k, ord, content, footnote.

    ``k`` is 0 for segments and counts a paragraph's notes.  Of marks at one
    place the later note's comes first; a mark at a beginning has a space behind it.
    """
    placed = place_notes(segments, notes).join(notes.select("doc_id", "para", "n", F.coalesce("anchor", F.lit("")).alias("anchor"), "text"), ["doc_id", "para", "n"])
    mark = F.concat(F.lit("["), F.col("number").cast("string"), F.lit("]"))
    marks = placed.groupBy("doc_id", "para", "ord").agg(F.array_sort(F.collect_list(F.struct("at", (-F.col("number")).alias("later"), F.when(F.col("anchor") == "", F.concat(mark, F.lit(" "))).otherwise(mark).alias("mark")))).alias("marks"))
    host = segments.select("doc_id", "para", "ord", "content").join(marks, ["doc_id", "para", "ord"], "left")
    start = F.struct(F.lit(0).alias("from"), F.lit("").alias("text"))
    step = lambda done, m: F.struct(m["at"].alias("from"), F.concat(done["text"], F.substring(F.col("content"), done["from"] + 1, m["at"] - done["from"]), m["mark"]).alias("text"))
    marked = F.aggregate("marks", start, step, lambda done: F.concat(done["text"], F.substring(F.col("content"), done["from"] + 1, F.length("content"))))
    w = Window.partitionBy("doc_id", "para").orderBy("n")
    behind = placed.select("doc_id", "para", F.row_number().over(w).alias("k"), F.lit(0).alias("ord"), F.concat(mark, F.lit(" "), F.coalesce("text", F.lit(""))).alias("content"), F.lit(True).alias("footnote"))
    return host.select("doc_id", "para", F.lit(0).alias("k"), F.col("ord").cast("int").alias("ord"), F.coalesce(marked, "content").alias("content"), F.lit(False).alias("footnote")).unionByName(behind)


def aligned_windows(queries: DataFrame, corpus: DataFrame, key: list[str], least: float = ALIKE, similarity: Callable[[Column, Column], Column] = ratio_udf, unlike: float = 100.0) -> DataFrame:
    """(key, start, n_words, score): the window of the corpus that best fits each query's words, if their mean similarity is ``least`` or more.

    queries(key, group, words) and corpus(group, words), one row for each group,
    with arrays of normal forms.  Equal words of a query and its group lie on
    diagonals; only windows on a diagonal with an equal word are scored, word by
    word.  A window that has none is not found.  Of equal scores the first
    window wins.  Empty queries, and groups shorter than a query, give nothing.

    ``unlike`` is the most that ``similarity`` gives two different words.  It
    bounds how many words of a window may differ: one word more than that, the
    rarest of the group, are looked up, as one of them must be equal.  Null words
    are like none.  A key is one query's.
    """
    # A group's words and its queries are shuffled once, as they are; places of words are found where both have come together.
    sized = queries.select(*key, "group", "words").filter(F.size("words") > 0)
    salts = (sized.groupBy("group").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) // ASKED + 1
    salt = [F.pmod(F.xxhash64(*key), F.lit(salts)).alias("salt")] if salts > 1 else []
    asked = sized.groupBy("group", *salt).agg(F.collect_list(F.struct(F.struct(*key).alias("key"), "words")).alias("asked"))
    both = asked.join(corpus.select("group", F.col("words").alias("canon")), "group").select("asked", "canon")
    kinds = sized.select(F.struct(*key).alias("key")).schema[0].dataType.simpleString()
    found = both.mapInArrow(_windows(least, unlike), f"key {kinds}, start int, m int, equal int, words array<string>, said array<string>")
    windows = found.select(*(F.col(f"key.{k}").alias(k) for k in key), "start", "m", "equal", "words", "said")
    if unlike <= 0:
        scored = windows.select(*key, "start", "m", (F.col("equal") * 100.0 / F.col("m")).alias("score"))
    else:
        pairs = windows.select(*key, "start", "m", F.explode(F.arrays_zip(F.col("words").alias("word"), F.col("said").alias("other"))).alias("p")).select(*key, "start", "m", "p.word", "p.other")
        # Similarity is worked out once for a pair of words.
        unequal = pairs.filter("word <> other").select("word", "other").distinct().withColumn("alike", similarity(F.col("word"), F.col("other")))
        scored = pairs.join(unequal, ["word", "other"], "left").groupBy(*key, "start", "m").agg((F.sum(F.when(F.col("word") == F.col("other"), 100.0).otherwise(F.coalesce("alike", F.lit(0.0)))) / F.col("m")).alias("score"))
    best = scored.groupBy(*key, F.col("m").alias("n_words")).agg(F.max(F.struct("score", (-F.col("start")).alias("back"))).alias("b"))
    return best.select(*key, (-F.col("b.back")).alias("start"), "n_words", "b.score").filter(F.col("score") >= least)


def _runs(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[i] .. first[i] + n[i] - 1, one behind the other."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _windows(least: float, unlike: float):
    """Of rows (asked(key, words), canon) the windows that may score ``least``: (key, start, m, equal, words, said), with the words of both."""

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        asked, canon = batch.column(0), batch.column(1)
        queries = asked.flatten()
        words = queries.field("words")
        m, size = (pc.list_value_length(x).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (words, canon))
        row = np.repeat(np.arange(len(batch)), pc.list_value_length(asked).to_numpy(zero_copy_only=False))
        said = canon.flatten()
        # Words as numbers; -1 is null, which is like none.
        number = pa.concat_arrays([words.flatten(), said]).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        mine, theirs = number[: m.sum()], number[m.sum() :]
        first, begin = np.cumsum(m) - m, np.cumsum(size) - size
        known = int(number.max(initial=0)) + 1
        keys = np.where(theirs >= 0, np.repeat(np.arange(len(batch)), size) * known + theirs, -1)
        order = np.argsort(keys, kind="stable")
        # How often each word of a query stands in its group, and where.
        query = np.repeat(np.arange(len(m)), m)
        at = np.arange(len(mine)) - np.repeat(first, m)
        wanted = np.where(mine >= 0, row[query] * known + mine, -2)
        lo = np.searchsorted(keys[order], wanted, "left")
        often = np.searchsorted(keys[order], wanted, "right") - lo
        # A little more may differ than the quotient says, as it is rounded.
        differ = np.floor(m * ((100.0 - least) / (100.0 - unlike)) + 1e-6).astype(np.int64) if unlike < least else m
        by = np.lexsort((at, often, query))
        rare = np.sort(by[np.arange(len(by)) - np.repeat(first, m) <= np.repeat(differ, m)])
        place = order[_runs(lo[rare], often[rare])]
        owner = np.repeat(query[rare], often[rare])
        start = place - begin[row[owner]] - np.repeat(at[rare], often[rare])
        fits = (start >= 0) & (start + m[owner] <= size[row[owner]])
        owner, start = np.unique(np.stack([owner[fits], start[fits]]), axis=1) if fits.any() else (owner[:0], start[:0])
        # Windows are compared number by number; the others could not reach the score.
        a, b, n = _runs(first[owner], m[owner]), _runs(begin[row[owner]] + start, m[owner]), m[owner]
        equal = np.bincount(np.repeat(np.arange(len(owner)), n)[(mine[a] == theirs[b]) & (mine[a] >= 0)], minlength=len(owner))
        may = (100.0 * equal + max(unlike, 0.0) * (n - equal)) >= (least - 1e-6) * n
        owner, start, equal, n = owner[may], start[may], equal[may], n[may]
        offsets = pa.array(np.append(0, np.cumsum(n)), pa.int32())
        there = pa.ListArray.from_arrays(offsets, said.take(pa.array(_runs(begin[row[owner]] + start, n))))
        ints = (pa.array(x, pa.int32()) for x in (start, n, equal))
        return pa.RecordBatch.from_arrays([queries.field("key").take(pa.array(owner)), *ints, words.take(pa.array(owner)), there], names=["key", "start", "m", "equal", "words", "said"])

    def run(batches):
        for batch in batches:
            # Some rows at a time, by the words of their groups and queries.
            size = pc.list_value_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False) + 8 * pc.list_value_length(batch.column(0)).to_numpy(zero_copy_only=False)
            part = (np.cumsum(size) - size) // AT_ONCE
            bounds = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)) if len(part) else []
            for lo, hi in zip(bounds, bounds[1:]):
                yield find(batch.slice(lo, hi - lo))

    return run
