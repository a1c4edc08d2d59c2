"""Segmentation: texts to paragraphs, paragraphs to units, units to finer rows."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Quotation signs, sentence ends and the patterns of the splitter.
PAIRS = {"﴿": "﴾", "«": "»", "(": ")", "“": "”", '"': '"'}
OPENERS = frozenset("﴿«“\"")
STOPS = frozenset(".!؟?\n")
ONLY_MARKS = re.compile(r"[\s.،,؛;:!؟?]+")
INITIAL = re.compile(r"(?:^|\s)\S\.$")
TAIL_REFERENCE = re.compile(r"(?<=\S)\s*(\[[^\]]{2,40}\]\s*[.،]?)\s*$")
QUOTE_THEN_STOP = re.compile(r"[»”]\s*[.!؟?]+(?=\s+\S)")
HEAD_NUMBER = "(?U)^\\s*\\d+\\s*[.\\-–—)]\\s*"
MD_HEAD = "(?U)^(#{1,6})\\s+(.+?)\\s*#*$"
MD_STRONG = "(?U)^(?:\\*\\*|__)(.+?)(?:\\*\\*|__)[\\s.:：]*$"
MD_QUOTE = "(?U)^>+\\s?"
MD_INLINE = "(?U)\\*\\*|__|(?<![A-Za-z0-9])\\*(?!\\s)"
STRONG_WORDS = 10
LEADIN = (
    "(?U)(?:^|(?<=[.!؟»)\\]]))\\s*((?:\\S+\\s+){0,3}?(?:و|ف)?(?:قال|يقول|قوله|بقوله|لقوله|كقوله)\\s+"
    "(?:اللهُ?\\s+|النبيُّ?\\s+|رسولُ?\\s+اللهِ?\\s+)?(?:تعالى|تعالي|سبحانه|عز\\s+وجل|ﷺ|صلى\\s+الله\\s+عليه\\s+وسلم)?\\s*[:：])\\s*$"
)

PARAGRAPH = "doc_id {kind}, para int, text string, heading boolean, level int, styled boolean, quoted boolean"


def paragraphs(raw: DataFrame) -> DataFrame:
    """(doc_id, para, text, heading, level, styled, quoted) of plain or Markdown texts (doc_id, text).

    Lines of noise are dropped; ``>`` quotes, ``#`` headings and short bold lines
    are recognised; para counts what is left, from 1.
    """
    lines = F.transform(F.split(T.expand_ligatures(F.col("text")), "\\n"), lambda x: T.clean_noise(T.strip(x)))
    rows = raw.select("doc_id", F.posexplode(lines).alias("pos", "line")).filter("line <> ''")
    quoted = F.col("line").rlike(MD_QUOTE)
    rows = rows.withColumn("quoted", quoted).withColumn("line", F.when(quoted, T.strip(T.replace(F.col("line"), MD_QUOTE))).otherwise(F.col("line"))).filter("line <> ''")
    marks, titled = F.regexp_extract("line", MD_HEAD, 1), F.regexp_extract("line", MD_HEAD, 2)
    hashed = ~F.col("quoted") & F.col("line").rlike(MD_HEAD)
    bold = F.col("line").rlike(MD_STRONG)
    body = T.strip(T.replace(F.when(hashed, titled).when(bold, F.regexp_extract("line", MD_STRONG, 1)).otherwise(F.col("line")), MD_INLINE))
    rows = rows.select("doc_id", "pos", "quoted", hashed.alias("hashed"), bold.alias("bold"), F.length(marks).alias("marks"), body.alias("body")).filter("body <> '' or hashed")
    short = F.col("bold") & ~F.col("quoted") & ~F.col("hashed") & (F.size(T.words(F.col("body"))) <= STRONG_WORDS) & ~F.col("body").endswith(".")
    heading = F.col("hashed") | short
    bare = T.replace(F.col("body"), HEAD_NUMBER)
    shown = F.when(heading & (bare != ""), bare).otherwise(F.col("body"))
    level = F.when(F.col("hashed"), F.least("marks", F.lit(3))).when(short, 2).otherwise(0)
    from pyspark.sql import Window

    para = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    return rows.select("doc_id", para.alias("para"), shown.alias("text"), heading.alias("heading"), level.alias("level"), F.lit(False).alias("styled"), "quoted")


def split_by_rules(text: str) -> list[str]:
    """Units of a paragraph.

    Quotations nest and are never cut inside; verse brackets and quotation marks
    begin a unit; a colon ends one only before a quotation or at the end; initials
    and dots in a row do not.
    """
    units: list[str] = []
    closers: list[str] = []
    start = 0

    def take(stop: int) -> None:
        nonlocal start
        unit = text[start:stop].strip()
        if unit:
            units.append(unit)
        start = stop

    for i, c in enumerate(text):
        if closers and c == closers[-1]:
            closers.pop()
        elif c in PAIRS:
            if not closers and c in OPENERS:
                take(i)
            closers.append(PAIRS[c])
        elif not closers and (c in STOPS or c == ":"):
            so_far = text[start : i + 1].strip()
            if c == "." and (INITIAL.search(so_far) or text[i + 1 : i + 2] == "." or so_far.endswith("..")):
                continue
            rest = text[i + 1 :].lstrip() if c == ":" else ""
            if c == ":" and rest and rest[0] not in PAIRS:
                continue
            take(i + 1)
    take(len(text))
    merged: list[str] = []
    for unit in units:
        if ONLY_MARKS.fullmatch(unit) and merged:
            merged[-1] += unit
        elif bare := unit.lstrip("،, "):
            merged.append(bare)
    return [piece for unit in merged for piece in _reference_apart(unit)]


def _reference_apart(unit: str) -> list[str]:
    """A bracketed reference at the end stands alone if three words precede it."""
    found = TAIL_REFERENCE.search(unit)
    head = unit[: found.start()].strip() if found else ""
    return [head, found[1].strip()] if len(head.split()) >= 3 else [unit]


def after_closed_quotes(units: list[str]) -> list[str]:
    """A closed quotation and a stop end a sentence, whatever a learned splitter says."""
    out = []
    for unit in units:
        cuts = [0, *(m.end() for m in QUOTE_THEN_STOP.finditer(unit)), len(unit)]
        out += [p for a, b in zip(cuts, cuts[1:]) if (p := unit[a:b].strip())]
    return out


def leading_commas_back(units: list[str]) -> list[str]:
    """Commas at a unit's head go to the end of the unit before."""
    out: list[str] = []
    for unit in units:
        lead = unit.lstrip()
        rest = lead.lstrip("،, ")
        if out and rest and rest != lead:
            out[-1] = out[-1].rstrip() + lead[: len(lead) - len(rest)].rstrip()
            unit = rest
        out.append(unit)
    return out


def reconstructs(text: str, units: list[str]) -> bool:
    """Do the units hold every character of the text, white space aside?"""
    return "".join("".join(units).split()) == "".join(text.split())


def split_units(text: str | None, learned=None) -> list[str]:
    """By a learned splitter if there is one, else by rules, else whole; a split that loses characters is not taken."""
    if not text or not text.strip():
        return []
    if learned is not None:
        units = learned(text)
        units = after_closed_quotes(leading_commas_back(units)) if units else []
        if units and reconstructs(text, units):
            return units
    units = split_by_rules(text)
    return units if units and reconstructs(text, units) else [text.strip()]


def units(paras: DataFrame, learned=None) -> DataFrame:
    """(.., ord, unit): the units of each paragraph that is no heading; a heading is one unit."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_units(t, learned))

    pieces = F.when(F.col("heading"), F.array("text")).otherwise(split("text"))
    kept = [c for c in paras.columns if c != "text"]
    return paras.select(*kept, F.posexplode(pieces).alias("pos", "unit")).select(*kept, (F.col("pos") + 1).alias("ord"), "unit")


def reconstruction_failures(paras: DataFrame, split: DataFrame) -> DataFrame:
    """Paragraphs whose units do not give their text back: must be empty."""
    bare = lambda c: T.replace(c, "(?U)\\s+")
    joined = split.groupBy("doc_id", "para").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "unit"))), lambda x: x["unit"]), "").alias("whole"))
    return paras.join(joined, ["doc_id", "para"]).filter(bare(F.col("text")) != bare(F.col("whole"))).select("doc_id", "para")


def renumber(segments: DataFrame) -> DataFrame:
    """ord dense from 1 in each paragraph, after rows were cut or dropped; needs ord and part."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id", "para").orderBy("ord", "part")
    return segments.withColumn("ord", F.row_number().over(w)).drop("part")


def split_trailing_leadins(segments: DataFrame) -> DataFrame:
    """A lead-in that ends a unit of prose becomes an attribution of its own."""
    prose = F.col("kind").isin("text", "term")
    lead = F.when(prose, F.regexp_extract("content", LEADIN, 1)).otherwise("")
    head = T.strip(T.replace(F.col("content"), LEADIN))
    cut = segments.withColumns({"__lead": T.strip(lead), "__head": head})
    whole = F.struct(F.lit(0).alias("part"), F.col("kind").alias("kind"), F.col("content").alias("content"), F.col("note").alias("note"))
    first = F.struct(F.lit(0).alias("part"), F.col("kind").alias("kind"), F.col("__head").alias("content"), F.col("note").alias("note"))
    second = F.struct(F.lit(1).alias("part"), F.lit("attribution").alias("kind"), F.col("__lead").alias("content"), F.lit("lead-in").alias("note"))
    parts = F.when(F.col("__lead") == "", F.array(whole)).when(F.col("__head") == "", F.array(second)).otherwise(F.array(first, second))
    kept = [c for c in segments.columns if c not in ("kind", "content", "note")]
    exploded = cut.select(*kept, F.explode(parts).alias("p")).select(*kept, "p.part", "p.kind", "p.content", "p.note")
    if "terms" in segments.columns:
        exploded = exploded.withColumn("terms", F.when(F.col("note") == "lead-in", F.slice("terms", 1, 0)).otherwise(F.col("terms")))
    return renumber(exploded).select(*segments.columns)


def drop_empty_brackets(segments: DataFrame) -> DataFrame:
    """``()`` goes; a segment in which no word is left goes with it."""
    marked = F.replace(F.col("content"), F.lit(" ")).contains("()")
    bare = F.when(marked, T.strip(T.replace(F.col("content"), "(?U)\\s*\\(\\s*\\)"))).otherwise(F.col("content"))
    return segments.withColumns({"__m": marked, "content": bare}).filter(~F.col("__m") | F.col("content").rlike("(?U)\\w")).drop("__m")


def apply_cuts(text: str, openings: list[str]) -> list[str]:
    """Cut a text where each opening first occurs after the one before; openings that do not occur are passed over."""
    at, out, start = 0, [], 0
    for opening in openings:
        found = text.find(opening, at)
        if found < 0 or not opening:
            continue
        if text[start:found].strip():
            out.append(text[start:found].strip())
            start = found
        at = found + len(opening)
    if text[start:].strip():
        out.append(text[start:].strip())
    return out


def apply_merges(pieces: list[str], boundaries: list[int]) -> list[str]:
    """Join each piece with the next at the given boundaries (0 is between the first two)."""
    out: list[str] = []
    for i, piece in enumerate(pieces):
        if i and i - 1 in boundaries:
            out[-1] = f"{out[-1]} {piece}"
        else:
            out.append(piece)
    return out


def tag_spans(tags: Column) -> Column:
    """Runs of one tag other than ``text``: (start, stop, tag), stop exclusive."""
    fresh = F.array().cast("array<struct<start:int,stop:int,tag:string>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        grows = (F.size(acc) > 0) & (last["tag"] == x["tag"]) & (last["stop"] == x["i"])
        one = F.struct(x["i"].alias("start"), (x["i"] + 1).alias("stop"), x["tag"].alias("tag"))
        longer = F.struct(last["start"].alias("start"), (x["i"] + 1).alias("stop"), last["tag"].alias("tag"))
        return F.when(x["tag"] == "text", acc).when(grows, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(acc, F.array(one)))

    return F.aggregate(F.transform(tags, lambda t, i: F.struct(i.alias("i"), t.alias("tag"))), fresh, step)
