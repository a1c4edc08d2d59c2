"""File sources: Office documents, sheets, CSV and JSON, with the checks that imports make.

``binaryFile`` reads the files on executors; zip and XML are parsed there with
the standard library.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Signatures, styles and marks of the formats.
OLE2 = "D0CF11E0A1B11AE1"
INDEX_STYLE = re.compile("index|toc|contents|فهرس", re.I)
FRONT_OPENING = re.compile("بسم الله الرحمن الرحيم|الحمد لله|اما بعد")
HEAD_WORDS, BOLD_SHARE, ANCHOR_CHARS = 14, 0.6, 16
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
PARAGRAPHS = "array<struct<para:int,text:string,heading:boolean,level:int,styled:boolean,quoted:boolean,cover:boolean,footnotes:array<struct<anchor:string,text:string>>,verses:array<string>>>"


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def diagnosis(content: Column) -> Column:
    """What a file is by its first bytes: legacy (old binary Office), package, or other."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head == OLE2, "legacy").when(head.startswith("504B"), "package").otherwise("other")


def keyed_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, key, content) of files whose name matches the pattern's one group, sorted by key."""
    name = F.regexp_extract("path", "([^/]+)$", 1)
    key = F.lower(F.regexp_extract(name, pattern, 1))
    return files(spark, path).select("path", key.alias("key"), "content").filter("key <> ''").orderBy("key")


def newest(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """The file whose name sorts last."""
    return files(spark, path, glob).agg(F.max_by(F.struct("path", "content"), "path").alias("f")).select("f.*").filter("path is not null")


def glyphs(ranges: DataFrame) -> DataFrame:
    """(font, char, letter) of glyph ranges (font, first, last, letter) with hexadecimal bounds."""
    codes = F.sequence(F.conv("first", 16, 10).cast("int"), F.conv("last", 16, 10).cast("int"))
    return ranges.select(F.lower("font").alias("font"), F.explode(codes).alias("c"), "letter").select("font", F.concat(F.lit("F0"), F.lpad(F.hex("c"), 2, "0")).alias("char"), "letter")


class Reader:
    """Text of a paragraph in page order; glyphs gather into words, which are turned to reading order."""

    def __init__(self, letters: dict[tuple[str, str], str], marks: bool = False):
        self.letters, self.marks = letters, marks
        self.out: list[str] = []
        self.word: list[str] = []
        self.verses: list[list[str]] = []
        self.open = False

    def end_word(self) -> None:
        if self.word:
            word = "".join(reversed(self.word))
            self.word = []
            self.out.append(word)
            if not self.open:
                self.verses.append([])
            self.verses[-1].append(word)
            self.open = True

    def add(self, text: str) -> None:
        self.end_word()
        self.out.append(text)
        self.open = self.open and not text.strip()

    def read(self, element) -> Reader:
        for child in element:
            tag = child.tag.removeprefix(W)
            if tag == "t":
                self.add(child.text or "")
            elif tag in ("tab", "br", "cr", "noBreakHyphen"):
                self.add({"tab": "\t", "noBreakHyphen": "-"}.get(tag, "\n"))
            elif tag == "footnoteReference":
                if self.marks:
                    self.add(f"\x02{child.get(W + 'id')}\x03")
            elif tag == "sym":
                letter = self.letters.get(((child.get(W + "font") or "").lower(), (child.get(W + "char") or "").upper()))
                if letter:
                    self.word.append(letter)
            elif tag in ("r", "hyperlink", "ins", "smartTag", "sdt", "sdtContent", "fldSimple"):
                self.read(child)
        return self

    def text(self) -> str:
        self.end_word()
        return "".join(self.out)


def docx_paragraphs(content: bytes, letters: dict[tuple[str, str], str] | None = None, clean: Callable[[str], str] = str.strip, drop_front: bool = True) -> list[dict]:
    """Paragraphs of a document: index entries and front matter left out, headings by style or else by looks."""
    letters = letters or {}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        body = ElementTree.fromstring(z.read("word/document.xml")).find(W + "body")
        notes = _notes(z.read("word/footnotes.xml"), letters) if "word/footnotes.xml" in names else {}
        styles = _styles(z.read("word/styles.xml")) if "word/styles.xml" in names else {}
    cover = _cover(body, letters, clean)
    out: list[dict] = []
    for p in [c for c in body if c.tag == W + "p"]:
        text = clean(Reader(letters).read(p).text())
        if not text:
            continue
        style = _style(p, styles)
        if INDEX_STYLE.search(style):
            if out and out[-1]["heading"]:
                out[-1]["index"] = True
            continue
        heading = "heading" in style or style == "title"
        digits = re.findall(r"\d", style)
        row = {"text": text, "heading": heading, "level": (min(int(digits[0]), 3) if digits else 1) if heading else 0, "looks": _looks_like_heading(p, text), "styled": True, "quoted": False, "cover": False}
        row["footnotes"] = _anchored(p, notes, letters, clean) if notes else []
        reader = Reader(letters).read(p)
        reader.end_word()
        row["verses"] = [" ".join(v) for v in reader.verses]
        out.append(row)
    out = [r for r in out if not r.get("index")]
    if not any(r["heading"] for r in out):
        for r in out:
            r["heading"], r["level"] = r["looks"], int(r["looks"])
    if not any(r["heading"] for r in out):
        for r in out:
            r["styled"] = False
    elif drop_front:
        from ..functions.plain import normalize

        first = next(i for i, r in enumerate(out) if r["heading"])
        if not any(FRONT_OPENING.search(normalize(r["text"])) for r in out[:first]):
            out = out[first:]
    for r in out:
        if r["heading"]:
            r["text"] = re.sub(r"^\s*\d+\s*[.\-–—)]\s*", "", r["text"]) or r["text"]
    return [{k: r.get(k) for k in ("text", "heading", "level", "styled", "quoted", "cover", "footnotes", "verses")} | {"para": i} for i, r in enumerate(cover + out, 1)]


def _styles(xml: bytes) -> dict[str, str]:
    return {s.get(W + "styleId"): (s.find(W + "name").get(W + "val") if s.find(W + "name") is not None else "") for s in ElementTree.fromstring(xml).iter(W + "style")}


def _style(p, styles: dict[str, str]) -> str:
    found = p.find(f"{W}pPr/{W}pStyle")
    key = found.get(W + "val") if found is not None else ""
    return (styles.get(key) or key or "").lower()


def _looks_like_heading(p, text: str) -> bool:
    """Short, without quotation brackets, and mostly bold or centred."""
    if any(c in text for c in "﴿{«»﴾") or len(text.split()) > HEAD_WORDS:
        return False
    runs = [r for r in p.iter(W + "r") if "".join(t.text or "" for t in r.iter(W + "t")).strip()]
    bold = sum((b := r.find(f"{W}rPr/{W}b")) is not None and b.get(W + "val") not in ("0", "false") for r in runs)
    centred = p.find(f"{W}pPr/{W}jc")
    return bool(runs) and (bold / len(runs) >= BOLD_SHARE or centred is not None and centred.get(W + "val") == "center")


def _cover(body, letters, clean) -> list[dict]:
    """A small table before all else: its first line is the title, the rest one paragraph."""
    first = next((c for c in body if c.tag in (W + "p", W + "tbl")), None)
    if first is None or first.tag != W + "tbl":
        return []
    cells = list(first.iter(W + "tc"))
    lines = list(dict.fromkeys(t for c in cells for p in c.iter(W + "p") if (t := clean(Reader(letters).read(p).text()))))
    if not lines or len(cells) > 10 or sum(len(t.split()) for t in lines) > 40:
        return []
    make = lambda text, heading: {"text": text, "heading": heading, "level": int(heading), "styled": True, "quoted": False, "cover": True, "footnotes": [], "verses": []}
    return [make(lines[0], True)] + ([make(" ".join(lines[1:]), False)] if lines[1:] else [])


def _notes(xml: bytes, letters) -> dict[str, str]:
    out = {}
    for note in ElementTree.fromstring(xml).iter(W + "footnote"):
        text = " ".join(" ".join(Reader(letters).read(p).text() for p in note.iter(W + "p")).split())
        out[note.get(W + "id")] = re.sub(r"\s*\(\s*\)", "", text, count=1).strip()
    return out


def _anchored(p, notes: dict[str, str], letters, clean) -> list[dict]:
    """Each note of a paragraph with the last letters before its mark."""
    text, out = Reader(letters, marks=True).read(p).text(), []
    for m in re.finditer("\x02([^\x03]*)\x03", text):
        note = clean(notes.get(m[1], ""))
        if note:
            before = clean(re.sub("\x02[^\x03]*\x03", "", text[: m.start()])).rstrip(" ( ")
            before = re.sub(r"\s*\(\s*\)", "", before)
            out.append({"anchor": "".join(c for c in before if not c.isspace() and c not in "«»")[-ANCHOR_CHARS:], "text": note})
    return out


def read_docx(spark: SparkSession, path: str, letters: dict | None = None, drop_front: bool = True) -> DataFrame:
    """(path, para, text, ...) of the documents under a path; unreadable files are left to :func:`diagnosis`."""

    @F.pandas_udf(PARAGRAPHS)
    def parse(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: docx_paragraphs(bytes(c), letters, drop_front=drop_front))

    packages = files(spark, path, "*.docx").filter(diagnosis(F.col("content")) == "package")
    return packages.select("path", F.explode(parse("content")).alias("p")).select("path", "p.*")


def sheet_rows(content: bytes) -> list[list[str | None]]:
    """Cells of the first sheet as text, row by row; empty cells are null, empty rows are dropped."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(S + "t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(S + "si")]
        first = min(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
        rows = []
        for row in ElementTree.fromstring(z.read(first)).iter(S + "row"):
            cells: dict[int, str | None] = {}
            for n, c in enumerate(row.iter(S + "c")):
                at = re.match(r"[A-Z]+", c.get("r") or "")
                col = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(at[0]))) - 1 if at else n
                value = c.find(S + "v")
                if c.get("t") == "inlineStr":
                    cells[col] = "".join(t.text or "" for t in c.iter(S + "t"))
                elif value is not None:
                    cells[col] = shared[int(value.text)] if c.get("t") == "s" else value.text
            if any(v is not None for v in cells.values()):
                rows.append([cells.get(i) for i in range(max(cells) + 1)])
    return rows


def read_sheet(spark: SparkSession, path: str, required: list[str], glob: str = "*.xlsx") -> DataFrame:
    """(path, and each required column) of the first sheets under a path; names come from the first row, in lower case and trimmed.

    A sheet without a required column fails the read.
    """
    kind = "array<map<string,string>>"

    @F.pandas_udf(kind)
    def parse(contents: pd.Series) -> pd.Series:
        def one(content) -> list[dict]:
            rows = sheet_rows(bytes(content))
            header = [str(h).strip().lower() if h is not None else None for h in rows[0]] if rows else []
            missing = [c for c in required if c not in header]
            if missing:
                raise ValueError(f"the sheet lacks {', '.join(missing)}")
            return [{c: (str(r[i]).strip() if i < len(r) and r[i] is not None else "") for c in required for i in [header.index(c)]} for r in rows[1:]]

        return contents.map(one)

    return files(spark, path, glob).select("path", F.explode(parse("content")).alias("r")).select("path", *(F.col("r")[c].alias(c) for c in required))


def to_int(value: Column) -> Column:
    return F.trim(value).try_cast("int")


def read_csv(spark: SparkSession, path: str, required: list[str], longest: int = 10 << 20) -> DataFrame:
    """A CSV with a header, quoted line breaks and long fields; required columns are checked, a lone ``-`` counts as empty."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("maxCharsPerColumn", longest).csv(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"the file lacks {', '.join(missing)}")
    clean = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) == "-", "").otherwise(F.trim(F.coalesce(c, F.lit(""))))
    return df.select(*(clean(F.col(c)).alias(c) for c in required))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of objects under an explicit schema; a malformed file fails the read."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def promised_counts(records: DataFrame, promised: DataFrame, group: str) -> DataFrame:
    """Groups whose number of records is not the one that the source promised (group, n)."""
    counted = records.groupBy(group).agg(F.count(F.lit(1)).alias("got"))
    return promised.join(counted, group, "left").filter(~F.col("n").eqNullSafe(F.coalesce("got", F.lit(0)))).select(group, "n", F.coalesce("got", F.lit(0)).alias("got"))
