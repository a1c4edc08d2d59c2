"""Office files as tables: ``spark.read.format("glosstream_docx" | "glosstream_xlsx")`` and a sink of workbooks.

Spark's interface for data sources in Python: a schema known before any file is
opened, a partition for each file, and a writer whose files appear together
when all tasks are done.  Paths are those that all executors see; files in a
store that only Spark reads go through :mod:`files`, which parses ``binaryFile``
with the same functions.
"""

from __future__ import annotations

import fnmatch
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

from pyspark import TaskContext
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StringType, StructType

from .books import workbook
from .files import docx_paragraphs, sheet_rows

DOCX_SCHEMA = "path string, para int, text string, heading boolean, level int, styled boolean, quoted boolean, cover boolean, footnotes array<struct<anchor:string,text:string>>, verses array<string>"
STAGE = "_temporary"


def local(path: str) -> str:
    """A path or ``file:`` address as the file system has it."""
    address = urlparse(path)
    if address.scheme not in ("", "file"):
        raise ValueError(f"{path}: this source reads mounted folders; use glosstream.sources.files for other stores")
    return unquote(address.path) if address.scheme else path


@dataclass
class FilePartition(InputPartition):
    """One file."""

    path: str


class FilesReader(DataSourceReader):
    """A partition for each file of the folder whose name fits, in order of their names."""

    def __init__(self, options: dict, glob: str):
        if "path" not in options:
            raise ValueError("a path is needed")
        self.path, self.glob = local(options["path"]), options.get("pathGlobFilter", glob)

    def partitions(self) -> list[FilePartition]:
        if os.path.isfile(self.path):
            return [FilePartition(self.path)]
        names = sorted(n for n in os.listdir(self.path) if fnmatch.fnmatch(n, self.glob) and not n.startswith(("_", ".")))
        return [FilePartition(os.path.join(self.path, n)) for n in names]

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        if not isinstance(partition, FilePartition):
            return  # an empty folder
        with open(partition.path, "rb") as f:
            yield from self.rows(partition.path, f.read())

    def rows(self, path: str, content: bytes) -> Iterator[tuple]:
        raise NotImplementedError


class DocxSource(DataSource):
    """Paragraphs of word processor files: headings, levels, notes.  ``dropFront=false`` keeps what stands before the first heading.

    A file that is no package (see ``files.diagnosis``) fails the read, or is
    left out with ``mode=DROPMALFORMED``.
    """

    @classmethod
    def name(cls) -> str:
        return "glosstream_docx"

    def schema(self) -> str:
        return DOCX_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return DocxReader(dict(self.options), schema)


class DocxReader(FilesReader):
    def __init__(self, options: dict, schema: StructType):
        super().__init__(options, "*.docx")
        self.names = schema.names
        self.front = options.get("dropFront", "true").lower() != "false"
        self.lenient = options.get("mode", "FAILFAST").upper() == "DROPMALFORMED"

    def rows(self, path: str, content: bytes) -> Iterator[tuple]:
        if not content.startswith(b"PK"):
            if self.lenient:
                return
            raise ValueError(f"{path} is no docx package")
        for p in docx_paragraphs(content, drop_front=self.front):
            row = dict(p, path=path, footnotes=[Row(anchor=n["anchor"], text=n["text"]) for n in p["footnotes"] or []], verses=list(p["verses"] or []))
            yield tuple(row[c] for c in self.names)


class XlsxSource(DataSource):
    """The first sheet of workbooks; names come from the first row, in lower case and trimmed.

    Reading needs a schema of string columns, which every sheet must have
    (``path`` is added where the schema names it and no sheet does).  Writing
    makes a workbook for each task, in the order of its rows; mode ``overwrite``
    replaces the workbooks of the folder, ``append`` adds to them.
    """

    @classmethod
    def name(cls) -> str:
        return "glosstream_xlsx"

    def schema(self) -> str:
        raise ValueError("name the columns: spark.read.format('glosstream_xlsx').schema('a string, b string')")

    def reader(self, schema: StructType) -> DataSourceReader:
        odd = [f.name for f in schema.fields if not isinstance(f.dataType, StringType)]
        if odd:
            raise ValueError(f"cells are read as strings: {', '.join(odd)}")
        return XlsxReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return XlsxWriter(dict(self.options), schema, overwrite)


class XlsxReader(FilesReader):
    def __init__(self, options: dict, schema: StructType):
        super().__init__(options, "*.xlsx")
        self.names = schema.names

    def rows(self, path: str, content: bytes) -> Iterator[tuple]:
        table = sheet_rows(content)
        header = [str(h).strip().lower() if h is not None else None for h in table[0]] if table else []
        missing = [n for n in self.names if n.lower() not in header and n != "path"]
        if missing:
            raise ValueError(f"{path} lacks {', '.join(missing)}")
        places = [header.index(n.lower()) if n.lower() in header else None for n in self.names]
        for row in table[1:]:
            yield tuple(path if at is None else row[at] if at < len(row) else None for at in places)


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote; nothing if it had no rows."""

    name: str | None


class XlsxWriter(DataSourceWriter):
    """Tasks write into a folder of their own job; the files move beside the others when all are there."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        if "path" not in options:
            raise ValueError("a path is needed")
        self.path, self.names, self.overwrite = local(options["path"]), schema.names, overwrite
        self.sheet, self.rtl = options.get("sheet", "rows"), options.get("rightToLeft", "true").lower() != "false"
        self.stage = os.path.join(self.path, STAGE, uuid.uuid4().hex)

    def write(self, rows: Iterator[Row]) -> Written:
        table = [list(r) for r in rows]  # one workbook
        if not table:
            return Written(None)
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{uuid.uuid4().hex}.xlsx"
        os.makedirs(self.stage, exist_ok=True)
        with open(os.path.join(self.stage, name), "wb") as f:
            f.write(workbook({self.sheet: [list(self.names), *table]}, self.rtl))
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        os.makedirs(self.path, exist_ok=True)
        old = [n for n in os.listdir(self.path) if n.endswith(".xlsx")] if self.overwrite else []
        for m in messages:
            if m is not None and m.name:
                os.replace(os.path.join(self.stage, m.name), os.path.join(self.path, m.name))
        for n in old:
            os.remove(os.path.join(self.path, n))
        self._clear()
        open(os.path.join(self.path, "_SUCCESS"), "w").close()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """Files of failed attempts go with the folder of the job."""
        if os.path.isdir(self.stage):
            for n in os.listdir(self.stage):
                os.remove(os.path.join(self.stage, n))
            os.rmdir(self.stage)


def register(spark: SparkSession) -> None:
    """Make both formats known to a session."""
    spark.dataSource.register(DocxSource)
    spark.dataSource.register(XlsxSource)
