"""Workbooks as a sink: one file for each group of rows, built on executors with the standard library."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame

_NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"


def _column(n: int) -> str:
    out = ""
    while True:
        out = chr(65 + n % 26) + out
        n = n // 26 - 1
        if n < 0:
            return out


def _cell(value, place: str) -> str:
    if value is None or value != value:
        return ""
    if isinstance(value, bool):
        return f'<c r="{place}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{place}"><v>{value}</v></c>'
    return f'<c r="{place}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def workbook(sheets: dict[str, list[list]], right_to_left: bool = True) -> bytes:
    """An xlsx file of the sheets, each a list of rows of which the first is the header, frozen."""
    out = io.BytesIO()
    names = list(sheets)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_NS}" xmlns:r="{_REL}"><sheets>' + "".join(f'<sheet name="{escape(n[:31])}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        for i, name in enumerate(names, 1):
            rows = "".join(f'<row r="{r}">' + "".join(_cell(v, f"{_column(c)}{r}") for c, v in enumerate(row)) + "</row>" for r, row in enumerate(sheets[name], 1))
            view = f'<sheetViews><sheetView workbookViewId="0" rightToLeft="{int(right_to_left)}"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{_NS}">{view}<sheetData>{rows}</sheetData></worksheet>')
    return out.getvalue()


def books(rows: DataFrame, key: str, order: list[str], columns: dict[str, str], sheet: str = "rows") -> DataFrame:
    """(key, content): a workbook of each key's rows in order; columns maps names to headers.

    A key's rows, those of one document, are built into a file in one task.
    """

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        table = [list(columns.values())] + frame.sort_values(order)[list(columns)].astype(object).where(lambda x: x.notna(), None).values.tolist()
        return pd.DataFrame({key: [frame[key].iloc[0]], "content": [workbook({sheet: table})]})

    kind = dict(rows.dtypes)[key]
    return rows.select(key, *(c for c in dict.fromkeys([*order, *columns]) if c != key)).groupBy(key).applyInPandas(build, f"{key} {kind}, content binary")


def audit_book(rows: list[list], findings: list[list], statistics: list[list], taxonomy: list[list]) -> bytes:
    """The audit's four sheets in one file."""
    return workbook({"translations": rows, "findings": findings, "statistics": statistics, "taxonomy": taxonomy})
