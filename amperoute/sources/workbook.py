"""Workbook scan (S4, S5): xlsx files to rows of text, one task per file, no spreadsheet library."""

from __future__ import annotations

import io
import re
import sys
import zipfile
from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Workers need not have this package installed: its functions travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS = "path string, sheet string, row_no bigint, cells map<string,string>"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# Built-in number formats that show a calendar date.
_DATE_FORMATS = (14, 15, 16, 17, 22)


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Style numbers whose cells are calendar dates; durations and clock times stay fractions of a day."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    custom = {}
    for f in root.iter(f"{_MAIN}numFmt"):
        shown = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")).lower()
        custom[int(f.get("numFmtId"))] = "y" in shown or "d" in shown
    formats = root.find(f"{_MAIN}cellXfs")
    numbers = [int(x.get("numFmtId", 0)) for x in formats] if formats is not None else []
    return {i for i, n in enumerate(numbers) if custom.get(n, n in _DATE_FORMATS)}


def _column(reference: str) -> int:
    n = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        n = n * 26 + ord(letter) - 64
    return n


def _cell_text(cell, shared: Sequence[str], dates: set[int]) -> str | None:
    kind = cell.get("t")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
    value = cell.find(f"{_MAIN}v")
    if value is None or value.text is None:
        return None
    if kind == "s":
        return shared[int(value.text)]
    if kind == "b":
        return "true" if value.text == "1" else "false"
    if kind is None and int(cell.get("s", 0)) in dates:
        moment = datetime(1899, 12, 30) + timedelta(seconds=round(float(value.text) * 86400))
        return moment.isoformat(sep=" ")
    return value.text


def _sheet_rows(content: bytes, header_row: int, only: set[str] | None) -> Iterator[tuple[str, int, dict]]:
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si"):
                shared.append("".join(t.text or "" for t in item.iter(f"{_MAIN}t")))
        dates = _date_styles(book)
        links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
        targets = {r.get("Id"): r.get("Target").lstrip("/") for r in links}
        for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            if only is not None and sheet.get("name") not in only:
                continue
            target = targets[sheet.get(_REL)]
            header: dict[int, str] = {}
            with book.open(target if target.startswith("xl/") else f"xl/{target}") as stream:
                for _, row in ElementTree.iterparse(stream):
                    if row.tag != f"{_MAIN}row":
                        continue
                    number = int(row.get("r"))
                    cells = {_column(c.get("r")): _cell_text(c, shared, dates) for c in row.iter(f"{_MAIN}c")}
                    row.clear()
                    if number == header_row:
                        header = {k: v for k, v in cells.items() if v}
                    elif number > header_row and header:
                        yield sheet.get("name"), number, {header[k]: v for k, v in cells.items() if k in header}


def read_workbooks(
    spark: SparkSession, path: str, *, header_row: int = 1, sheets: Sequence[str] | None = None, pattern: str = "*.xlsx"
) -> DataFrame:
    """Rows of all (or the named) sheets as (path, sheet, row_no, cells by header text)."""
    only = set(sheets) if sheets else None

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                rows = []
                for sheet, number, cells in _sheet_rows(content, header_row, only):
                    rows.append((name, sheet, number, cells))
                    if len(rows) == 5000:
                        yield pd.DataFrame(rows, columns=["path", "sheet", "row_no", "cells"])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "sheet", "row_no", "cells"])

    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    )
    return files.select("path", "content").mapInPandas(parse, ROWS)


def as_columns(rows: DataFrame, headers: Sequence[str] | None = None) -> DataFrame:
    """Cells to columns. Without ``headers`` the header texts are looked up first, as schema inference would."""
    if headers is None:
        found = rows.select(F.explode(F.map_keys("cells")).alias("h")).distinct().orderBy("h").collect()
        headers = [r.h for r in found]
    return rows.select(
        "path", "sheet", "row_no", *[F.try_element_at("cells", F.lit(h)).alias(h) for h in headers]
    )


def without_instructions(rows: DataFrame, sheets: Sequence[str]) -> DataFrame:
    """Sheets that only explain how to fill the workbook are left out."""
    return rows.where(~F.upper(F.trim("sheet")).isin(*[s.upper() for s in sheets]))
