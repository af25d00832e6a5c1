"""A folder of XLSX workbooks as one table: first sheet, header row, one task per file."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column_number(reference: str) -> int:
    number = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        number = number * 26 + ord(letter) - 64
    return number - 1


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


# Number formats of the file standard that show dates or times.
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """The cell styles that show a number as a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.parse(book.open("xl/styles.xml")).getroot()
    own = {}
    for node in root.iter(f"{_MAIN}numFmt"):
        code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", node.get("formatCode", "")).lower()
        own[int(node.get("numFmtId"))] = bool(re.search("[ymdhs]", code)) and "general" not in code
    formats = root.find(f"{_MAIN}cellXfs")
    found = [int(x.get("numFmtId", "0")) for x in formats] if formats is not None else []
    return {i for i, f in enumerate(found) if own.get(f, f in _DATE_FORMATS)}


def sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """Rows of the first sheet as text cells, gaps as None; rows that are left out are empty lists.

    Dates come as ISO text.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = [_text(si) for si in ElementTree.parse(book.open("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        dates = _date_styles(book)
        root = ElementTree.parse(book.open("xl/workbook.xml"))
        properties = root.find(f".//{_MAIN}workbookPr")
        since_1904 = properties is not None and properties.get("date1904") in ("1", "true")
        sheet = root.find(f".//{_MAIN}sheet")
        links = ElementTree.parse(book.open("xl/_rels/workbook.xml.rels")).getroot()
        target = next(link.get("Target") for link in links if link.get("Id") == sheet.get(_REL))
        path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        number = 0
        for _, node in ElementTree.iterparse(book.open(path)):
            if node.tag != f"{_MAIN}row":
                continue
            row: list[str | None] = []
            for cell in node.iter(f"{_MAIN}c"):
                at = _column_number(cell.get("r")) if cell.get("r") else len(row)
                row.extend([None] * (at - len(row)))
                row.append(_cell_text(cell, shared, dates, since_1904))
            at = int(node.get("r") or number + 1)
            node.clear()
            for _ in range(number + 1, at):
                yield []
            number = at
            yield row


def _cell_text(cell, shared: list[str], dates: set[int], since_1904: bool) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return _text(cell)
    value = cell.findtext(f"{_MAIN}v")
    if value is None:
        return None
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return "True" if value == "1" else "False"
    if kind == "n" and int(cell.get("s") or 0) in dates:
        # day 60 of the older calendar never was; days before it count from one day later
        days = float(value)
        epoch = datetime(1904, 1, 1) if since_1904 else datetime(1899, 12, 31 if days < 60 else 30)
        return str(epoch + timedelta(seconds=round(days * 86400)))
    return value


def _headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            names = [(h or "").strip() for h in next(sheet_rows(content), [])]
            yield pd.DataFrame({"path": [path], "names": [names]})


def read_workbooks(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All workbooks under ``path`` as text cells, one task per file.

    Columns are matched by header name.  The table has the columns of the first
    file, then those that only later files have; ``columns`` fixes them and skips
    reading the headers first.  A filled cell beyond its header, an unnamed or
    repeated header, and a column that ``columns`` does not name are errors.  Blank rows
    between others are kept, those at the end are not.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    if columns is None:
        # one row per distinct header, in the order of the first file that has it
        found = files.select("path", "content").mapInPandas(_headers, "path string, names array<string>")
        headers = [r["names"] for r in found.groupBy("names").agg(F.min("path").alias("path")).orderBy("path").collect()]
        if not headers:
            raise ValueError(f"No workbook found: {path}")
        columns = list(dict.fromkeys(name for names in headers for name in names))
        for names in headers:
            if not all(names) or len({n.lower() for n in names}) != len(names):
                raise ValueError(f"A workbook has an unnamed or repeated column: {names}")
    width = len(columns)
    places = {name: i for i, name in enumerate(columns)}

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = lambda block: pd.DataFrame(block, columns=[f"c{i}" for i in range(width)], dtype=object)
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                found = sheet_rows(content)
                header = [(h or "").strip() for h in next(found, [])]
                if any(h not in places for h in header):
                    raise ValueError(f"{path} has columns that were not asked for: {header}")
                target = [places[h] for h in header]
                block, blank = [], 0
                for row in found:
                    if any(c is not None for c in row[len(header) :]):
                        raise ValueError(f"{path} has a row with more cells than the header")
                    if all(c is None for c in row):
                        blank += 1
                        continue
                    block += [[None] * width for _ in range(blank)]
                    blank = 0
                    cells = [None] * width
                    for place, cell in zip(target, row, strict=False):
                        cells[place] = cell
                    block.append(cells)
                    if len(block) >= 10_000:
                        yield frame(block)
                        block = []
                if block:
                    yield frame(block)

    schema = ", ".join(f"c{i} string" for i in range(width))
    return files.select("path", "content").mapInPandas(rows, schema).select(
        *[F.col(f"c{i}").alias(name) for i, name in enumerate(columns)]
    )
