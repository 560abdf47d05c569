"""A reader of XLSX workbooks on the standard library: one row a sheet row, with typed cells.

Options: path (a file or a folder), sheet, maxRows, maxCols, dense (true: missing rows are empty ones;
false: only rows that are there), emptySheets (true: a sheet without rows gives one row without a number). Each (file, sheet) is a partition; a filter on file or sheet
prunes partitions where Python filter pushdown is on. A workbook that can't be read gives one row
with its error. Files are read on executors, so the path must be one they all see.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from xml.etree import ElementTree

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

SCHEMA = "file string, sheet string, ord int, row_number int, cells array<struct<t:string,s:string,n:double,b:boolean>>, dimension string, error string"
_LOCAL = re.compile(r"\{.*\}")
REL_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def column_index(reference: str) -> int:
    """Index from 0 of a cell reference's column."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def column_letters(index: int) -> str:
    out, n = "", index + 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _children(element: ElementTree.Element, name: str) -> Iterator[ElementTree.Element]:
    return (e for e in element.iter() if _LOCAL.sub("", e.tag) == name)


def part_name(target: str) -> str:
    """A relationship's target as a name in the archive."""
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def shared_strings(book: zipfile.ZipFile) -> list[str]:
    """Shared strings; the runs of a rich text are joined."""
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in _children(si, "t")) for si in _children(root, "si")]


def sheet_parts(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(sheet name, name in the archive), in workbook order."""
    relations = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = {r.get("Id"): part_name(r.get("Target", "")) for r in _children(relations, "Relationship")}
    return [(s.get("name", ""), target[s.get(REL_ID)]) for s in _children(ElementTree.fromstring(book.read("xl/workbook.xml")), "sheet")]


def cell_value(cell: ElementTree.Element, strings: list[str]) -> object | None:
    """A text, a truth value, a number (whole ones as int), or None."""
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in _children(cell, "t")) or None
    value = next((v.text for v in _children(cell, "v")), None)
    if value is None:
        return None
    if kind == "s":
        return strings[int(value)] if int(value) < len(strings) else None
    if kind == "b":
        return value == "1"
    if kind in ("str", "e"):
        return value
    try:
        number = float(value)
    except ValueError:
        return value
    return int(number) if number.is_integer() else number


def tagged(value: object | None) -> tuple:
    """(type, text, number, truth) of a value; the text is what the value reads as."""
    if value is None:
        return ("none", None, None, None)
    if isinstance(value, bool):
        return ("bool", str(value), None, value)
    if isinstance(value, int):
        return ("int", str(value), float(value), None)
    if isinstance(value, float):
        return ("float", str(value), value, None)
    return ("str", value, None, None)


def sheet_rows(book: zipfile.ZipFile, part: str, strings: list[str], max_cols: int) -> tuple[list[tuple[int, list]], str]:
    """((row number, values without trailing blanks) of the rows that are there, declared or inferred dimension)."""
    root = ElementTree.fromstring(book.read(part))
    rows, last = [], 0
    for position, row in enumerate(_children(root, "row"), start=1):
        number = int(row.get("r") or (last + 1 if last else position))
        last, values = number, []
        for at, cell in enumerate(_children(row, "c")):
            index = column_index(cell.get("r")) if cell.get("r") else at
            if index < max_cols:
                values += [None] * (index + 1 - len(values))
                values[index] = cell_value(cell, strings)
        while values and values[-1] is None:
            values.pop()
        rows.append((number, values))
    declared = next((d.get("ref") for d in _children(root, "dimension")), None)
    widest = max((len(v) for _, v in rows), default=0)
    return rows, declared or (f"A1:{column_letters(max(0, widest - 1))}{rows[-1][0]}" if rows else "A1:A1")


@dataclass
class SheetPartition(InputPartition):
    path: str
    sheet: str | None


class XlsxReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path", "")
        self.sheet = options.get("sheet")
        self.file: str | None = None
        self.max_rows = int(options.get("maxrows", options.get("maxRows", 0)) or 0)
        self.max_cols = int(options.get("maxcols", options.get("maxCols", 40)))
        self.dense = str(options.get("dense", "true")).lower() == "true"
        self.empty_sheets = str(options.get("emptysheets", options.get("emptySheets", "false"))).lower() == "true"

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("sheet",):
                self.sheet = f.value
            elif isinstance(f, EqualTo) and f.attribute == ("file",):
                self.file = f.value
            yield f  # Spark checks them again

    def partitions(self) -> list[SheetPartition]:
        root = Path(self.path.removeprefix("file:"))
        files = sorted(root.glob("*.xlsx"), key=lambda p: p.name.casefold()) if root.is_dir() else [root]
        found = []
        for p in files:
            if self.file and p.name != self.file:
                continue
            try:
                with zipfile.ZipFile(p) as book:
                    names = [n for n, _ in sheet_parts(book)]
            except (zipfile.BadZipFile, KeyError, OSError, ElementTree.ParseError):
                found.append(SheetPartition(str(p), None))
                continue
            found += [SheetPartition(str(p), n) for n in names if self.sheet in (None, n)]
        return found

    def read(self, partition: SheetPartition | None) -> Iterator[tuple]:
        if partition is None:  # no sheet is left after filters
            return
        name = Path(partition.path).name
        try:
            with zipfile.ZipFile(partition.path) as book:
                part = dict(sheet_parts(book))[partition.sheet]
                rows, dimension = sheet_rows(book, part, shared_strings(book), self.max_cols)
        except (zipfile.BadZipFile, KeyError, OSError, ElementTree.ParseError) as e:
            yield (name, partition.sheet, None, None, None, None, f"{type(e).__name__}: {e}")
            return
        if self.dense:
            there = dict(rows)
            rows = [(n, there.get(n, [])) for n in range(1, max(there, default=0) + 1)]
        if self.empty_sheets and not rows:
            yield (name, partition.sheet, None, None, [], dimension, None)
        for k, (number, values) in enumerate(rows[: self.max_rows or None], start=1):
            yield (name, partition.sheet, k, number, [tagged(v) for v in values], dimension, None)


class XlsxDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> XlsxReader:
        return XlsxReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make spark.read.format("xlsx") known, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(XlsxDataSource)


def write_workbook(path: str, sheets: dict[str, list[list]]) -> None:
    """A minimal workbook of plain values, for fixtures and exports of small grids."""
    esc = lambda s: str(s).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    strings: dict[str, int] = {}

    def cell(r: int, c: int, value: object) -> str:
        ref = f'r="{column_letters(c)}{r}"'
        if value is None:
            return ""
        if isinstance(value, bool):
            return f'<c {ref} t="b"><v>{int(value)}</v></c>'
        if isinstance(value, (int, float)):
            return f"<c {ref}><v>{value}</v></c>"
        return f'<c {ref} t="s"><v>{strings.setdefault(str(value), len(strings))}</v></c>'

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    names = list(sheets)
    with zipfile.ZipFile(path, "w") as z:
        for i, n in enumerate(names, start=1):
            rows = "".join(f'<row r="{r}">{"".join(cell(r, c, v) for c, v in enumerate(row))}</row>' for r, row in enumerate(sheets[n], start=1) if row)
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {main}><sheetData>{rows}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>{''.join(f'<si><t>{esc(s)}</t></si>' for s in strings)}</sst>")
        listed = "".join(f'<sheet name="{esc(n)}" sheetId="{i}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" r:id="rId{i}"/>' for i, n in enumerate(names, start=1))
        z.writestr("xl/workbook.xml", f"<workbook {main}><sheets>{listed}</sheets></workbook>")
        relations = "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{relations}</Relationships>')
