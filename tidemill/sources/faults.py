"""Faults put into copies of workbooks, for the failure labs and tests; sources are never changed.

Folders are ones that driver and executors share, as for the workbook reader.
"""

from __future__ import annotations

import shutil
import zipfile
from collections.abc import Callable
from pathlib import Path
from xml.etree import ElementTree

from tidemill.sources.xlsx import sheet_parts

STRINGS = "xl/sharedStrings.xml"


def local_name(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


def copy_workbooks(source: str | Path, target: str | Path) -> list[str]:
    """Put a fresh copy of a folder's workbooks in target; their names."""
    target = Path(target)
    shutil.rmtree(target, ignore_errors=True)
    target.mkdir(parents=True)
    return sorted((Path(shutil.copy2(p, target)).name for p in Path(source).glob("*.xlsx")), key=str.casefold)


def edit_part(workbook: str | Path, part: str, edit: Callable[[ElementTree.Element], int]) -> int:
    """Apply an edit to one XML part of a workbook and put the result in place at once; what the edit returns."""
    workbook = Path(workbook)
    fresh = workbook.with_suffix(".part")
    with zipfile.ZipFile(workbook) as old, zipfile.ZipFile(fresh, "w", zipfile.ZIP_DEFLATED) as new:
        root = ElementTree.fromstring(old.read(part))
        changed = edit(root)
        for name in old.namelist():
            new.writestr(name, ElementTree.tostring(root, "utf-8", xml_declaration=True) if name == part else old.read(name))
    fresh.replace(workbook)
    return changed


def rename_string(workbook: str | Path, old: str, new: str) -> int:
    """Replace shared strings that read exactly `old` but for blanks around them; how many there were."""

    def edit(root: ElementTree.Element) -> int:
        hits = [e for e in root.iter() if local_name(e) == "t" and (e.text or "").strip() == old]
        for e in hits:
            e.text = new
        return len(hits)

    with zipfile.ZipFile(workbook) as book:
        has_strings = STRINGS in book.namelist()
    return edit_part(workbook, STRINGS, edit) if has_strings else 0


def clear_sheet(workbook: str | Path, sheet: str) -> int:
    """Take all rows out of a sheet, whose declared extent becomes one cell; how many there were."""

    def edit(root: ElementTree.Element) -> int:
        n = 0
        for e in root.iter():
            if local_name(e) == "sheetData":
                n += len(e)
                e.clear()
            elif local_name(e) == "dimension":
                e.set("ref", "A1")
        return n

    with zipfile.ZipFile(workbook) as book:
        part = dict(sheet_parts(book))[sheet]
    return edit_part(workbook, part, edit)
