"""Spreadsheets as cells, read from their container: sheet XML is parsed as a stream and cells leave in bounded batches.

Shared and inline texts, numbers, dates by their number format, truth values and merged ranges are read; formulas give their
stored result. A workbook's table of shared texts is held while it is read, a sheet never is.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from posixpath import dirname, join, normpath
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame

CELLS = "relpath string, sheet string, row int, col int, value string"
_CELLS = pa.schema([("relpath", pa.string()), ("sheet", pa.string()), ("row", pa.int32()), ("col", pa.int32()), ("value", pa.string())])
#: Numbers of the built-in formats that show dates or times, and day 0 of their serial numbers.
DATE_FORMATS, DAY_ZERO = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}, datetime(1899, 12, 30)
DAY_ZERO_1904 = datetime(1904, 1, 1)


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _elements(stream: io.IOBase, *names: str) -> Iterator[ET.Element]:
    """The elements of these names as they end; each is emptied once it was used, and their parents of them."""
    open_ = []
    for event, e in ET.iterparse(stream, events=("start", "end")):
        if event == "start":
            open_.append(e)
            continue
        open_.pop()
        if _local(e.tag) in names:
            yield e
            e.clear()
            if open_:
                open_[-1].remove(e)


def _text(e: ET.Element) -> str:
    """All text runs of a text element, phonetic ones left out."""
    out = []
    for child in e:
        if _local(child.tag) == "t":
            out.append(child.text or "")
        elif _local(child.tag) == "r":
            out += [t.text or "" for t in child if _local(t.tag) == "t"]
    return "".join(out)


def position(ref: str) -> tuple[int, int]:
    """Row and column from 0 of a reference such as B7."""
    letters, digits = re.fullmatch(r"\$?([A-Za-z]{1,3})\$?([0-9]+)", ref).groups()
    col = 0
    for c in letters.upper():
        col = col * 26 + ord(c) - 64
    return int(digits) - 1, col - 1


class Workbook:
    """One workbook's parts: sheet names in order with their XML, shared texts and which cell styles are dates."""

    def __init__(self, content: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = set(self.zip.namelist())
        root = self._related("", "officeDocument")[0]
        targets = self._relations(root)
        self.sheets, self.day_zero = [], DAY_ZERO
        with self.zip.open(root) as f:
            for e in _elements(f, "sheet", "workbookPr"):
                if _local(e.tag) == "workbookPr":
                    self.day_zero = DAY_ZERO_1904 if e.get("date1904") in ("1", "true") else DAY_ZERO
                else:
                    target = targets.get(next((v for k, v in e.attrib.items() if _local(k) == "id"), None))
                    if target and target[1] in self.names and "worksheet" in target[0]:
                        self.sheets.append((e.get("name"), target[1]))
        self.shared = self._shared(root)
        self.dates = self._dates(root)

    def _relations(self, part: str) -> dict[str, tuple[str, str]]:
        rels = join(dirname(part), "_rels", part.rsplit("/", 1)[-1] + ".rels")
        if rels not in self.names:
            return {}
        with self.zip.open(rels) as f:
            base = "" if not part else dirname(part)
            return {e.get("Id"): (e.get("Type").rsplit("/", 1)[-1], normpath(join(base, e.get("Target"))) if not e.get("Target").startswith("/") else e.get("Target")[1:]) for e in _elements(f, "Relationship")}

    def _related(self, part: str, kind: str) -> list[str]:
        return [name for k, name in self._relations(part).values() if k == kind and name in self.names]

    def _shared(self, root: str) -> list[str]:
        found = []
        for name in self._related(root, "sharedStrings"):
            with self.zip.open(name) as f:
                found += [_text(e) for e in _elements(f, "si")]
        return found

    def _dates(self, root: str) -> set[int]:
        """The cell styles that show numbers as dates."""
        custom, dates = {}, set()
        for name in self._related(root, "styles"):
            with self.zip.open(name) as f:
                for e in _elements(f, "numFmt", "cellXfs"):
                    if _local(e.tag) == "numFmt":
                        bare = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]|_.|\*.', "", e.get("formatCode", ""))
                        custom[int(e.get("numFmtId"))] = bool(re.search("[dmyhs]", bare, re.I)) and "general" not in bare.lower()
                    else:
                        for k, xf in enumerate(e):
                            n = int(xf.get("numFmtId", 0))
                            if custom.get(n, n in DATE_FORMATS):
                                dates.add(k)
        return dates

    def value(self, cell: ET.Element) -> str:
        kind, v, inline = cell.get("t", "n"), None, None
        for child in cell:
            if _local(child.tag) == "v":
                v = child.text
            elif _local(child.tag) == "is":
                inline = _text(child)
        if kind == "inlineStr":
            return inline or ""
        if v is None:
            return ""
        if kind == "s":
            return self.shared[int(v)]
        if kind == "b":
            return "True" if v.strip() in ("1", "true") else "False"
        if kind in ("str", "e", "d"):
            return v
        if int(cell.get("s", 0)) in self.dates:
            return str(self.day_zero + timedelta(seconds=round(float(v) * 86400)))
        number = float(v)
        return str(int(number)) if number.is_integer() and "E" not in v.upper() and "." not in v else v if v.lstrip("-").isdigit() else repr(number)

    def merged(self, part: str) -> list[tuple[int, int, int, int]]:
        with self.zip.open(part) as f:
            found = [(*position(a), *position(b)) for a, b in ((e.get("ref") + ":" + e.get("ref")).split(":")[:2] for e in _elements(f, "mergeCell"))]
        return found

    def cells(self, part: str, fill_merged: bool = False) -> Iterator[tuple[int, int, str]]:
        """row, col, value from 0 of a sheet's cells that hold anything; fill_merged: a merged range's value in all its cells."""
        ranges = {(a, b): (a, b, c, d) for a, b, c, d in self.merged(part)} if fill_merged else {}
        with self.zip.open(part) as f:
            row, col = -1, -1
            for e in self._cells(f):
                if _local(e.tag) == "row":
                    row, col = int(e.get("r", row + 2)) - 1, -1
                    continue
                ref = e.get("r")
                row, col = position(ref) if ref else (max(row, 0), col + 1)
                value = self.value(e)
                if value == "":
                    continue
                a, b, c, d = ranges.get((row, col), (row, col, row, col))
                for r in range(a, c + 1):
                    for k in range(b, d + 1):
                        yield r, k, value

    def _cells(self, stream: io.IOBase) -> Iterator[ET.Element]:
        """The rows of a sheet as they begin, each followed by its cells."""
        row = None
        for event, e in ET.iterparse(stream, events=("start", "end")):
            name = _local(e.tag)
            if name == "row":
                row = e if event == "start" else None
                if event == "start":
                    yield e
                else:
                    e.clear()
            elif name == "c" and event == "end":
                yield e
                if row is not None:
                    row.remove(e)


def sheet_cells(files: DataFrame, fill_merged: bool = False, batch: int = 20_000) -> DataFrame:
    """relpath, sheet, row, col, value of the cells that hold anything in every sheet. files: relpath, content.

    A file that is no workbook gives no row. At most `batch` cells leave a worker at once.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for path, content in zip(part.column("relpath"), part.column("content")):
                try:
                    book = Workbook(content.as_py() or b"")
                except (zipfile.BadZipFile, KeyError, IndexError, ET.ParseError):
                    continue
                for sheet, name in book.sheets:
                    held: list[tuple[int, int, str]] = []
                    for cell in book.cells(name, fill_merged):
                        held.append(cell)
                        if len(held) >= batch:
                            yield _batch(path.as_py(), sheet, held)
                            held = []
                    if held:
                        yield _batch(path.as_py(), sheet, held)

    return files.select("relpath", "content").mapInArrow(run, CELLS)


def _batch(path: str, sheet: str, cells: list[tuple[int, int, str]]) -> pa.RecordBatch:
    rows, cols, values = zip(*cells)
    return pa.RecordBatch.from_arrays([pa.array([path] * len(cells)), pa.array([sheet] * len(cells)), pa.array(rows, pa.int32()), pa.array(cols, pa.int32()), pa.array(values)], schema=_CELLS)


def reference(row: int, col: int) -> str:
    letters, col = "", col + 1
    while col:
        col, k = divmod(col - 1, 26)
        letters = chr(65 + k) + letters
    return f"{letters}{row + 1}"


def workbook_bytes(sheets: dict[str, list[tuple[int, int, str]]], merged: dict[str, list[str]] | None = None) -> bytes:
    """A workbook of text cells (row, col, value) with shared texts: what the reader's counterpart writes."""
    head, main = '<?xml version="1.0" encoding="UTF-8"?>', "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel, package = "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006/relationships"
    shared: dict[str, int] = {}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n, (name, cells) in enumerate(sheets.items(), 1):
            rows: dict[int, list[str]] = {}
            for row, col, value in sorted(cells):
                rows.setdefault(row, []).append(f'<c r="{reference(row, col)}" t="s"><v>{shared.setdefault(value, len(shared))}</v></c>')
            body = "".join(f'<row r="{r + 1}">{"".join(c)}</row>' for r, c in rows.items())
            ranges = "".join(f'<mergeCell ref="{m}"/>' for m in (merged or {}).get(name, []))
            z.writestr(f"xl/worksheets/sheet{n}.xml", f'{head}<worksheet xmlns="{main}"><sheetData>{body}</sheetData>{"<mergeCells>" + ranges + "</mergeCells>" if ranges else ""}</worksheet>')
        listed = "".join(f'<sheet name="{escape(name, {chr(34): "&quot;"})}" sheetId="{n}" r:id="rId{n}"/>' for n, name in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{listed}</sheets></workbook>')
        texts = "".join(f'<si><t xml:space="preserve">{escape(t)}</t></si>' for t in shared)
        z.writestr("xl/sharedStrings.xml", f'{head}<sst xmlns="{main}">{texts}</sst>')
        links = "".join(f'<Relationship Id="rId{n}" Type="{rel}/worksheet" Target="worksheets/sheet{n}.xml"/>' for n in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}">{links}<Relationship Id="rIdS" Type="{rel}/sharedStrings" Target="sharedStrings.xml"/></Relationships>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
    return out.getvalue()
