import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quarrymill.operators import events as ev, sheets as sh
from quarrymill.sources import workbooks as wb

FILES = "relpath string, content binary"


def replaced(book, parts):
    """A workbook with parts put in place of its own."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(book)) as a, zipfile.ZipFile(out, "w") as b:
        for n in a.namelist():
            if n not in parts:
                b.writestr(n, a.read(n))
        for n, text in parts.items():
            b.writestr(n, text)
    return out.getvalue()


def read(spark, book, **how):
    df = wb.sheet_cells(spark.createDataFrame([("a.xlsx", bytearray(book))], FILES), **how)
    return sorted(tuple(r)[1:] for r in df.collect())


def test_positions():
    assert wb.position("A1") == (0, 0) and wb.position("$AB$12") == (11, 27) and wb.position("XFD1048576") == (1048575, 16383)
    assert all(wb.position(wb.reference(r, c)) == (r, c) for r in (0, 9, 1048575) for c in (0, 25, 26, 701, 702, 16383))


def test_texts_and_sheets_in_order(spark):
    sheets = {"Ä & <b>": [(0, 0, "x"), (2, 3, " kept  blanks "), (2, 1, "漢<&>")], "empty": [], "two": [(5, 27, "x")]}
    book = wb.workbook_bytes(sheets)
    assert [s for s, _ in wb.Workbook(book).sheets] == list(sheets)
    assert read(spark, book) == sorted((s, r, c, v) for s, cells in sheets.items() for r, c, v in cells)


SHEET = """<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
<row r="1"><c r="A1" t="inlineStr"><is><r><t>in</t></r><r><t>line</t></r><rPh><t>no</t></rPh></is></c><c r="B1"><v>7</v></c><c r="C1"><v>7.0</v></c><c r="D1"><v>1E-3</v></c></row>
<row r="3"><c t="b"><v>1</v></c><c t="str"><f>A1&amp;"x"</f><v>linex</v></c><c r="D3" t="e"><v>#N/A</v></c><c r="E3"/><c r="F3" t="s"><v></v></c></row>
<row r="4"><c r="A4" s="1"><v>45292</v></c><c r="B4" s="2"><v>45292.5</v></c><c r="C4" s="3"><v>45292</v></c></row></sheetData>
<mergeCells><mergeCell ref="A1:B2"/></mergeCells></worksheet>"""
STYLES = """<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/><numFmt numFmtId="171" formatCode="0.0&quot;days&quot;"/></numFmts>
<cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>"""


def test_kinds_of_cells(spark):
    book = wb.workbook_bytes({"s": [(0, 0, "x")]})
    rels = zipfile.ZipFile(io.BytesIO(book)).read("xl/_rels/workbook.xml.rels").decode().replace("</Relationships>", '<Relationship Id="st" Type="x/styles" Target="/xl/styles.xml"/></Relationships>')
    book = replaced(book, {"xl/worksheets/sheet1.xml": SHEET, "xl/styles.xml": STYLES, "xl/_rels/workbook.xml.rels": rels})
    want = [("s", 0, 0, "inline"), ("s", 0, 1, "7"), ("s", 0, 2, "7.0"), ("s", 0, 3, "0.001"), ("s", 2, 0, "True"), ("s", 2, 1, "linex"), ("s", 2, 3, "#N/A"), ("s", 3, 0, "2024-01-01 00:00:00"), ("s", 3, 1, "2024-01-01 12:00:00"), ("s", 3, 2, "45292")]
    assert read(spark, book) == want
    assert [x for x in read(spark, book, fill_merged=True) if x[3] == "inline"] == [("s", r, c, "inline") for r in (0, 1) for c in (0, 1)]


def test_cells_leave_in_bounded_batches(spark):
    book = wb.workbook_bytes({"s": [(r, c, str(r * c)) for r in range(300) for c in range(10)]})
    files = spark.createDataFrame([("a", bytearray(book)), ("bad", bytearray(b"PK no zip")), ("none", None), ("empty", bytearray(b""))], FILES).coalesce(1)
    got = wb.sheet_cells(files, batch=64).select("row", "col", "value").collect()
    assert sorted(tuple(r) for r in got) == sorted((r, c, str(r * c)) for r in range(300) for c in range(10))
    part = wb.Workbook(book)
    assert sum(1 for _ in part.cells(part.sheets[0][1])) == 3000


@pytest.fixture
def matrix(spark):
    """A message matrix as its sheet has it: a title, a header of two rows, messages with their signals."""
    rows = [["Matrix", "", "", ""], ["Frame", "Name", "Cycle", "Id"], ["", "text", "ms", "hex"], ["m", "Engine", "10", "0x1A"], ["rpm", "", "", ""], ["temp", "", "", ""], ["m", "Brake", "20", "0x05"], ["force", "", "", ""]]
    cells = [(r, c, v) for r, row in enumerate(rows) for c, v in enumerate(row) if v]
    return wb.sheet_cells(spark.createDataFrame([("m.xlsx", bytearray(wb.workbook_bytes({"M": cells})))], FILES))


def test_sheets_read_are_what_the_sheet_operators_take(spark, matrix):
    grid = ev.clean_grid(matrix.drop("relpath"))
    found = sh.structured({"structured": "sheets", "structured_rules": {"header_max_rows": 2}, "sheet_titles": {"M": "The matrix"}}, grid)
    index = found["index"].first()
    assert (index.sheet, index.title, index.header) == ("M", "The matrix", "Frame|Name<br>text|Cycle<br>ms|Id<br>hex")
    assert [r.text for r in found["notes"].collect()] == ["Matrix"]


def test_message_matrix_of_a_real_sheet(spark, matrix):
    messages = sh.structured({"structured": {"kind": "can_matrix", "structured_rules": {"columns": {"signal": 0, "cycle": 2}, "column_header_row": 2}}}, matrix.drop("relpath"))["messages"]
    table = sh.speed_table(messages.withColumn("length", F.lit("8")).withColumn("senders", F.lit("x")), "length", "cycle", "senders")
    assert [(r["rank"], r.message_id, r.message, r.cycle, r["rows"]) for r in table.orderBy("rank").collect()] == [(1, "0x05", "Brake", "20", 2), (2, "0x1A", "Engine", "10", 3)]
    signals = sh.signal_table(messages.where("nth > 1"), ["signal"])
    assert sorted((r.message, r.signal) for r in signals.collect()) == [("Brake", "force"), ("Engine", "rpm"), ("Engine", "temp")]
