from __future__ import annotations

import zipfile

import pytest
from pyspark.sql import functions as F

from foliant.operators import envelope, layout, quality, tables
from foliant.sources import office, text
from foliant.streaming import lifecycle

X = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def test_workbooks(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{X}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/><sheet name="E" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R><x Id="r1" Target="worksheets/s1.xml"/><x Id="r2" Target="worksheets/s2.xml"/></R>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{X}"><si><t>Item</t></si></sst>')
        z.writestr("xl/worksheets/s1.xml", f'<worksheet xmlns="{X}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row><row r="3"><c r="B3" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/s2.xml", f'<worksheet xmlns="{X}"><sheetData/></worksheet>')
    rows = office.read_sheets(spark, str(tmp_path)).orderBy("row_idx").collect()
    assert [(r.sheet, r.row_idx, r.cells) for r in rows] == [("S", 0, ["Item", "", "5"]), ("S", 2, ["", "x"])]


def test_documents(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>body</w:t></w:r></w:p></w:body></w:document>')
    assert office.read_documents(spark, str(tmp_path)).first().markdown == "## Top\n\nbody\n\n| a |\n|---|"


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Report\nItem;Qty;Note\nP1;2;"x;y"\n')
    got = text.read_delimited(spark, str(tmp_path)).orderBy("row_idx").collect()
    assert [(r.is_header, r.cells) for r in got] == [(False, ["Report"]), (True, ["Item", "Qty", "Note"]), (False, ["P1", "2", "x;y"])]


def test_repeated_lines(spark):
    df = spark.createDataFrame([(1, "a\na\na\na"), (2, "|x|\n|x|\nb"), (3, None)], "k long, t string")
    assert {r.k: r.t for r in tables.deduped_lines(df, "k", "t").withColumnRenamed("text", "t").collect()} == {1: "a\na", 2: "|x|", 3: ""}


def test_projection_keeps_blanks(spark):
    t = spark.createDataFrame([(1, 1, 0, 0, "A", 20.0, 120.0), (1, 1, 0, 1, "48", 180.0, 210.0), (1, 1, 0, 2, "39", 380.0, 410.0), (1, 1, 1, 3, "edge", 240.0, 260.0), (1, 1, 1, 4, "gone", 440.0, 460.0)], "doc_id long, page int, line_idx int, seq int, text string, x0 double, x1 double")
    b = spark.createDataFrame([(1, 1, k, lo, hi) for k, (lo, hi) in enumerate([(0.0, 150.0), (150.0, 250.0), (250.0, 350.0), (350.0, 450.0)])], "doc_id long, page int, col_idx int, left double, right double")
    got = layout.projected(t, b).orderBy("line_idx").collect()
    assert [r.cells for r in got] == [["A", "48", "", "39"], ["", "", "edge", ""]]


def test_lines_by_y(spark):
    ys = [(0, 50.0), (1, 51.5), (2, 49.5), (3, 75.0), (4, 76.0), (5, 74.8)]
    t = spark.createDataFrame([(1, 1, i, "t", 100.0 * (i % 3), y - 7, 100.0 * (i % 3) + 40, y + 7) for i, y in ys], "doc_id long, page int, seq int, text string, x0 double, y0 double, x1 double, y1 double")
    assert [r.line_idx for r in layout.lined(t).orderBy("seq").collect()] == [0, 0, 0, 1, 1, 1]


def test_similarity():
    assert layout.similarity("para500", "para500xr") == layout.similarity("minostrong125tab", "minostrong25tab") == 0
    assert layout.similarity("abc", "abc") == 1


def test_alignment_in_order(spark):
    a = spark.createDataFrame([(1, i, t) for i, t in enumerate(["alpha tab", "beta cap", "gamma gel"])], "k long, idx int, text string")
    b = spark.createDataFrame([(1, 0, "alpha tab"), (1, 1, "gamma gel")], "k long, idx int, text string")
    assert sorted((r.truth_idx, r.found_idx) for r in quality.aligned(a, b, "k").collect()) == [(0, 0), (2, 1)]


def test_rate_limit(spark):
    h = spark.createDataFrame([("c", t) for t in (0.0, 1.0, 2.0, 60.0, 60.5, 61.5)], "client string, s double").select("client", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"))
    assert [r.allowed for r in lifecycle.rate_limited(h, 2).orderBy("ts").collect()] == [True, True, False, False, True, True]


@pytest.mark.parametrize("answer, want", [('```json\n{"a":1}\n```', '{"a":1}'), ('x {"a":[1,2', '{"a":[1,2]}'), ("none", '{"raw_response":"none"}')])
def test_recovered_json(spark, answer, want):
    assert spark.createDataFrame([(answer,)], "a string").select(tables.recovered_json("a").alias("j")).first().j == want


def test_line_items(spark):
    t = spark.createDataFrame([(1, ["Qty", "Qty", ""], [["1", "", "3", "4"], ["", " ", "", ""]])], "k long, columns array<string>, rows array<array<string>>")
    assert [r.item for r in envelope.line_items(t, "k").collect()] == ['{"Qty":"1","column_3":"3","column_4":"4"}']
    assert envelope.item_columns(envelope.line_items(t, "k"), "k").first().columns == ["Qty", "column_3", "column_4"]


def test_anomalies(spark):
    t = spark.createDataFrame([(1, ["Item", "Col_Num_1_2", "Qty"], [["VETORY P TAB TOTAL", "1", "2"], ["Alone", "", ""], ["X", "1", "12ab"], ["D", "1", "1"], ["D", "2", "1"], ["D", "003", "1"]])], "k long, columns array<string>, rows array<array<string>>")
    assert {r.rule for r in quality.anomalies(t, "k").collect()} == {"placeholder_column", "merged_total", "no_values", "letters_in_figure", "leading_zeros", "repeated_description"}


def test_ingest_and_progress(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("hello\nworld")
    lifecycle.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    assert [r.raw_text for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["hello\nworld"]
