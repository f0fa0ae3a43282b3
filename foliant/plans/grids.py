"""Queries from positioned tokens to tables. Every supplier is a page, of one of three layouts, or a table, of one of two; the answers are golden tables made by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import cells as C
from foliant.operators import decisions as D
from foliant.operators import sanitise as S
from foliant.operators import tables as T
from foliant.operators.assembly import assembled, table_grid
from foliant.operators.columns import column_model
from foliant.operators.layout import lined
from foliant.plans.adapters import read

_BODY = [("ALPHA TAB", "10", "25", "5", "30"), ("BETA CAP", "40", "12", "2", "50"), ("GAMMA SYP", "7", "60", "9", "58"), ("DELTA INJ", "3", "14", "1", "16")]


def _figures(y, row):
    return [(row[0], 100, 220, y)] + [(f, 300 + 120 * k, 330 + 120 * k, y) for k, f in enumerate(row[1:])]


#: (text, x0, x1, y0) of the words of each layout: labels that no list knows under figures of a letterhead; labels in tiers and a
#: banner; labels missing over packings and two columns of figures.
LAYOUTS = [
    [("GSTIN 09AABCU9603R1ZM", 100, 340, 45), ("From 01/05/2026 To 29/05/2026", 100, 380, 70), ("Zorb", 100, 180, 100), ("Wix", 300, 350, 100), ("Klar", 420, 470, 100), ("Vint", 540, 590, 100), ("Frip", 660, 710, 100)]
    + [w for k, r in enumerate(_BODY) for w in _figures(130 + 30 * k, r)],
    [("SHREE AGENCIES", 100, 400, 20), ("Zed", 300, 480, 80), ("Mov", 540, 710, 80), ("Zorb", 100, 180, 104), ("Wix", 300, 350, 104), ("Klar", 420, 470, 104), ("Vint", 540, 590, 104), ("Item", 100, 180, 128), ("Frip", 660, 710, 128), ("SPECIAL DIVISION", 100, 260, 152)]
    + [w for k, r in enumerate(_BODY) for w in _figures(180 + 30 * k, r)],
    [("ITEM DESCRIPTION", 100, 400, 100), ("ISSUE", 700, 780, 100), ("CLOSING", 850, 950, 100)]
    + [w for k in range(4) for w in ((f"DRUG {'ABCD'[k]}", 100, 250, 130 + 30 * k), ("10 TAB", 420, 460, 130 + 30 * k), (f"{k + 1}00", 490, 520, 130 + 30 * k), (f"{k}5", 590, 620, 130 + 30 * k), (f"{k}2", 730, 755, 130 + 30 * k), (f"{k}13", 890, 920, 130 + 30 * k))],
]
#: (layout, column, name, left, right, uncertain).
MODELS = [
    (0, 0, "Zorb", 0, 240, True), (0, 1, "Wix", 240, 385, True), (0, 2, "Klar", 385, 505, True), (0, 3, "Vint", 505, 625, True), (0, 4, "Frip", 625, 710, True),
    (1, 0, "Item", 0, 240, False), (1, 1, "Zed Wix", 240, 385, False), (1, 2, "Zed Klar", 385, 505, False), (1, 3, "Mov Vint", 505, 625, False), (1, 4, "Mov Frip", 625, 710, False),
    (2, 0, "ITEM DESCRIPTION", 0, 405, False), (2, 1, "Packing", 405, 475, False), (2, 2, "Col_Num_1_1", 475, 555, False), (2, 3, "Col_Num_1_2", 555, 665, False), (2, 4, "ISSUE", 665, 815, False), (2, 5, "CLOSING", 815, 950, False),
]
#: (layout, row, type, cells).
GRIDS = (
    [(0, k, "PRODUCT", "|".join(r)) for k, r in enumerate(_BODY)]
    + [(1, 0, "PARTY_OR_HEADER", "SPECIAL DIVISION||||")] + [(1, k + 1, "PRODUCT", "|".join(r)) for k, r in enumerate(_BODY)]
    + [(2, k, "PRODUCT", f"DRUG {'ABCD'[k]}|10 TAB|{k + 1}00|{k}5|{k}2|{k}13") for k in range(4)]
)

NAMES = ["Item", "Pack", "Opening", "In", "Out", "Closing"]
#: Lines of two tables, # for the table's number: a banner, details and short ends, a title and its figures, a figures-only line,
#: a moved label, a footer; and a product on two lines, a subtotal that a tilted line completes, a label under its figures.
TABLES = [
    ["ACME DIVISION", "PAR# TAB|10S|5|2|3|4", "Batch: X1 Exp: 10/26", "GEL", "QUANTA# CAPSULE", "QUANTA# CAPSULE||7|1|2|6", "||7|1|2|6", "|TOTAL|12|3|5|10", "Page 1 of 2", "||||9", "Printed By : X 1", "LATE# TAB||1"],
    ["LONG# INJECTION||5|2", "LONG# INJECTION||||3|4", "S-Total||5|2|3|4", "SOLO# SYRUP||1|1", "|S-Total|||", "|S-Total|1", "CARRIED# SYP|||6|8|7", "CARRIED# SYP||8", "||11|||7", "Grand Total", "ODD# 500 TAB||1", "ODD# 650 TAB||||1"],
]
#: (table, row, type, cells).
ROWS = [
    (0, 0, "PARTY_OR_HEADER", "ACME DIVISION|||||"), (0, 1, "PRODUCT", "PAR# TAB Batch: X1 Exp: 10/26 GEL|10S|5|2|3|4"), (0, 2, "PRODUCT", "QUANTA# CAPSULE||7|1|2|6"), (0, 3, "SUBTOTAL", "QUANTA# CAPSULE|S-Total|7|1|2|6"),
    (0, 4, "TOTAL", "TOTAL||12|3|5|10"), (0, 5, "FOOTER", "Printed By : X 1|||||"), (0, 6, "FOOTER", "LATE# TAB 1|||||"),
    (1, 0, "PRODUCT", "LONG# INJECTION||5|2|3|4"), (1, 1, "SUBTOTAL", "LONG# INJECTION||5|2|3|4"), (1, 2, "PRODUCT", "SOLO# SYRUP||1|1||"), (1, 3, "SUBTOTAL", "SOLO# SYRUP|S-Total|1|6|8|7"),
    (1, 4, "PRODUCT", "CARRIED# SYP||8|||"), (1, 5, "TOTAL", "Grand Total||11|||7"), (1, 6, "PRODUCT", "ODD# 500 TAB||1|||"), (1, 7, "PRODUCT", "ODD# 650 TAB||||1|"),
]


def _page_tokens(s, d):
    sup = read(s, d, "supplier").select(F.col("s_suppkey").cast("long").alias("doc_id"), F.lit(1).alias("page"))
    word = lambda k, w: F.struct(F.lit(k).cast("long").alias("seq"), F.lit(w[0]).alias("text"), *(F.lit(float(v)).alias(n) for n, v in (("x0", w[1]), ("x1", w[2]), ("y0", w[3]), ("y1", w[3] + 14))))
    all_ = F.array(*(F.array(*(word(k, w) for k, w in enumerate(words))) for words in LAYOUTS))
    words = sup.select("*", F.explode(F.get(all_, (F.col("doc_id") % 3).cast("int"))).alias("w")).select("doc_id", "page", "w.*")
    slope = (F.col("doc_id") % 5) * 2.0
    return words.withColumns({"y0": F.col("y0") + slope, "y1": F.col("y1") + slope})


def _table_lines(s, d):
    sup = read(s, d, "supplier").select(F.col("s_suppkey").cast("long").alias("t"))
    all_ = F.array(*(F.array(*(F.lit(r) for r in rows)) for rows in TABLES))
    lines = sup.select("t", F.posexplode(F.get(all_, (F.col("t") % 2).cast("int"))).alias("line_idx", "raw"))
    cells = F.split(F.replace("raw", F.lit("#"), F.col("t").cast("string")), r"\|")
    return lines.select("t", "line_idx", cells.alias("cells"), F.array(*(F.lit(n) for n in NAMES)).alias("names"))


def _values(rows: list[tuple]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(repr(v) if isinstance(v, str) else str(v).lower() for v in r) + ")" for r in rows)


#: Texts, tables and descriptions by the supplier's number, # or @ in them, and what comes of each.
HEADS = [
    ("# SHREE AGENCIES@\nSTOCK STATEMENT\nGandhi Road@\nFrom 01/05 To 29/05\n| a | b |\n| 1 | 2 |", ("SHREE AGENCIES@", "Gandhi Road@", "From 01/05 To 29/05")),
    ("Report\nNOVA TRADERS@\n| HETERO GENX@ X | | |\n|---|---|---|\nFor the month", ("NOVA TRADERS@", "HETERO GENX@ X", "For the month")),
    ("ab\n| Total 5 | |", (None, None, None)),
]
BILLS = [
    ("Product Name  InQty  Sales  Cl.Value\nA@  1  2  3.00\nB@  4 5\nOpening Value 9\nC  1  2  3", ["0:0:Product Name|InQty|Sales|Cl.Value", "0:1:A@|1|2|3.00", "0:2:B@|4|5"]),
    ("Product Total\nX@ 1\n\nProduct Sales\n---\nnone", ["0:0:Product|Total", "0:1:X@|1"]),
    ("| Product | Total |\nProduct Total\nA 1", []),
]
NOTED = [
    (["Sl", "Item", "Qty"], [["1", "PAR# TAB", "5"], ["", "Batch No: X12345", "Quantity: 3"], ["2", "GEL#", "batch number quantity: 7"], ["3", "OIL#", "Expiry within six month"]], "1,PAR# TAB,5;2,GEL#,7;3,OIL#,0", "Batch No: X12345|Quantity: 3|batch number quantity: 7|Expiry within six month"),
    (["Item", "Qty"], [["LONG#", "1"], ["LONG# again", "Exp date 10/26"], ["NEXT#", "Mfg date month"]], "LONG#,1;NEXT#,0", "LONG# again|Exp date 10/26|Mfg date month"),
]
VALUED = [
    (["a", "b", "c", "d", "e", "f", "g", "h", "i", "j", "k", "l", "m", "Bal. Qty"], [["1", "2", "3", "4", "5", "6", "7", "8", "9", "10", "11", "", "#", "4819.80"], ["x"]], "Bal.Val", "1,2,3,4,5,6,7,8,9,10,11,#,0,0,4819.80;x"),
    (["Item", "Closing Value"], [["1", "2", "3", "4", "5", "6", "7", "#", "9.00"]], "Closing Value", "1,2,3,4,5,6,7,#,9.00"),
]
DESCRIBED = [("TOFUSTAB", "TOFUS TAB"), ("O.058CREAM", "0.05% CREAM"), ("MINOSTRONG-FSOLUTION", "MINOSTRONG-F SOLUTION"), ("BORITSB65", "BORIT SB 65"), ("PARA500mg", "PARA 500mg"), ("108 GEL", "10% GEL")]
FILLS = [[("DRUG X#", "1", "", "2"), ("DRUG X# S-Total", "", "5", ""), ("ALONE#", "", "", "1")], [("DRUG Y#", "1", "2", ""), ("S-Total", "", "", "9"), ("Z#", "1", "1", "1"), ("OTHER S-Total", "", "", "")]]
FILLED = [[("DRUG X#", "1", "5", "2", "subtotal"), ("DRUG X# S-Total", "1", "5", "2", "product"), ("ALONE#", "", "", "1", None)], [("DRUG Y#", "1", "2", "9", "subtotal"), ("S-Total", "1", "2", "9", "product"), ("Z#", "1", "1", "1", None), ("OTHER S-Total", "", "", "", None)]]


def _suppliers(s, d, n, values):
    """(t, v): each supplier's number and the value of its remainder, with the number for every #."""
    sup = read(s, d, "supplier").select(F.col("s_suppkey").cast("long").alias("t"))
    return sup.select("t", F.get(F.array(*values), (F.col("t") % n).cast("int")).alias("v"))


def _numbered(c):
    return F.replace(c, F.lit("#"), F.col("t").cast("string"))


def _texts(s, d, texts):
    return _suppliers(s, d, len(texts), [F.lit(t) for t in texts]).select("t", F.replace("v", F.lit("@"), F.col("t").cast("string")).alias("v"))


def _named_tables(s, d, tables):
    value = lambda h, rows: F.struct(F.array(*(F.lit(x) for x in h)).alias("h"), F.array(*(F.array(*(F.lit(x) for x in r)) for r in rows)).alias("r"))
    t = _suppliers(s, d, len(tables), [value(h, rows) for h, rows, *_ in tables])
    return t.select("t", F.col("v.h").alias("h"), F.transform("v.r", lambda r: F.transform(r, _numbered)).alias("r"))


def _joined(rows):
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, ",")), ";")


#: Texts of tables and the sheets they make: a title row, a blank name, short and long rows, empty ends, two tables.
SHEETS = [
    ("| Item | | Qty | x |\n|---|---|---|---|\n| DERMA | - | | |\n| A@ | b | 1 |\n| | | | |\n| B | c | 2 | | 9 |\n\n| K | V |\n|---|---|\n| a | 1 |", [(1, "Item,Column 2,Qty", "A@,b,1;B,c,2", True), (2, "K,V", "a,1", False)]),
    ("| K | V |\n|---|---|\n| a@ | 1 |\n| b | 1 |\ntext\n| K | V |\n|---|---|\n| c | - |\n| d | |", [(1, "K,V", "b,1", True), (2, "K", "d", False)]),
]


def _sheets(s, d):
    t = T.sheet_tables(T.pipe_tables(_texts(s, d, [t for t, _ in SHEETS]), "t", "v"), "t")
    return t.select("t", "table_index", F.array_join("columns", ",").alias("columns"), _joined(F.col("rows")).alias("rows"), "dominant")


#: A tilted page: two lines whose ends drop by 0.1 a pixel, and where its words belong.
TILTED = [(k, x, y + 0.1 * (x + 15), line) for k, (x, y, line) in enumerate([(0, 0, 0), (150, 0, 0), (300, 0, 0), (0, 25, 1), (150, 25, 1), (300, 25, 1)])]


def _tilted(s, d):
    w = F.explode(F.array(*(F.struct(F.lit(k).alias("seq"), F.lit(float(x)).alias("x0"), F.lit(float(y)).alias("y0")) for k, x, y, _ in TILTED))).alias("w")
    t = read(s, d, "supplier").select(F.col("s_suppkey").cast("long").alias("doc_id"), F.lit(1).alias("page"), w).select("doc_id", "page", "w.*")
    t = t.withColumns({"x1": F.col("x0") + 30, "y1": F.col("y0") + 12, "quad_slope": F.lit(0.1), "text": F.lit("w")})
    flat = lined(t.withColumn("quad_slope", F.lit(0.0))).groupBy("doc_id").agg((F.max("line_idx") + 1).alias("untilted"))
    return lined(t).select("doc_id", "seq", "line_idx").join(flat, "doc_id")


def _sublines(s, d):
    return _named_tables(s, d, NOTED).select("t", S.without_sublines(F.col("h"), F.col("r")).alias("x")).select("t", _joined(F.col("x.rows")).alias("rows"), F.array_join("x.notes", "|").alias("notes"))


def _valued(s, d):
    return _named_tables(s, d, VALUED).select("t", S.value_recovered(F.col("h"), F.col("r")).alias("x")).select("t", F.element_at("x.headers", -1).alias("last"), _joined(F.col("x.rows")).alias("rows"))


def _filled(s, d):
    row = lambda k, r: F.struct(F.lit(k).alias("n"), *(F.lit(v).alias(c) for c, v in zip(("label", "a", "b", "c"), r, strict=True)))
    rows = _suppliers(s, d, 2, [F.array(*(row(k, r) for k, r in enumerate(rows))) for rows in FILLS]).select("t", F.explode("v").alias("v")).select("t", "v.n", _numbered(F.col("v.label")).alias("label"), "v.a", "v.b", "v.c")
    return D.subtotals_filled(rows, "t", "n", ["a", "b", "c"])


QUERIES = {
    "column_model": lambda s, d: column_model(lined(_page_tokens(s, d))).select("doc_id", "col_idx", "name", F.round("left", 3).alias("left"), F.round("right", 3).alias("right"), "uncertain"),
    "table_grid": lambda s, d: table_grid(_page_tokens(s, d)).select("doc_id", "row_idx", "row_type", F.array_join("cells", "|").alias("cells"), "uncertain"),
    "header_metadata": lambda s, d: _texts(s, d, [t for t, _ in HEADS]).select("t", D.header_metadata(F.col("v")).alias("m")).select("t", "m.*"),
    "billing_tables": lambda s, d: T.billing_rows(_texts(s, d, [t for t, _ in BILLS]), "t", "v").select("t", "table_idx", "row_idx", F.array_join("cells", "|").alias("cells")),
    "batch_sublines": _sublines,
    "sheet_tables": _sheets,
    "y_cluster_tilt": _tilted,
    "value_column": _valued,
    "empty_tail": lambda s, d: _named_tables(s, d, [(["a", "b", "c"], [["#", "", "-"], ["1", "None", ""]]), (["a", "b"], [["", "#"]])]).select("t", S.without_empty_tail(F.col("h"), F.col("r")).alias("x")).select("t", F.array_join("x.headers", ",").alias("headers"), _joined(F.col("x.rows")).alias("rows")),
    "batch_sections": lambda s, d: _texts(s, d, ["a@\n### Batch notes\n- x\nword\n\n| t |\n## batch\n* y\n# End"]).select("t", F.array_join(S.without_batch_sections(F.split("v", "\n")), "/").alias("text")),
    "name_confusions": lambda s, d: _suppliers(s, d, len(DESCRIBED), [F.lit(a) for a, _ in DESCRIBED]).select("t", C.description_confusions(F.col("v")).alias("name"), C.serial_confusions(F.get(F.array(F.lit("O"), F.lit("l"), F.lit("12")), (F.col("t") % 3).cast("int"))).alias("serial")),
    "subtotal_fills": _filled,
    "logical_rows": lambda s, d: assembled(_table_lines(s, d), ["t"]).select("t", "row_idx", "row_type", F.array_join("cells", "|").alias("cells")),
}
_T = "CAST(s_suppkey AS BIGINT) AS t"
_N = "replace(replace({c}, '#', CAST(s_suppkey AS VARCHAR)), '@', CAST(s_suppkey AS VARCHAR))"


def _golden(n: int, names: list[str], rows: list[tuple], whole: tuple[str, ...] = ()) -> str:
    """Rows (remainder, values) of golden answers, for every supplier."""
    null = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    table = "VALUES " + ", ".join("(" + ", ".join(null(v) for v in r) + ")" for r in rows)
    own = ", ".join((f"{c}::INT" if c in whole else _N.format(c=c)) + f" AS {c}" for c in names)
    return f"SELECT {_T}, {own} FROM supplier JOIN ({table}) AS g(k, {', '.join(names)}) ON s_suppkey % {n} = k"


SQL = {
    "header_metadata": _golden(3, ["distributor", "company", "period"], [(k, *m) for k, (_, m) in enumerate(HEADS)]),
    "billing_tables": _golden(3, ["table_idx", "row_idx", "cells"], [(k, *r.split(":", 2)) for k, (_, rows) in enumerate(BILLS) for r in rows], ("table_idx", "row_idx")),
    "batch_sublines": _golden(2, ["rows", "notes"], [(k, r, n) for k, (_, _, r, n) in enumerate(NOTED)]),
    "sheet_tables": f"SELECT {_T}, table_index::INT AS table_index, columns, {_N.format(c='rows')} AS rows, dominant FROM supplier JOIN ({_values([(k, *r) for k, (_, rows) in enumerate(SHEETS) for r in rows])}) AS g(k, table_index, columns, rows, dominant) ON s_suppkey % 2 = k",
    "y_cluster_tilt": f"SELECT CAST(s_suppkey AS BIGINT) AS doc_id, k::INT AS seq, line::INT AS line_idx, 5 AS untilted FROM supplier, ({_values([(k, line) for k, _, _, line in TILTED])}) AS g(k, line)",
    "value_column": _golden(2, ["last", "rows"], [(k, h, r) for k, (_, _, h, r) in enumerate(VALUED)]),
    "empty_tail": _golden(2, ["headers", "rows"], [(0, "a", "#;1"), (1, "a,b", ",#")]),
    "batch_sections": f"SELECT {_T}, 'a' || s_suppkey || '/| t |/# End' AS text FROM supplier",
    "name_confusions": f"SELECT {_T}, name, ['0', '1', '12'][s_suppkey % 3 + 1] AS serial FROM supplier JOIN ({_values([(k, b) for k, (_, b) in enumerate(DESCRIBED)])}) AS g(k, name) ON s_suppkey % {len(DESCRIBED)} = k",
    "subtotal_fills": _golden(2, ["n", "label", "a", "b", "c", "filled_from"], [(k, n, *r) for k, rows in enumerate(FILLED) for n, r in enumerate(rows)], ("n",)),
    "column_model": f'SELECT CAST(s_suppkey AS BIGINT) AS doc_id, col_idx::INT AS col_idx, name, l::DOUBLE AS "left", r::DOUBLE AS "right", uncertain FROM supplier JOIN ({_values(MODELS)}) AS g(layout, col_idx, name, l, r, uncertain) ON s_suppkey % 3 = layout',
    "table_grid": f"SELECT CAST(s_suppkey AS BIGINT) AS doc_id, row_idx::INT AS row_idx, row_type, cells, s_suppkey % 3 = 0 AS uncertain FROM supplier JOIN ({_values(GRIDS)}) AS g(layout, row_idx, row_type, cells) ON s_suppkey % 3 = layout",
    "logical_rows": f"SELECT CAST(s_suppkey AS BIGINT) AS t, row_idx::INT AS row_idx, row_type, replace(cells, '#', CAST(s_suppkey AS VARCHAR)) AS cells FROM supplier JOIN ({_values(ROWS)}) AS g(layout, row_idx, row_type, cells) ON s_suppkey % 2 = layout",
}
