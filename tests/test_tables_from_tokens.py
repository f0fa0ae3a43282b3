"""Column models and logical rows against golden tables made by hand."""

from __future__ import annotations

import pytest

from foliant.operators.assembly import Table, Line, assembled, table_grid
from foliant.operators.columns import Model, Word, body_bands, body_line, label_line, named_strips, page_columns, parted, tiers


def line(y, *words):
    return [Word(t, float(a), float(b), float(y), float(y + 14)) for t, a, b in words]


def body(y, name, *figures):
    return line(y, (name, 100, 220), *((f, 300 + 120 * k, 330 + 120 * k) for k, f in enumerate(figures)))


def invented():
    """Labels that no word list knows, under a letterhead with figures of its own."""
    return [
        line(20, ("SHREE AGENCIES", 100, 400)), line(45, ("GSTIN 09AABCU9603R1ZM", 100, 340)), line(70, ("From 01/05/2026 To 29/05/2026", 100, 380)),
        line(100, ("Zorb", 100, 180), ("Wix", 300, 350), ("Klar", 420, 470), ("Vint", 540, 590), ("Frip", 660, 710)),
        body(130, "ALPHA TAB", "10", "25", "5", "30"), body(160, "BETA CAP", "40", "12", "2", "50"), body(190, "GAMMA SYP", "7", "60", "9", "58"), body(220, "DELTA INJ", "3", "14", "1", "16"),
    ]


def test_header_and_body_without_known_words():
    lines = invented()
    assert body_line(lines) == 4 and body_bands(lines[4:]) == [315, 435, 555, 675]
    assert label_line(lines, 4, body_bands(lines[4:])) == 3
    top, end, columns, uncertain = page_columns(lines, [], 900.0)
    assert (top, end) == (3, 3) and [c[0] for c in columns] == ["Description", "Wix", "Klar", "Vint", "Frip"] or [c[0] for c in columns] == ["Zorb", "Wix", "Klar", "Vint", "Frip"]
    prose = [line(20, ("A paragraph of running text that wraps", 100, 700)), line(45, ("over two lines and names nothing", 100, 690)), body(100, "A", "10", "25"), body(130, "B", "40", "12")]
    assert label_line(prose, 2, body_bands(prose[2:])) is None
    apart = [line(20, ("KAKKAR", 100, 300)), line(50, ("Zorb", 100, 180), ("Wix", 300, 350), ("Klar", 420, 470)), body(80, "A", "20", "4"), line(110, ("GURMAIL CENTRE", 100, 340)), body(140, "B", "21", "10"), body(170, "C", "3", "7")]
    assert body_line(apart) == 2


def test_tiers_join_where_they_stand_over_bands():
    lines = invented()
    lines[3:4] = [line(80, ("Zed", 300, 480), ("Mov", 540, 710)), line(100, ("Zorb", 100, 180), ("Wix", 300, 350), ("Klar", 420, 470), ("Vint", 540, 590)), line(118, ("Item", 100, 180), ("Frip", 660, 710)), line(124, ("SPECIAL LIST", 100, 260))]
    bands = body_bands(lines[7:])
    assert tiers(lines, 4, 7, bands) == (3, 5)
    top, end, columns, _ = page_columns(lines, [], 900.0)
    assert (top, end) == (3, 5) and [c[0] for c in columns][1:] == ["Zed Wix", "Zed Klar", "Mov Vint", "Mov Frip"]
    dashed = lines[:6] + [line(122, ("ADABOR GEL", 100, 230), ("-", 655, 670))] + lines[7:]
    assert tiers(dashed, 4, 7, bands) == (3, 5)


def test_labels_right_of_the_header_are_found_above_it():
    lines = invented()
    lines[2] = line(70, ("From 01/05/2026 To 29/05/2026", 100, 380), ("Value", 780, 830))
    for k in range(4, 8):
        lines[k].append(Word(f"{k}1.5", 785.0, 815.0, lines[k][0].y0, lines[k][0].y1))
    assert [c[0] for c in page_columns(lines, [], 900.0)[2]][-1] == "Value"


def test_compound_labels_are_cut_between_bands():
    got = parted(Word("Op.BalReceipt", 100, 230, 0, 10), [120, 200])
    assert [w.text for w in got] == ["Op.Bal", "Receipt"] and got[0].x1 == got[1].x0 == 160
    assert [w.text for w in parted(Word("Op.BalReceipt", 100, 230, 0, 10), [120])] == ["Op.BalReceipt"]
    assert [w.text for w in parted(Word("opbalreceipt", 100, 230, 0, 10), [120, 200])] == ["opbalreceipt"]


def test_names_come_from_shared_baselines():
    words = [*line(100, ("PRODUCT", 50, 150), ("NANE", 160, 220), ("PACKING", 250, 350), ("Op.Bal.", 380, 460)), *line(125, ("Qty.", 380, 440), ("TAB", 250, 300))]
    assert [s.name for s in named_strips(words, [])] == ["PRODUCT", "Name", "PACKING TAB", "Op.Bal. Qty."] or [s.name for s in named_strips(words, [])] == ["PRODUCT", "Name", "PACKING", "Op.Bal. Qty."]
    banner = [*line(60, ("ACME LTD", 60, 140)), *line(100, ("Item", 50, 150), ("Qty", 200, 250))]
    assert [s.name for s in named_strips(banner, [])] == ["Item", "Qty"]


def drugs(n):
    return [line(130 + 30 * k, (f"DRUG {'ABCDEF'[k]}", 100, 250), ("10 TAB", 420, 460), (f"{k + 1}00", 490, 520), (f"{k}5", 590, 620), (f"{k}2", 730, 755), (f"{k}13", 890, 920)) for k in range(n)]


def test_missing_columns_need_evidence():
    header = [line(100, ("ITEM DESCRIPTION", 100, 400), ("ISSUE", 700, 780), ("CLOSING", 850, 950))]
    full = Model(header, drugs(3), [], 1200.0)
    names = [n for n, _, _ in full.bounds()]
    assert names == ["ITEM DESCRIPTION", "Packing", "Col_Num_1_1", "Col_Num_1_2", "ISSUE", "CLOSING"] and not full.uncertain
    assert all(any(a <= x < b for _, a, b in full.bounds()) for x in (505, 605))
    weak = Model(header, drugs(2), [], 1200.0)
    assert len(weak.bounds()) == 3 and weak.uncertain
    ruled = Model(header, drugs(2), [(560.0, 561.0, 100.0, 400.0)], 1200.0)
    assert len(ruled.bounds()) == 5 and not ruled.uncertain


def test_missing_description_and_trailing_columns():
    header = [line(100, ("Wix", 300, 350), ("Klar", 420, 470))]
    data = [body(130 + 30 * k, f"DRUG {k}", str(k), "1", "7") for k in range(4)]
    model = Model(header, data, [], 900.0)
    assert [n for n, _, _ in model.bounds()] == ["Description", "Wix", "Klar", "Col_Num_3_1"]
    few = Model(header, data[:2], [], 900.0)
    assert [n for n, _, _ in few.bounds()] == ["Wix", "Klar"] and few.uncertain
    named = Model([[*header[0], Word("Age", 545.0, 570.0, 80.0, 94.0)]], data, [], 900.0)
    assert [n for n, _, _ in named.bounds()][-1] == "Age"


def test_a_label_left_of_its_figures_names_their_column():
    header = [line(100, ("Item", 100, 220), ("Opening", 280, 330), ("Closing", 600, 660))]
    data = [line(130 + 30 * k, (f"DRUG {k}", 100, 210), (str(k), *((290, 310) if k == 5 else (395, 415))), ("9", 620, 640)) for k in range(12)]
    model = Model(header, data, [], 900.0)
    assert [n for n, _, _ in model.bounds()] == ["Item", "Opening", "Closing"]
    noisy = Model([[*header[0], Word("C", 700.0, 710.0, 100.0, 114.0)]], data, [], 900.0)
    assert [n for n, _, _ in noisy.bounds()] == ["Item", "Opening", "Closing"] and noisy.uncertain


def table(*rows, rulings=(), names=("Item", "Pack", "Opening", "In", "Out", "Closing")):
    t = Table(list(names), list(rulings))
    texts = [" ".join(c for c in r if c) for r in rows]
    for k, r in enumerate(rows):
        t.read(Line(list(r) + [""] * (len(names) - len(r)), texts[k], 20.0 * k, 20.0 * k + 12), texts[k + 1] if k + 1 < len(rows) else None)
    return [(r.kind, "|".join(r.cells)) for r in t.rows], t.foot


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([("ACME DIVISION",), ("A TAB", "", "1")], [("PARTY_OR_HEADER", "ACME DIVISION|||||"), ("PRODUCT", "A TAB||1|||")]),
        ([("A TABLET", "", "1"), ("Page 1 of 2",), ("BATCH: X EXP: 10/26",)], [("PRODUCT", "A TABLET BATCH: X EXP: 10/26||1|||")]),
        ([("A TABLET", "", "1"), ("", "10tab"), ("GEL",)], [("PRODUCT", "A TABLET GEL||1|||")]),
        ([("A TABLET", "", "1"), ("B CAPSULE", "", "", "", "2")], [("PRODUCT", "A TABLET||1|||"), ("PRODUCT", "B CAPSULE||||2|")]),
        ([("LONG TABLET",), ("LONG TABLET", "S-Total", "1")], [("PRODUCT", "LONG TABLET||1|||")]),
        ([("LONG TABLET", "5S"), ("LONG TABLET", "", "1")], [("PRODUCT", "LONG TABLET|5S|1|||")]),
        ([("LONG TABLET", "", "1", "2"), ("LONG TABLET", "", "", "", "3", "4")], [("PRODUCT", "LONG TABLET||1|2|3|4")]),
        ([("LONG TABLET 500", "", "1"), ("LONG TABLET 650", "", "", "", "3")], [("PRODUCT", "LONG TABLET 500||1|||"), ("PRODUCT", "LONG TABLET 650||||3|")]),
        ([("A TABLET", "", "1", "2", "3", "4"), ("", "", "1", "2", "3", "4")], [("PRODUCT", "A TABLET||1|2|3|4"), ("SUBTOTAL", "A TABLET|S-Total|1|2|3|4")]),
        ([("A TABLET", "", "1"), ("", "", "", "2", "3", "4")], [("PRODUCT", "A TABLET||1|2|3|4")]),
        ([("A TABLET", "", "1"), ("S-Total", "", "1")], [("PRODUCT", "A TABLET||1|||"), ("SUBTOTAL", "A TABLET||1|||")]),
        ([("A TABLET", "", "1", "2"), ("", "S-Total", "1"), ("B CAPSULE", "", "", "2", "3")], [("PRODUCT", "A TABLET||1|2||"), ("SUBTOTAL", "A TABLET|S-Total|1|2|3|"), ("PRODUCT", "B CAPSULE|||||")]),
        ([("A TABLET", "", "1", "2"), ("", "S-Total", "", "", "", "7"), ("B CAPSULE", "", "", "2", "3")], [("PRODUCT", "A TABLET||1|2||"), ("SUBTOTAL", "A TABLET|S-Total|0.000|2|3|7"), ("PRODUCT", "B CAPSULE|||||")]),
        ([("A TABLET", "", "1"), ("", "TOTAL", "9")], [("PRODUCT", "A TABLET||1|||"), ("TOTAL", "TOTAL||9|||")]),
        ([("A TABLET", "", "1", "1", "1", "1"), ("", "", "9"), ("Grand Total",), ("B CAPSULE", "", "2")], [("PRODUCT", "A TABLET||1|1|1|1"), ("TOTAL", "Grand Total||9|||"), ("PRODUCT", "B CAPSULE||2|||")]),
        ([("A TABLET", "", "1"), ("Total", "", "9"), ("", "", "", "8"), ("B CAPSULE", "", "2")], [("PRODUCT", "A TABLET||1|||"), ("TOTAL", "Total||9|8||")]),
        ([("", "", ""), ("A TABLET", "", "1"), ("help find F1",), ("B CAPSULE", "", "2")], [("PRODUCT", "A TABLET||1|||")]),
        ([("*1 LONG TAB", "", "1"), ("*2 LONG TAB", "", "", "", "3")], [("PRODUCT", "*1 LONG TAB||1|||"), ("PRODUCT", "*2 LONG TAB||||3|")]),
    ],
)
def test_rows(rows, want):
    assert table(*rows)[0] == want


def test_rulings_part_rows_and_footers_end_tables():
    assert table(("A TABLET", "", "1"), ("GEL",), rulings=[16.0])[0] == [("PRODUCT", "A TABLET||1|||"), ("PRODUCT", "GEL|||||")]
    for foot in ("Printed By : K 1", "a@b.co", "Phone: 1", "F2 = Save", "0161234567890", "x | y | z", "www.x"):
        assert table(("A TABLET", "", "1"), (foot,), ("B CAPSULE", "", "2")) == ([("PRODUCT", "A TABLET||1|||")], [foot, "B CAPSULE 2"])


def test_tokens_to_tables(spark):
    tokens = [(d, 1, 100 * k + n, w.text, w.x0, w.x1, w.y0 + 3 * (d % 2), w.y1 + 3 * (d % 2)) for d in (7, 8) for k, row in enumerate(invented()) for n, w in enumerate(row)]
    tokens += [(9, 1, 1, "alone", 1.0, 2.0, 1.0, 2.0)]
    df = spark.createDataFrame(tokens, "doc_id long, page int, seq long, text string, x0 double, x1 double, y0 double, y1 double")
    got = {(r.doc_id, r.row_idx): (r.row_type, r.cells, r.names) for r in table_grid(df).collect()}
    assert {k[0] for k in got} == {7, 8} and got[7, 1] == got[8, 1]
    assert got[7, 1][:2] == ("PRODUCT", ["BETA CAP", "40", "12", "2", "50"]) and len(got[7, 1][2]) == 5
    flat = spark.createDataFrame([(7, 1, 0.0, 900.0, 10.0, 11.0), (7, 1, 260.0, 261.0, 90.0, 300.0)], "doc_id long, page int, x0 double, x1 double, y0 double, y1 double")
    assert {(r.doc_id, r.row_idx): (r.row_type, r.cells, r.names) for r in table_grid(df, flat).collect()} == got
    assert table_grid(df.where("false")).count() == 0


def test_assembled_takes_bare_lines(spark):
    df = spark.createDataFrame([(1, 0, ["A TABLET", "1"], ["Item", "Qty"]), (1, 1, ["GEL", ""], ["Item", "Qty"]), (1, 2, [None, "5"], ["Item", "Qty"]), (2, 0, ["x"], ["Item", "Qty"])], "t long, line_idx int, cells array<string>, names array<string>")
    got = sorted((r.t, r.row_idx, r.row_type, r.cells) for r in assembled(df, ["t"]).collect())
    assert got == [(1, 0, "PRODUCT", ["A TABLET GEL", "1"]), (1, 1, "SUBTOTAL", ["A TABLET GEL", "5"]), (2, 0, "PRODUCT", ["x", ""])]
