from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import cells, ids, roles
from foliant.functions import text as T


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column.alias("x")).first()["x"]


def test_lenient_numbers(spark):
    cases = {"1,234.5": 1234.5, "₹10": 10.0, "12TAB": 12.0, "-3": -3.0, "TAB12": None, "--": None, "12d": 12.0, "nan": None, "inf": None, "": None}
    rows = spark.createDataFrame(list(cases.items()), "t string, want double").select("t", "want", cells.lenient_number(F.col("t")).alias("got")).collect()
    assert [(r.t, r.got) for r in rows] == list(cases.items())


def test_semantics(spark):
    cases = {"": "EMPTY", "-": "NOT_REPORTED", "n/a": "TEXT", "N/A": "NOT_REPORTED", "0.00": "ZERO", "0.000": "NUMERIC", "1,250.50": "NUMERIC", "12TAB": "TEXT"}
    rows = spark.createDataFrame(list(cases.items()), "t string, want string").select("t", cells.semantic(F.col("t")).alias("got")).collect()
    assert {r.t: r.got for r in rows} == cases


def test_verhoeff_finds_every_single_change(spark):
    good = "234123412346"
    changed = [good[:i] + str((int(good[i]) + d) % 10) + good[i + 1 :] for i in range(12) for d in range(1, 10)]
    rows = spark.createDataFrame([(good,), *((c,) for c in changed)], "v string").select("v", ids.verhoeff(F.col("v")).alias("ok")).collect()
    assert [r.v for r in rows if r.ok] == [good]


def test_identity_numbers(spark):
    cases = {"234123412346": (True, "ok", "2341 2341 2346"), "2341-2341-2346": (True, "ok", "2341 2341 2346"), "234123412364": (False, "checksum", "234123412364"), "134123412346": (False, "checksum", "134123412346"), "23412341234": (False, "format", "23412341234"), "XXXX XXXX 2346": (True, "masked", "XXXX XXXX 2346")}
    rows = spark.createDataFrame([(k,) for k in cases], "v string").select("v", ids.id12(F.col("v")).alias("r")).collect()
    assert {r.v: tuple(r.r) for r in rows} == cases
    rows = spark.createDataFrame([("ABCPE1234F",), ("ABCDE1234F",), ("ABCPE1234",)], "v string").select(ids.pan(F.col("v"))["reason"].alias("r")).collect()
    assert [r.r for r in rows] == ["ok", "holder_type", "format"]


def test_headers_become_distinct(spark):
    got = one(spark, roles.unique_headers(F.col("h")), h=["Qty", "Qty", "", "Qty", ""])
    assert got == ["Qty", "Qty_2", "column_3", "Qty_3", "column_5"]
    got = one(spark, roles.unique_headers(F.col("h")), h=["Qty", "Qty", "Qty_2"])
    assert len(set(got)) == 3


def test_totals_and_answers(spark):
    text = "| a : 12 |\nOp Val : 1,200.50\nPrinted By : X 9:07:57 AM\nOp Val : 7.00"
    assert one(spark, T.summary_totals(F.col("t")), t=text) == {"Op Val": 7.0}
    assert one(spark, T.answered(F.col("t")), t="The image shows a cat") == T.NOTHING
    assert one(spark, T.answered(F.col("t")), t="Total 5") == "Total 5"
    assert one(spark, T.without_footers(F.col("t")), t="a\nSheet1\nReady\nb") == "a\nb"


def test_packing(spark):
    got = spark.createDataFrame([("Para 500MG 1X10",), ("Para 500MG",), ("Gel 15GM tube 10'S",)], "d string").select(cells.packing(F.col("d")).alias("p")).collect()
    assert [r.p for r in got] == ["1X10", "", "10'S"]
