"""Sources of their own, exports, admission against brute force, ranks."""

from __future__ import annotations

import random
import zipfile

import pytest
from pyspark.sql import functions as F

from foliant.operators import payload, quality
from foliant.sources import formats, text
from foliant.streaming import lifecycle

X = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def workbook(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{X}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R><x Id="r1" Target="worksheets/s1.xml"/></R>')
        z.writestr("xl/worksheets/s1.xml", f'<worksheet xmlns="{X}"><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>Item</t></is></c><c r="B1"><v>5</v></c></row></sheetData></worksheet>')


def test_own_formats(spark, tmp_path):
    formats.register(spark)
    workbook(tmp_path / "a.xlsx")
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body><w:p><w:r><w:t>body</w:t></w:r></w:p></w:body></w:document>')
    assert [(r.sheet, r.row_idx, r.cells) for r in spark.read.format("workbook").load(str(tmp_path)).collect()] == [("S", 0, ["Item", "5"])]
    assert [r.markdown for r in spark.read.format("worddoc").load(str(tmp_path)).collect()] == ["body"]
    (tmp_path / "none").mkdir()
    assert spark.read.format("workbook").load(str(tmp_path / "none")).count() == 0
    (tmp_path / "none" / "old.xlsx").write_bytes(b"\xd0\xcf\x11\xe0....")
    with pytest.raises(Exception, match="binary office files"):
        spark.read.format("workbook").load(str(tmp_path / "none")).collect()


def test_pages_to_tables(spark):
    formats.register(spark)
    spark.createDataFrame([(1, "| a | b |\n|---|---|\n| 1 | 2 |\ntext\n| x |"), (2, None), (3, "plain")], "k long, markdown string").createOrReplaceTempView("texts")
    got = spark.sql("SELECT k, t.* FROM texts, LATERAL pages_to_tables(markdown) t ORDER BY 1, 2, 3").collect()
    assert [(r.k, r.table_idx, r.row_idx, r.cells) for r in got] == [(1, 0, 0, ["a", "b"]), (1, 0, 1, ["1", "2"]), (1, 1, 0, ["x"])]


def test_database(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", f"{tmp_path}/derby.log")
    try:
        spark.createDataFrame([(k, f"n{k}") for k in range(20)], "id int, name string").write.format("jdbc").option("url", url).option("dbtable", "things").save()
    except Exception as e:
        if "driver" in str(e).lower():
            pytest.skip("no database driver")
        raise
    got = formats.read_database(spark, url, "things", "id", 0, 20, 4)
    assert got.count() == 20 and got.rdd.getNumPartitions() == 4 and got.where("id = 7").first().name == "n7"


def test_robust_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Report\nItem,Qty\nP1,2\nP2,3,extra\n")
    workbook(tmp_path / "b.csv")
    got = {(r.path.rsplit("/", 1)[1], r.row_idx): (r.is_header, r.cells, r.skipped) for r in text.read_robust(spark, str(tmp_path)).collect()}
    assert got["b.csv", 0] == (True, ["Item", "5"], False) and len([k for k in got if k[0] == "b.csv"]) == 1
    assert got["a.csv", 2] == (False, ["P1", "2"], False) and (got["a.csv", 1][0] or got["a.csv", 3][0])


def test_exports(spark):
    assert [payload.export_kind(n) for n in ("JSON", "erp_data", "md", "txt", "csv")] == ["json", "erp", "text", "text", "csv"]
    with pytest.raises(ValueError, match="unknown export format"):
        payload.export_kind("pdf")
    df = spark.createDataFrame([('{"a":{"b":1},"n":"é"}', "text"), (None, "t"), ("{", "u")], "d string, m string")
    got = [r[0] for r in df.select(payload.pretty_text(F.col("d"), F.col("m"), F.lit("Doc"))).collect()]
    assert got[0] == '=== Doc ===\n\n{\n  "a": {\n    "b": 1\n  },\n  "n": "é"\n}\n\ntext' and got[1] == "=== Doc ===\n\n{}\n\nt" and got[2].startswith("=== Doc ===\n\n{}")
    assert [r[0] for r in df.select(payload.pruned(F.lit('{"a":0,"b":false,"c":[[]]}'))).limit(1).collect()] == ['{"a":0,"b":false}']


def test_admission_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(f"c{rng.randrange(3)}" if rng.random() < 0.9 else None, k, float(rng.randrange(0, 400))) for k in range(300)]
    df = spark.createDataFrame(rows, "client string, id long, s double").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz")).select("client", "ts", "id")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    got = {r.id: r.allowed for r in lifecycle.rate_limited(df, 4, 60.0).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, logs = {}, {}
    for client, k, s in sorted(rows, key=lambda r: (r[2], r[1])):
        log = logs.setdefault(client, [])
        want[k] = sum(s - t <= 60.0 for t in log) < 4
        if want[k]:
            log.append(s)
    assert got == want


def test_latency_is_the_exclusive_percentile(spark):
    import statistics

    rng = random.Random(5)
    rows = [("a", rng.random() * 100) for _ in range(237)] + [("b", 5.0)] * 30 + [("c", 1.0), ("c", 3.0), (None, 2.0), ("a", None)]
    got = {r.k: r for r in quality.latency(spark.createDataFrame(rows, "k string, s double"), "k", "s").collect()}
    a = sorted(s for k, s in rows if k == "a" and s is not None)
    assert got["a"].n == 237 and abs(got["a"].p90 - statistics.quantiles(a, n=10)[8]) < 1e-3 and abs(got["a"].median - statistics.median(a)) < 1e-3
    assert (got["b"].p90, got["b"].median, got["c"].median, got["c"].least, got["c"].most, got[None].p90) == (5.0, 5.0, 2.0, 1.0, 3.0, 2.0)


def test_snapshots(spark, tmp_path):
    names = [lifecycle.write_snapshot(spark.range(3), str(tmp_path), f"2024-01-0{k} 00:00:00") for k in (1, 2, 3)]
    df = spark.createDataFrame([("all", k, n) for k, n in enumerate(names)], "kind string, created_at int, name string")
    assert [r.kept for r in lifecycle.pruned_snapshots(df, 2).orderBy("created_at").collect()] == [False, True, True] and spark.read.parquet(names[2]).count() == 3
