from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import ledger, search, stock
from foliant.operators import fields as fields_


def test_summary_of_nothing(spark):
    empty = spark.createDataFrame([], "id long, status string, confidence double, processing_time double, prompt_tokens long, completion_tokens long")
    r = ledger.summary(empty).first()
    assert (r.total_documents, r.avg_confidence, r.avg_time, r.total_tokens) == (0, 1.0, 0.0, 0)


def test_stock_verdicts(spark):
    rows = [["Alpha", "100", "50", "30", "120"], ["Beta", "10", "5", "2", "8"], ["Gamma", "7", "", "2", ""], ["Delta", "", "", "", "4"], ["Epsilon", "-", "1", "1", "-"], ["Total", "1", "1", "1", "1"], ["Total Care Tab", "1", "1", "1", "1"]]
    t = spark.createDataFrame([(1, ["Item", "Opening", "Receipt", "Issue", "Closing"], rows)], "table_id long, columns array<string>, rows array<array<string>>")
    got = stock.stock_rows(t).orderBy("row_index").collect()
    assert [r.status for r in got] == ["VERIFIED", "MISMATCH", "REVIEW", "UNVERIFIED", "UNVERIFIED", "TOTAL_ROW", "TOTAL_ROW"]
    assert [r.calculated for r in got[:3]] == [120.0, 13.0, 5.0] and got[1].discrepancy == 5.0


def test_stock_confidence_example(spark):
    rows = [["A", "10", "5", "3", "12"], ["B", "4", "1", "2", "3"], ["Total", "14", "6", "5", "15"]]
    t = spark.createDataFrame([(1, ["Item", "Opening", "Receipt", "Issue", "Closing"], rows)], "table_id long, columns array<string>, rows array<array<string>>")
    assert stock.confidence(stock.stock_rows(t)).first().confidence == 0.9885


def test_search_keeps_records_without_result(spark):
    rec = spark.createDataFrame([(1, "a.pdf", "X", "en"), (2, "b.pdf", "X", "en")], "id long, name string, document_type string, language string")
    res = spark.createDataFrame([(2, "hello")], "id long, markdown string")
    ids = lambda q: sorted(r.id for r in search.search(rec, res, ["name", "markdown"], q).collect())
    assert ids("a.pdf") == [1] and ids("HELLO") == [2] and ids("  ") == [1, 2] and ids("") == [1, 2] and ids("50%") == []


def test_placeholders_and_grounding(spark):
    f = spark.createDataFrame([(1, "name", "John Smith Junior", "john  smith junior", True, False), (1, "note", "N/A", "x", True, False), (1, "name", "Invented Person Here", "none of it", True, False)], "doc_id long, path string, value string, page_text string, legible boolean, digital boolean")
    f = f.withColumn("fields", F.create_map(F.lit("k"), F.lit("v")))
    assert [r.status for r in fields_.verdicts(f).collect()] == ["verified", "flagged", "flagged"]
