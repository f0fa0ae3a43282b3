from __future__ import annotations

import datetime

from foliant.streaming import lifecycle


def stream(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def test_admission_over_a_stream(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    hits = [("c", at(s)) for s in (0, 1, 2, 60, 60.5, 61.5)] + [("d", at(0))]
    query = lifecycle.rate_limited_stream(stream(spark, tmp_path, hits, "client string, ts timestamp_ntz"), 2).writeStream.format("memory").queryName("admitted").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("admitted").orderBy("client", "ts").collect()
    assert [r.allowed for r in got] == [True, True, False, False, True, True, True]


def test_progress_over_a_stream(spark, tmp_path):
    pages = stream(spark, tmp_path, [(1, 1), (1, 2), (2, 1)], "document_id long, page_number int")
    query = lifecycle.progress_stream(pages).writeStream.format("memory").queryName("progress").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r.document_id, r.pages_done, r.last_page) for r in spark.table("progress").collect()} == {(1, 2, 2), (2, 1, 1)}
