"""Queries over extracted fields and classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import fields as O
from foliant.plans.adapters import read

PATH_SQL = "CASE o_orderkey % 6 WHEN 0 THEN 'dob' WHEN 1 THEN 'email' WHEN 2 THEN 'summary' WHEN 3 THEN 'name' WHEN 4 THEN 'contact.phone' ELSE 'note' END"
VALUE_SQL = "CASE o_orderkey % 6 WHEN 0 THEN '01/02/' || {y} WHEN 1 THEN 'user' || o_custkey || CASE WHEN o_orderkey % 4 = 0 THEN '@x.org' ELSE '' END WHEN 2 THEN 'anything' WHEN 3 THEN 'Customer ' || o_custkey WHEN 4 THEN '+91 99999 ' || o_custkey ELSE 'N/A' END"


def _fields(s, d):
    o = read(s, d, "orders")
    value = F.expr(VALUE_SQL.replace("{y}", "(1950 + o_orderkey % 50)"))
    pages = F.concat(F.lit("Statement for customer "), F.col("o_custkey").cast("string"), F.lit(" dated 01/02/1960, phone +91 99999 "), F.col("o_custkey").cast("string"))
    return o.select(F.col("o_orderkey").alias("doc_id"), F.expr(PATH_SQL).alias("path"), value.alias("value"), pages.alias("page_text"), (F.col("o_orderkey") % 11 != 0).alias("legible"), (F.col("o_orderkey") % 13 == 0).alias("digital"), F.create_map(F.lit("issue_date"), F.lit("01-02-1966"), F.lit("enrollment_number"), F.lit("1")).alias("fields"))


STATUS_SQL = f"""f AS (SELECT o_orderkey AS doc_id, o_custkey, {PATH_SQL} AS path, {VALUE_SQL.replace('{y}', '(1950 + o_orderkey % 50)')} AS value, o_orderkey % 11 <> 0 AS legible, o_orderkey % 13 = 0 AS digital FROM orders),
  st AS (SELECT *, CASE WHEN value = 'N/A' OR NOT legible THEN 'flagged' WHEN path = 'email' AND NOT ends_with(value, '@x.org') THEN 'flagged' WHEN path = 'contact.phone' AND length(value) NOT BETWEEN 8 AND 20 THEN 'flagged' WHEN path = 'dob' AND value = '01/02/1966' THEN 'flagged' WHEN digital THEN 'exact' WHEN path = 'summary' THEN 'unchecked'
    WHEN path IN ('name', 'contact.phone') OR (path = 'dob' AND value = '01/02/1960') THEN 'verified' WHEN path = 'dob' AND contains('statementforcustomer' || o_custkey || 'dated01021960phone9199999' || o_custkey, replace(value, '/', '')) THEN 'verified' ELSE 'flagged' END AS status FROM f)"""


def _pages(s, d):
    return read(s, d, "documents").select("doc_id", "text", (F.col("doc_id") % 1000 + 100).cast("int").alias("w"), F.lit(800).alias("h"))


def _names(s, d):
    stem = F.element_at(F.array(*(F.lit(x) for x in ("company", "aadhar", "mypassport", "licence", "cv_1", "Stock-Report", "bill", "photo"))), (F.col("event_id") % 8 + 1).cast("int"))
    ext = F.element_at(F.array(*(F.lit(x) for x in (".pdf", ".png", ".xlsx"))), (F.col("event_id") % 3 + 1).cast("int"))
    asked = F.when(F.col("event_id") % 5 == 0, "ledger").otherwise("AUTO")
    return read(s, d, "events").select("event_id", F.concat(stem, ext).alias("name"), asked.alias("asked"))


TYPE_SQL = "CASE WHEN event_id % 3 = 2 THEN 'SPREADSHEET' WHEN event_id % 5 = 0 THEN 'LEDGER' ELSE ['PAN', 'AADHAAR', 'PASSPORT', 'DRIVING_LICENSE', 'RESUME', 'STOCK_STATEMENT', 'INVOICE', 'UNKNOWN'][event_id % 8 + 1] END"


def _routed(s, d):
    n = _names(s, d).withColumn("t", O.classified(F.col("name"), F.col("asked"))["document_type"])
    source = F.when(F.col("event_id") % 4 == 0, "DIGITAL_PDF").when(F.col("event_id") % 4 == 1, "SCREEN_PHOTO").otherwise("IMAGE")
    return n.select("event_id", O.route(F.col("t"), source, F.col("event_id") % 2 == 0, F.col("event_id") % 6 == 2).alias("pipeline"))


QUERIES = {
    "field_verdicts": lambda s, d: O.verdicts(_fields(s, d)).select("doc_id", "path", "status"),
    "grounding": lambda s, d: O.verification(O.verdicts(_fields(s, d))),
    "legibility": lambda s, d: _pages(s, d).select("doc_id", O.legible(F.col("text"), F.col("w"), F.col("h")).alias("legible")),
    "cross_field": lambda s, d: _fields(s, d).select("doc_id", F.coalesce(O.conflicts(F.col("path"), F.col("value"), F.col("fields")), F.lit(False)).alias("conflict")),
    "classify_type": lambda s, d: _names(s, d).select("event_id", O.classified(F.col("name"), F.col("asked")).alias("c")).select("event_id", "c.document_type", "c.confidence"),
    "route_pipeline": _routed,
    "upload_validate": lambda s, d: _names(s, d).select("event_id", O.upload_error(F.col("name"), F.col("event_id") * 20000, F.when(F.col("event_id") % 2 == 0, F.lit(b"%PDF-1")).otherwise(F.lit(b"\x89PNG")), ["pdf", "png"]).alias("error")),
}
SQL = {
    "field_verdicts": f"WITH {STATUS_SQL} SELECT doc_id, path, status FROM st",
    "grounding": f"""WITH {STATUS_SQL}, g AS (SELECT doc_id, legible, status FROM st) SELECT doc_id, legible, 1 AS fields, CAST(status = 'exact' AS BIGINT) AS exact, CAST(status = 'verified' AS BIGINT) AS verified, CAST(status = 'unchecked' AS BIGINT) AS unchecked, CAST(status = 'flagged' AS BIGINT) AS flagged,
      CASE WHEN NOT legible THEN .1 WHEN status = 'unchecked' THEN .5 WHEN status = 'flagged' THEN 0 ELSE 1 END::DOUBLE AS confidence, status = 'flagged' OR NOT legible AS needs_review FROM g""",
    "legibility": r"SELECT doc_id, least(doc_id % 1000 + 100, 800) >= 400 AND len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+')) >= 5 AS legible FROM documents",
    "cross_field": f"WITH {STATUS_SQL} SELECT doc_id, path = 'dob' AND value = '01/02/1966' AS conflict FROM f",
    "classify_type": f"SELECT event_id, {TYPE_SQL} AS document_type, CASE WHEN event_id % 3 = 2 OR event_id % 5 = 0 THEN 1.0 ELSE [.99, .99, .99, .99, .99, .95, .95, 0.0][event_id % 8 + 1] END::DOUBLE AS confidence FROM events",
    "route_pipeline": f"""WITH t AS (SELECT event_id AS e, {TYPE_SQL} AS t FROM events) SELECT e AS event_id, CASE WHEN t IN ('PAN', 'AADHAAR', 'PASSPORT', 'DRIVING_LICENSE') THEN 'ID_CARD_PIPELINE' WHEN t IN ('RESUME', 'UNKNOWN') THEN 'GENERAL_VLM_PIPELINE' WHEN e % 4 = 0 THEN 'NATIVE_PDF_TABLE_PIPELINE'
      WHEN e % 6 = 2 THEN 'PERSPECTIVE_TABLE_PIPELINE' WHEN e % 2 = 0 OR t IN ('STOCK_STATEMENT', 'LEDGER', 'SPREADSHEET') THEN 'COORDINATE_TABLE_PIPELINE' ELSE 'GENERAL_VLM_PIPELINE' END AS pipeline FROM t""",
    "upload_validate": "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 'extension' WHEN event_id * 20000 > 52428800 THEN 'size' WHEN (event_id % 3 = 0) <> (event_id % 2 = 0) THEN 'content' END AS error FROM events",
}
