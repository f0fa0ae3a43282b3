"""Ledger, search and export queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import ledger as L
from foliant.operators import search as S
from foliant.plans.adapters import LEDGER_SQL, ledger, read

TOKENS = "coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0)"


def _summary_sql(where: str = "") -> str:
    return f"""WITH {LEDGER_SQL} SELECT count(*) AS total_documents, count(*) FILTER (status = 'COMPLETED') AS completed, count(*) FILTER (status = 'FAILED') AS failed,
  count(*) FILTER (status = 'PROCESSING') AS processing, round(coalesce(nullif(avg(confidence) FILTER (status = 'COMPLETED'), 0), 1.0), 4) AS avg_confidence,
  round(coalesce(avg(processing_time) FILTER (status = 'COMPLETED'), 0), 2) AS avg_time, CAST(coalesce(sum(prompt_tokens), 0) AS BIGINT) AS prompt_tokens,
  CAST(coalesce(sum(completion_tokens), 0) AS BIGINT) AS completion_tokens, CAST(coalesce(sum({TOKENS}), 0) AS BIGINT) AS total_tokens,
  round(coalesce(sum({TOKENS}) / nullif(count(*), 0), 0), 1) AS tokens_per_request FROM ledger {where}"""


def _records(s, d):
    docs = read(s, d, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("original_filename"), F.col("source").alias("document_type"), F.col("lang").alias("language"), F.col("text").alias("raw_text"))


def _results(s, d):
    return read(s, d, "labels").select(F.col("doc_id").alias("id"), F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("markdown_text"))


COLUMNS = ["original_filename", "document_type", "language", "raw_text", "markdown_text"]
SEARCH_SQL = """WITH r AS (SELECT doc_id AS id, source || '_' || doc_id || '.pdf' AS original_filename, source AS document_type, lang AS language, text AS raw_text FROM documents),
  x AS (SELECT doc_id AS id, 'quality ' || quality AS markdown_text FROM labels), j AS (SELECT r.*, x.markdown_text FROM r LEFT JOIN x USING (id))
  SELECT id, original_filename, markdown_text FROM j WHERE {where} (original_filename ILIKE '{q}' OR document_type ILIKE '{q}' OR language ILIKE '{q}' OR raw_text ILIKE '{q}' OR markdown_text ILIKE '{q}')"""


def _pages(s, d):
    c = read(s, d, "conversations")
    return c.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("page_number"), "text")


def _fields(s, d):
    c = read(s, d, "customer")
    fields = F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in ("c_name", "c_mktsegment", "c_nationkey")))
    return S.csv_rows(c, "c_custkey", F.concat(F.lit("Document,"), F.col("c_custkey").cast("string")), fields)


NOW = "TIMESTAMP '2024-01-15 00:00:00'"

QUERIES = {
    "ledger_summary": lambda s, d: L.summary(ledger(s, d)),
    "ledger_by_project": lambda s, d: L.by_project(ledger(s, d)),
    "ledger_type_distribution": lambda s, d: L.type_distribution(ledger(s, d)),
    "ledger_type_share": lambda s, d: L.type_share(ledger(s, d)),
    "ledger_project_detail": lambda s, d: L.summary(L.in_project(ledger(s, d), " PROJ_1 ")),
    "ledger_recent_topn": lambda s, d: L.recent(ledger(s, d), 10).select("id", "status", "document_type"),
    "ledger_token_fold": lambda s, d: L.token_usage(ledger(s, d).withColumn("document_id", F.col("id") % 997)),
    "ledger_status_groups": lambda s, d: L.status_groups(ledger(s, d)),
    "status_progress": lambda s, d: L.progress(read(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 8).cast("int").alias("page_count")), read(s, d, "lineitem").select(F.col("l_orderkey").alias("document_id"))),
    "history_search": lambda s, d: S.search(_records(s, d), _results(s, d), COLUMNS, " ATION ", None, "en").select("id", "original_filename", "markdown_text"),
    "history_search_null_right": lambda s, d: S.search(_records(s, d), _results(s, d), COLUMNS, "src1_").select("id", "original_filename", "markdown_text"),
    "document_pages_combined": lambda s, d: S.combined_pages(_pages(s, d), "document_id", "page_number", "text"),
    "upload_dedupe": lambda s, d: S.first_uploads(ledger(s, d), "original_filename", "id").select("id", "original_filename", "kept"),
    "stored_names": lambda s, d: S.stored_names(ledger(s, d), ledger(s, d).where("id % 50 = 0").select(F.col("original_filename").alias("stored_filename")), "original_filename", "id").select("id", "stored_filename"),
    "export_csv_rows": _fields,
    "copy_missing_ids": lambda s, d: S.missing(read(s, d, "documents"), read(s, d, "labels"), "doc_id").select("doc_id", "source"),
    "cascade_delete": lambda s, d: S.without_deleted(read(s, d, "labels"), read(s, d, "documents").where("lang = 'en'"), "doc_id", "doc_id").select("doc_id", "quality"),
    "retention_files": lambda s, d: S.kept_files(ledger(s, d).select(F.col("original_filename").alias("path"), F.col("created_at").alias("modified"), F.col("id").alias("record_id")), ledger(s, d).where("id % 3 = 0"), 7, F.expr(NOW)).select("record_id", "kept"),
    "retention_keep": lambda s, d: S.retained(ledger(s, d), 7, F.expr(NOW)).select("id", "status"),
}
SQL = {
    "ledger_summary": _summary_sql(),
    "ledger_project_detail": _summary_sql("WHERE lower(project_name) = 'proj_1' OR lower(department) = 'proj_1'"),
    "ledger_by_project": f"""WITH {LEDGER_SQL}, g AS (SELECT coalesce(project_name, department) AS project, count(*) AS documents, sum({TOKENS}) AS t, avg(confidence) AS c, avg(processing_time) AS p FROM ledger GROUP BY 1)
      SELECT coalesce(nullif(project, ''), 'DefaultProject') AS project, documents, CAST(coalesce(t, 0) AS BIGINT) AS total_tokens, round(c, 4) AS avg_confidence, round(p, 2) AS avg_time FROM g""",
    "ledger_type_distribution": f"WITH {LEDGER_SQL} SELECT coalesce(nullif(document_type, ''), 'UNKNOWN') AS document_type, count(*) AS documents FROM ledger GROUP BY 1",
    "ledger_type_share": f"WITH {LEDGER_SQL} SELECT coalesce(nullif(document_type, ''), 'UNKNOWN') AS document_type, count(*) AS documents, CAST(round(count(*) * 100 / sum(count(*)) OVER ()) AS BIGINT) AS percent FROM ledger GROUP BY 1",
    "ledger_recent_topn": f"WITH {LEDGER_SQL} SELECT id, status, document_type FROM ledger ORDER BY created_at DESC, id DESC LIMIT 10",
    "ledger_token_fold": f"WITH {LEDGER_SQL} SELECT id % 997 AS document_id, CAST(coalesce(sum(prompt_tokens), 0) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum({TOKENS}) AS BIGINT) AS total_tokens FROM ledger GROUP BY 1",
    "ledger_status_groups": f"WITH {LEDGER_SQL} SELECT regexp_extract(status, '^([A-Z]+)', 1) AS status, count(*) AS documents FROM ledger GROUP BY 1",
    "status_progress": """WITH p AS (SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY 1) SELECT o_orderkey AS id, o_orderstatus AS status, coalesce(n, 0) AS pages_done,
      CAST(floor(coalesce(n, 0) * 100 / coalesce(nullif(o_orderkey % 8, 0), 1)) AS BIGINT) AS percent FROM orders LEFT JOIN p ON o_orderkey = id""",
    "history_search": SEARCH_SQL.format(where="language = 'en' AND", q="%ATION%"),
    "history_search_null_right": SEARCH_SQL.format(where="", q="%src1_%"),
    "document_pages_combined": "SELECT conv_id AS document_id, string_agg('<!-- Page ' || turn || ' -->' || chr(10) || coalesce(text, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn, coalesce(text, '')) AS markdown FROM conversations GROUP BY 1",
    "upload_dedupe": f"WITH {LEDGER_SQL} SELECT id, original_filename, row_number() OVER (PARTITION BY original_filename ORDER BY id) = 1 AS kept FROM ledger",
    "stored_names": f"""WITH {LEDGER_SQL}, t AS (SELECT DISTINCT original_filename AS f FROM ledger WHERE id % 50 = 0), r AS (SELECT id, original_filename AS f, row_number() OVER (PARTITION BY original_filename ORDER BY id) AS n FROM ledger)
      SELECT id, CASE WHEN n > 1 OR t.f IS NOT NULL THEN substr(md5(r.f || '/' || id), 1, 8) || '_' || r.f ELSE r.f END AS stored_filename FROM r LEFT JOIN t ON r.f = t.f""",
    "export_csv_rows": """SELECT c_custkey, CAST(u.ord AS INT) AS ord, u.line FROM (SELECT c_custkey, unnest([{'ord': 0, 'line': 'Document,' || c_custkey}, {'ord': 1, 'line': ''}, {'ord': 2, 'line': 'Structured Field,Value'},
      {'ord': 3, 'line': '"c_name","' || c_name || '"'}, {'ord': 4, 'line': '"c_mktsegment","' || c_mktsegment || '"'}, {'ord': 5, 'line': '"c_nationkey","' || c_nationkey || '"'}]) AS u FROM customer)""",
    "copy_missing_ids": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "cascade_delete": "SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')",
    "retention_files": f"WITH {LEDGER_SQL} SELECT id AS record_id, id % 3 = 0 OR created_at >= {NOW} - INTERVAL 7 DAYS AS kept FROM ledger",
    "retention_keep": f"WITH {LEDGER_SQL} SELECT id, status FROM ledger WHERE created_at >= {NOW} - INTERVAL 7 DAYS",
}
