"""Queries over repair decisions, tokens, exports and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import decisions as D
from foliant.plans.adapters import LEDGER_SQL, ledger, read
from foliant.plans.stock import BASE_SQL, base


def _candidates(s, d):
    li = read(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_discount").alias("k"), F.min("l_tax").alias("t"))
    return li.select("l_orderkey", "l_linenumber", F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("text"), (1 - F.col("k")).alias("confidence"), F.lit(1.0).alias("format"), (1 - F.col("t")).alias("agreement"), F.lit(0.8).alias("stroke"), F.lit(0.9).alias("centring"), F.lit(None).cast("double").alias("neighbour"))


def _filled(s, d):
    t = lambda c: F.col(c).cast("string")
    return base(s, d).select("l_partkey", D.closing_filled(t("op"), F.when(F.col("rec") == 0, "-").otherwise(t("rec")), t("iss"), F.when(F.col("blank"), "").otherwise(t("cl"))).alias("r")).select("l_partkey", "r.closing", "r.repair_source")


def _pairs(s, d):
    b = base(s, d)
    t = lambda c: F.col(c).cast("string")
    name = F.concat(F.lit("Drug "), t("l_partkey"))
    row = lambda n, label, iss: F.struct(F.lit(n).alias("n"), label.alias("label"), t("op").alias("opening"), t("rec").alias("receipt"), iss.alias("issue"), t("cl").alias("closing"))
    own = F.when(F.col("l_partkey") % 10 == 1, (F.col("iss") + 5).cast("string")).otherwise(t("iss"))
    return D.subtotal_pairs(b.select("l_partkey", F.explode(F.array(row(0, name, own), row(1, F.concat(name, F.lit(" S-Total")), t("iss")))).alias("r")).select("l_partkey", "r.*"), "l_partkey", "n")


def _noisy(s, d):
    li = read(s, d, "lineitem")
    word = F.when(F.col("l_linenumber") == 1, "Dell").when(F.col("l_linenumber") == 2, "Sample").otherwise("w")
    t = li.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), "l_linenumber", word.alias("text"), (F.col("l_linenumber") * 100.0 - 90).alias("y0"), (F.col("l_suppkey") % 100 * 1.0).alias("x0"), F.lit(800).alias("height"), F.lit(100).alias("width"))
    return D.without_noise(t, ["dell"], ["sample"]).groupBy("doc_id").agg(F.count("*").alias("kept"))


def _split(s, d):
    p = read(s, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.col("p_size").cast("string"), F.lit(" 10"))).otherwise(F.col("p_name")).alias("text"), F.lit(0.0).alias("x0"), F.lit(100.0).alias("x1"))
    return D.split_tokens(p).select("p_partkey", "part", "text", F.round("x0", 3).alias("x0"), F.round("x1", 3).alias("x1"))


QUERIES = {
    "best_candidate": lambda s, d: D.best_candidates(_candidates(s, d), "l_orderkey", "l_linenumber"),
    "repair_budget": lambda s, d: read(s, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")).select("l_partkey", D.repair_budget(F.col("n")).alias("budget")),
    "closing_fill": _filled,
    "subtotal_pairs": _pairs,
    "noise_filter": _noisy,
    "token_split": _split,
    "path_resolve": lambda s, d: read(s, d, "events").select("event_id", D.resolved(F.concat(F.lit('{"a":{"b":['), F.coalesce("props", F.lit("null")), F.lit("]}}")), "a.b[0].k").alias("k")),
    "date_validate": lambda s, d: read(s, d, "orders").select("o_orderkey", D.valid_date(F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "dd-MMM-yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.col("o_orderpriority"))).alias("ok")),
    "export_json": lambda s, d: ledger(s, d).select("id", D.json_export(F.col("original_filename"), F.col("document_type"), F.col("project_name"), F.struct(F.col("id").alias("n")), F.lit("m")).alias("json"), D.export_name(F.col("original_filename")).alias("name")),
    "export_text": lambda s, d: ledger(s, d).select("id", D.text_export(F.col("original_filename"), F.col("document_type"), F.struct(F.col("id").alias("n")), F.lit("body")).alias("text")),
}
_RULE = "=" * 40
SQL = {
    "best_candidate": """WITH c AS (SELECT l_orderkey, l_linenumber, round((1 - min(l_discount)) * .2::DOUBLE + 1 * .2::DOUBLE + (1 - min(l_tax)) * .2::DOUBLE + .8::DOUBLE * .15::DOUBLE + .9::DOUBLE * .15::DOUBLE, 4) AS score FROM lineitem GROUP BY 1, 2),
      r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber) AS n FROM c) SELECT l_orderkey, 'c' || l_linenumber AS text, score, score >= .88 AS accepted FROM r WHERE n = 1""",
    "repair_budget": "SELECT l_partkey, CASE WHEN count(*) <= 5 THEN count(*) WHEN count(*) <= 20 THEN 6 ELSE 0 END AS budget FROM lineitem GROUP BY 1",
    "closing_fill": f"WITH {BASE_SQL} SELECT l_partkey, CASE WHEN NOT blank THEN CAST(cl AS VARCHAR) WHEN op + rec - iss >= 0 THEN CAST(op + rec - iss AS VARCHAR) ELSE '' END AS closing, CASE WHEN blank AND op + rec - iss >= 0 THEN 'closing_balance' END AS repair_source FROM v",
    "subtotal_pairs": f"WITH {BASE_SQL} SELECT l_partkey, 0 AS n, 'Drug ' || l_partkey AS label, CASE WHEN l_partkey % 10 = 1 THEN 'CONFLICT' WHEN op = 0 AND iss = 0 AND rec = 0 AND cl > 0 THEN 'SUSPICIOUS' ELSE 'OK' END AS flag FROM v",
    "noise_filter": """WITH t AS (SELECT l_orderkey, l_linenumber AS n, l_suppkey % 100 AS x FROM lineitem), f AS (SELECT *, max(CASE WHEN n = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey) = 1 AS framed FROM t),
      g AS (SELECT *, n = 2 OR (framed AND (n * 100 - 90 < 160 OR x > 78)) AS gone FROM f) SELECT l_orderkey AS doc_id, CASE WHEN count(*) FILTER (NOT gone) = 0 THEN count(*) ELSE count(*) FILTER (NOT gone) END AS kept FROM g GROUP BY 1""",
    "token_split": """WITH p AS (SELECT p_partkey, CAST(p_size AS VARCHAR) AS a, length(CAST(p_size AS VARCHAR)) AS n, p_name FROM part) SELECT p_partkey, 0 AS part, a AS text, 0.0::DOUBLE AS x0, round(100.0 / (n + 3) * n, 3)::DOUBLE AS x1 FROM p WHERE p_partkey % 2 = 0
      UNION ALL SELECT p_partkey, 1, '10', round(100.0 / (n + 3) * (n + 1), 3)::DOUBLE, 100.0::DOUBLE FROM p WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 0, p_name, 0.0::DOUBLE, 100.0::DOUBLE FROM p WHERE p_partkey % 2 = 1""",
    "path_resolve": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    "date_validate": "SELECT o_orderkey, o_orderkey % 3 <> 2 AS ok FROM orders",
    "export_json": f"""WITH {LEDGER_SQL} SELECT id, '{{"filename":"' || original_filename || '","document_type":"' || document_type || '","project_name":' || coalesce('"' || project_name || '"', 'null') || ',"structured_data":{{"n":' || id || '}},"markdown":"m"}}' AS json, split_part(original_filename, '.', 1) || '_ocr.json' AS name FROM ledger""",
    "export_text": f"""WITH {LEDGER_SQL} SELECT id, '{_RULE}' || chr(10) || 'Document: ' || original_filename || chr(10) || 'Type: ' || document_type || chr(10) || '{_RULE}' || chr(10) || '{{"n":' || id || '}}' || chr(10) || chr(10) || 'body' AS text FROM ledger""",
}
