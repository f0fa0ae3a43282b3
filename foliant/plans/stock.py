"""Queries over stock tables made from line items: ten parts to a table, a printed total under them."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import stock as S
from foliant.plans.adapters import read

COLUMNS = ["Item", "Opening", "Receipt", "Issue", "Closing"]


def base(s, d):
    q = lambda flag: F.coalesce(F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_quantity").cast("decimal(18,2)"))), F.lit(0)).cast("bigint")
    b = read(s, d, "lineitem").groupBy("l_partkey").agg(q("A").alias("op"), q("R").alias("rec"), q("N").alias("iss"))
    closing = F.col("op") + F.col("rec") - F.col("iss") + F.when(F.col("l_partkey") % 10 == 0, 7).otherwise(0)
    return b.select((F.col("l_partkey") / 10).cast("bigint").alias("table_id"), "l_partkey", "op", "rec", "iss", closing.alias("cl"), (F.col("l_partkey") % 17 == 0).alias("blank"))


BASE_SQL = """b AS (SELECT l_partkey // 10 AS table_id, l_partkey, CAST(coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0) AS BIGINT) AS op, CAST(coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) AS BIGINT) AS rec,
  CAST(coalesce(sum(l_quantity) FILTER (l_returnflag = 'N'), 0) AS BIGINT) AS iss FROM lineitem GROUP BY l_partkey), c AS (SELECT *, op + rec - iss + CASE WHEN l_partkey % 10 = 0 THEN 7 ELSE 0 END AS cl, l_partkey % 17 = 0 AS blank FROM b),
  v AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY l_partkey) AS row_index, CASE WHEN NOT blank THEN cl END AS closing, CASE WHEN blank THEN 'REVIEW' WHEN l_partkey % 10 = 0 THEN 'MISMATCH' ELSE 'VERIFIED' END AS status FROM c)"""


def tables(s, d):
    t = lambda c: F.col(c).cast("string")
    row = F.array(F.concat(F.lit("P"), t("l_partkey")), t("op"), t("rec"), t("iss"), F.when(F.col("blank"), "").otherwise(t("cl")))
    total = F.array(F.lit("Total"), *(F.sum(c).cast("string") for c in ("op", "rec", "iss", "cl")))
    g = base(s, d).groupBy("table_id").agg(F.sort_array(F.collect_list(F.struct("l_partkey", row.alias("row")))).alias("r"), total.alias("total"))
    return g.select("table_id", F.array(*(F.lit(c) for c in COLUMNS)).alias("columns"), F.concat(F.transform("r", lambda x: x["row"]), F.array("total")).alias("rows"))


def _flat(s, d):
    b = base(s, d)
    t = lambda c: F.col(c).cast("string")
    return b.select("table_id", F.col("l_partkey").alias("row_index"), F.concat(F.lit("P"), t("l_partkey")).alias("label"), t("op").alias("opening"), F.when(F.col("rec") == 0, "-").otherwise(t("rec")).alias("receipt"), t("iss").alias("issue"), F.when(F.col("blank"), "").otherwise(t("cl")).alias("closing"), F.lit("0.00").alias("amount"))


_CELLS = {q: q for q in S.QUANTITIES}


def _bled(s, d):
    """Pairs of rows of one printed opening and issue."""
    r = _flat(s, d).withColumn("row_index", F.col("row_index"))
    same = r.withColumns({"opening": F.when(F.col("row_index") % 4 < 2, "50").otherwise(F.col("opening")), "issue": F.when(F.col("row_index") % 4 < 2, "9").otherwise(F.col("issue"))})
    return S.bleed(same).select("table_id", "row_index", "opening", "receipt", "issue", "amount", "repair_source")


QUERIES = {
    "stock_row_check": lambda s, d: S.stock_rows(tables(s, d)).select("table_id", "row_index", "product", "closing", "status", "calculated", "discrepancy"),
    "stock_footing": lambda s, d: S.footing(S.stock_rows(tables(s, d))),
    "stock_confidence": lambda s, d: S.confidence(S.stock_rows(tables(s, d))),
    "stock_review": lambda s, d: S.reviews(tables(s, d).unionAll(s.read.parquet(f"{d}/region.parquet").select((-F.col("r_regionkey") - 1).cast("long").alias("table_id"), F.array(F.lit("Item")).alias("columns"), F.array().cast("array<array<string>>").alias("rows")))),
    "row_arithmetic": lambda s, d: S.arithmetic_flags(_flat(s, d), _CELLS).select("table_id", "row_index", "flag"),
    "row_arithmetic_audit": lambda s, d: S.audit(_flat(s, d), _CELLS, "table_id"),
    "ledger_heal_bleed": _bled,
}
_W = f"WITH {BASE_SQL}"
SQL = {
    "stock_row_check": f"""{_W} SELECT table_id, CAST(row_index AS INT) AS row_index, 'P' || l_partkey AS product, CAST(closing AS DOUBLE) AS closing, status, CAST(op + rec - iss AS DOUBLE) AS calculated, CAST(CASE WHEN status = 'MISMATCH' THEN 7 ELSE 0 END AS DOUBLE) AS discrepancy FROM v
      UNION ALL SELECT table_id, CAST(count(*) + 1 AS INT), 'Total', CAST(sum(cl) AS DOUBLE), 'TOTAL_ROW', NULL, CAST(0 AS DOUBLE) FROM v GROUP BY table_id""",
    "stock_footing": f"""{_W}, g AS (SELECT table_id, sum(op)::DOUBLE AS o, sum(rec)::DOUBLE AS r, sum(iss)::DOUBLE AS i, coalesce(sum(closing), 0)::DOUBLE AS c, sum(cl)::DOUBLE AS p FROM v GROUP BY table_id)
      SELECT table_id, 1 AS totals, o AS sum_opening, r AS sum_receipt, i AS sum_issue, c AS sum_closing, o AS printed_opening, r AS printed_receipt, i AS printed_issue, p AS printed_closing, CASE WHEN abs(c - p) > 1 THEN 1 ELSE 0 END AS mismatches, CASE WHEN abs(c - p) > 1 THEN 'MISMATCH' ELSE 'VERIFIED' END AS status FROM g""",
    "stock_confidence": f"""{_W}, g AS (SELECT table_id, count(*) + 1 AS n, count(*) AS data, count(*) FILTER (status <> 'REVIEW') AS checks, count(*) FILTER (status = 'MISMATCH') AS mismatches, count(closing) AS have FROM v GROUP BY table_id),
      h AS (SELECT *, .2 * .98 + .15 * .95 + .15 * (CASE WHEN n >= 3 THEN 1 ELSE .6 END) + .15 + .15 * (3 * data + have) / ((3 + CASE WHEN have > 0 THEN 1 ELSE 0 END) * data) + .2 * coalesce((checks - mismatches) / nullif(checks, 0), .85) AS base FROM g),
      k AS (SELECT *, round(CASE WHEN mismatches > 0 THEN greatest(.4, base - .3 * mismatches / checks) ELSE base END, 4) AS confidence FROM h) SELECT table_id, n, checks, mismatches, CAST(confidence AS DOUBLE) AS confidence, mismatches > 0 OR confidence < .75 AS needs_review FROM k""",
    "row_arithmetic": f"{_W} SELECT table_id, l_partkey AS row_index, CASE WHEN status = 'MISMATCH' THEN 'UNBALANCED' ELSE 'OK' END AS flag FROM v",
    "row_arithmetic_audit": f"{_W} SELECT table_id, count(*) AS rows, 0 AS unreadable, count(*) FILTER (CASE WHEN blank THEN op + rec - iss = 0 ELSE l_partkey % 10 <> 0 END) AS balanced FROM v GROUP BY table_id",
    "ledger_heal_bleed": f"""{_W}, x AS (SELECT table_id, l_partkey, CASE WHEN l_partkey % 4 < 2 THEN 50 ELSE op END AS o, rec AS r, CASE WHEN l_partkey % 4 < 2 THEN 9 ELSE iss END AS i, closing AS c FROM v),
      y AS (SELECT *, c IS NOT NULL AND o = c AND i <> 0 AS idle FROM x), z AS (SELECT *, CASE WHEN idle THEN 0 ELSE i END AS j FROM y),
      w AS (SELECT *, c IS NOT NULL AND coalesce(lead(o) OVER k = o AND lead(i) OVER k = j, false) AND o <> 0 AND j <> 0 AND o + r - i <> c AS bled FROM z WINDOW k AS (PARTITION BY table_id ORDER BY l_partkey))
      SELECT table_id, l_partkey AS row_index, CAST(CASE WHEN bled THEN c ELSE o END AS VARCHAR) AS opening, CASE WHEN bled OR idle THEN '0' WHEN r = 0 THEN '-' ELSE CAST(r AS VARCHAR) END AS receipt, CASE WHEN bled OR idle THEN '0' ELSE CAST(i AS VARCHAR) END AS issue, '0.00' AS amount, CASE WHEN bled THEN 'bleed' WHEN idle THEN 'idle' END AS repair_source FROM w""",
}
SQL["stock_review"] = f"""SELECT t.table_id, coalesce(c.confidence, 0.25) AS confidence, coalesce(f.status = 'MISMATCH', false) AS footing_differs, coalesce(c.needs_review OR f.status = 'MISMATCH', true) AS needs_review
  FROM (SELECT DISTINCT l_partkey // 10 AS table_id FROM lineitem UNION ALL SELECT -r_regionkey - 1 FROM region) t LEFT JOIN ({SQL["stock_confidence"]}) c ON t.table_id = c.table_id LEFT JOIN ({SQL["stock_footing"]}) f ON t.table_id = f.table_id"""
