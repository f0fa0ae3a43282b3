"""Queries over cell values, roles, identity numbers and text cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import cells, ids, roles
from foliant.functions import text as T
from foliant.plans.adapters import read

# Cells made from line items: blanks, dashes, zeros, plain and grouped numbers, numbers with units, words.
CELL_SQL = """CASE l_orderkey % 9 WHEN 0 THEN '' WHEN 1 THEN '-' WHEN 2 THEN '0.00' WHEN 3 THEN CAST(CAST(l_quantity AS BIGINT) AS {s}) WHEN 4 THEN '1,' || lpad(CAST(l_partkey % 1000 AS {s}), 3, '0') || '.50'
  WHEN 5 THEN CAST(CAST(l_quantity AS BIGINT) AS {s}) || 'TAB' WHEN 6 THEN 'N/A' WHEN 7 THEN 'TAB' || CAST(l_linenumber AS {s}) ELSE '0.000' END"""


def _cells(s, d):
    return read(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr(CELL_SQL.replace("{s}", "string")).alias("cell"))


CELLS = f"WITH c AS (SELECT l_orderkey, l_linenumber, {CELL_SQL.replace('{s}', 'VARCHAR')} AS cell FROM lineitem)"
NAMES = ["S.No", "Unit", "Packing", "Product Name", "Rate", "Total Amount", "Exp Date", "Disc %", "Free", "Closing Qty", "Zone", "Region"]


def _typed(s, d):
    c = _cells(s, d)
    name = F.element_at(F.array(*(F.lit(n) for n in NAMES)), (F.col("l_orderkey") % 12 + 1).cast("int"))
    return c.select("l_orderkey", "l_linenumber", cells.cell_type(name, F.col("cell")).alias("kind"))


NAME_SQL = "[" + ", ".join(f"'{n}'" for n in NAMES) + "][l_orderkey % 12 + 1]"


def _descriptions(s, d):
    p = read(s, d, "part")
    return p.select("p_partkey", F.concat_ws(" ", F.col("p_name"), F.concat((F.col("p_size") * 10).cast("string"), F.lit("MG")), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("1X"), F.col("p_size").cast("string"))).when(F.col("p_partkey") % 3 == 1, F.concat((F.col("p_size") + 1).cast("string"), F.lit("TAB")))).alias("description"))


DESCRIPTION_SQL = "concat_ws(' ', p_name, (p_size * 10) || 'MG', CASE p_partkey % 3 WHEN 0 THEN '1X' || p_size WHEN 1 THEN (p_size + 1) || 'TAB' END)"
HEADERS = "array('Item', 'Opening', 'Pur Rate', case when p_partkey % 2 = 0 then 'Sale' else 'Issue Qty' end, case when p_partkey % 3 = 0 then 'Closing Value' else 'Closing' end, 'Closing', 'Qty', 'Qty', 'Qty_2', '', 'Total', 'Amount')"
HEADERS_SQL = HEADERS.replace("array(", "[").replace("'Amount')", "'Amount']")


def _headers(s, d):
    return read(s, d, "part").select("p_partkey", F.expr(HEADERS).alias("headers"))


def _id12(s, d):
    value = F.lpad(F.pmod(F.col("o_orderkey") * 7385609321, F.lit(10**12)).cast("string"), 12, "0")
    return read(s, d, "orders").select("o_orderkey", value.alias("v"))


ID_SQL = "lpad(CAST(o_orderkey * 7385609321 % 1000000000000 AS VARCHAR), 12, '0')"
_D = "[" + ", ".join(str(ids.dihedral(a, b)) for a in range(10) for b in range(10)) + "]"
_P = "[" + ", ".join(str(x) for row in ids.powers() for x in row) + "]"
VERHOEFF_SQL = f"""WITH o AS (SELECT o_orderkey, {ID_SQL} AS v FROM orders), x AS (SELECT o_orderkey, v, list_transform(range(0, 12), lambda i: {_P}[(i % 8) * 10 + CAST(substr(v, CAST(12 - i AS BIGINT), 1) AS INT) + 1]) AS m FROM o),
  y AS (SELECT o_orderkey, v, list_reduce(m, lambda c, e: {_D}[c * 10 + e + 1], 0) = 0 AS ok FROM x)"""


def _pan(s, d):
    c = read(s, d, "customer")
    letters = F.translate(F.lpad((F.col("c_custkey") % 100000).cast("string"), 5, "0"), "0123456789", "ABCDEFGHPT")
    value = F.concat(letters, F.lpad((F.col("c_custkey") * 7 % 10000).cast("string"), 4, "0"), F.when(F.col("c_custkey") % 10 == 0, "").otherwise("F"))
    return c.select("c_custkey", value.alias("v"))


PAN_SQL = "WITH p AS (SELECT c_custkey, translate(lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0'), '0123456789', 'ABCDEFGHPT') || lpad(CAST(c_custkey * 7 % 10000 AS VARCHAR), 4, '0') || CASE WHEN c_custkey % 10 = 0 THEN '' ELSE 'F' END AS v FROM customer)"
MARKDOWN = "concat('<!-- Page 1 -->\n# Title ', conv_id, '\nNote: none\n**bold** and *it*\n---\n| a | b |\n|---|---|\n| 1 | 2 |\n- item\nReady\n\n\n\n`code` ', coalesce(text, ''), '\nSheet1')"


def _markdown(s, d):
    return read(s, d, "conversations").select("conv_id", "turn", F.expr(MARKDOWN.replace("\n", "\\n")).alias("markdown"), "text")


_SPLIT = r"regexp_split_to_array({t}, '\r\n|\r|\n')"
MARKDOWN_SQL = MARKDOWN.replace("\n", "' || chr(10) || '")


def _trimmed(t: str) -> str:
    return rf"regexp_replace({t}, '^\s+|\s+$', '', 'g')"


def _footless(t: str) -> str:
    return _trimmed(f"array_to_string(list_filter({_SPLIT.format(t=t)}, lambda x: NOT regexp_matches(trim(x), '{T.FOOTER}')), chr(10))")


def _plain_sql(t: str) -> str:
    t = _footless(f"regexp_replace({t}, '(?s)<!--.*?-->', '', 'g')")
    t = f"array_to_string(list_transform({_SPLIT.format(t=t)}, lambda x: CASE WHEN regexp_matches(x, '{T.RULED}') THEN '' ELSE regexp_replace(x, '{T.HEADING}', '') END), chr(10))"
    for _ in range(2):
        t = f"regexp_replace({t}, '{T.INLINE}', '\\1\\2\\3\\4\\5', 'g')"
    t = f"list_transform({_SPLIT.format(t=t)}, lambda x: regexp_replace(x, '{T.BULLET}', ''))"
    t = f"array_to_string(list_transform({t}, lambda x: CASE WHEN regexp_matches(x, '{T.TABLE_RULE}') THEN '' ELSE replace(x, '|', ' ') END), chr(10))"
    return _trimmed(rf"regexp_replace({t}, '\n\s*\n\s*\n+', chr(10) || chr(10), 'g')")


def _answers(s, d):
    a = F.concat(F.when(F.col("turn") % 3 == 0, "There is no visible text in ").when(F.col("turn") % 3 == 1, "   ").otherwise("Total "), F.when(F.col("turn") % 3 == 1, "").otherwise(F.col("role")))
    return read(s, d, "conversations").select("conv_id", "turn", a.alias("answer"))


_QUOTED_PACKING = cells.PACKING.replace("'", "''")

QUERIES = {
    "number_parse": lambda s, d: _cells(s, d).select("l_orderkey", "l_linenumber", cells.lenient_number(F.col("cell")).alias("lenient"), cells.row_number_value(F.col("cell")).alias("strict"), cells.audit_value(F.col("cell")).alias("audit")),
    "cell_semantic": lambda s, d: _cells(s, d).select("l_orderkey", "l_linenumber", cells.semantic(F.col("cell")).alias("semantic")),
    "cell_type": _typed,
    "packing_extract": lambda s, d: _descriptions(s, d).select("p_partkey", cells.packing(F.col("description")).alias("packing")),
    "absent_markers": lambda s, d: _cells(s, d).select("l_orderkey", "l_linenumber", cells.present(F.col("cell")).alias("value")),
    "confusion_fixes": lambda s, d: _cells(s, d).select("l_orderkey", "l_linenumber", cells.numeric_confusions(F.concat(F.col("l_linenumber").cast("string"), F.lit("O."), F.lit("5")), F.lit(True)).alias("n"), cells.packing_confusions(F.concat(F.col("l_linenumber").cast("string"), F.lit(" x "), F.lit("10"))).alias("p")),
    "stock_roles": lambda s, d: _headers(s, d).withColumn("rules", F.transform("headers", roles.stock_rule)).select("p_partkey", *(roles.stock_roles(F.col("headers"), F.col("rules"))[r].alias(r) for r in ("opening", "receipt", "issue", "closing", "closing_value", "product", "total"))),
    "invoice_roles": lambda s, d: _headers(s, d).select("p_partkey", *(roles.invoice_roles(F.col("headers"))[r].alias(r) for r in ("description", "quantity", "unit_price", "amount"))),
    "row_width_enforce": lambda s, d: read(s, d, "part").select("p_partkey", F.array_join(roles.fitted(F.split("p_name", " "), F.lit(3)), "|").alias("row")),
    "billing_align": lambda s, d: read(s, d, "part").select("p_partkey", roles.billing_aligned(F.array(F.lit("Item"), F.lit("OpenQ"), F.lit("InQty")), F.array(F.split("p_name", " "), F.array(F.lit(" a "), F.lit("b"), F.lit("c")))).alias("x")).select("p_partkey", F.array_join(F.flatten("x.rows"), "|").alias("cells"), F.size("x.mismatches").alias("mismatches")),
    "unique_headers": lambda s, d: _headers(s, d).select("p_partkey", F.array_join(roles.unique_headers(F.col("headers")), "|").alias("names")),
    "verhoeff": lambda s, d: _id12(s, d).select("o_orderkey", ids.verhoeff(F.col("v")).alias("ok")),
    "id12_validate": lambda s, d: _id12(s, d).select("o_orderkey", ids.id12(F.col("v")).alias("r")).select("o_orderkey", "r.valid", "r.reason", "r.normalised"),
    "pan_validate": lambda s, d: _pan(s, d).select("c_custkey", ids.pan(F.col("v")).alias("r")).select("c_custkey", "r.valid", "r.reason", "r.holder"),
    "field_format": lambda s, d: _pan(s, d).select("c_custkey", ids.format_ok(F.when(F.col("c_custkey") % 2 == 0, "a.pan_number").otherwise("contact.phone_1"), F.col("v")).alias("ok")),
    "field_loose": lambda s, d: _pan(s, d).select("c_custkey", ids.loose_ok(F.when(F.col("c_custkey") % 3 == 0, "pan").when(F.col("c_custkey") % 3 == 1, "pin").otherwise("dob"), F.col("v")).alias("ok")),
    "footer_strip": lambda s, d: _markdown(s, d).select("conv_id", "turn", T.without_footers(F.col("markdown")).alias("text")),
    "markdown_strip": lambda s, d: _markdown(s, d).select("conv_id", "turn", T.plain(F.col("markdown")).alias("plain")),
    "no_text_normalise": lambda s, d: _answers(s, d).select("conv_id", "turn", T.answered(F.col("answer")).alias("answer")),
    "text_fold": lambda s, d: read(s, d, "documents").select("doc_id", F.md5(T.folded(F.col("text"))).alias("fold")),
    "number_extract": lambda s, d: read(s, d, "documents").select("doc_id", F.array_join(T.numbers(F.col("text")), ",").alias("numbers")),
    "department_tidy": lambda s, d: read(s, d, "nation").select("n_nationkey", T.tidy_department(F.concat(F.lit("  "), F.col("n_name"), F.lit("   x "))).alias("name")),
    "summary_totals": lambda s, d: read(s, d, "part").select("p_partkey", T.summary_totals(F.concat(F.lit("Op.Stk Val : "), F.col("p_retailprice").cast("decimal(12,2)").cast("string"), F.lit("\nPrinted By : X 9:07:57 AM\n| a : 12 |\nQty : "), F.col("p_size").cast("string"), F.lit("00"))).alias("m")).select("p_partkey", F.col("m")["Op.Stk Val"].alias("value"), F.col("m")["Qty"].alias("qty"), F.size("m").alias("n")),
}
_CLEAN = "replace(cell, ',', '')"
_NUM = r"regexp_matches({x}, '^[-+]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$')"
_ROLE = lambda name, last: f"list_max(list_transform(range(0, 12), lambda i: CASE WHEN {last} THEN i END))"


def _stock_sql() -> str:
    h = "upper(trim(h[i + 1]))"
    v = f"regexp_matches({h}, 'VAL|AMOUNT|AMT')"
    rule = f"""CASE WHEN contains({h}, 'OP') AND NOT {v} THEN 'opening' WHEN (regexp_matches({h}, 'REC|PUR') OR {h} = 'IN') AND NOT {v} THEN 'receipt' WHEN (regexp_matches({h}, 'ISS|SALE|DISPATCH|SOLD') OR {h} = 'OUT') AND NOT {v} THEN 'issue'
      WHEN contains({h}, 'TOT') AND NOT {v} THEN 'total' WHEN regexp_matches({h}, 'CL|BAL') AND NOT {v} THEN 'closing' WHEN {v} AND contains({h}, 'OP') THEN 'opening_value' WHEN {v} AND regexp_matches({h}, 'CL|BAL') THEN 'closing_value'
      WHEN regexp_matches({h}, 'PRODUCT|PARTICULARS|DESCRIPTION') OR {h} = 'ITEM' THEN 'product' END"""
    return f"""WITH x AS (SELECT p_partkey, {HEADERS_SQL} AS h FROM part), r AS (SELECT p_partkey, list_transform(range(0, 12), lambda i: {rule}) AS r FROM x)
      SELECT p_partkey, """ + ", ".join(f"CAST(list_max(list_transform(range(0, 12), lambda i: CASE WHEN r[i + 1] = '{k}' THEN i END)) AS INT) AS {k}" for k in ("opening", "receipt", "issue", "closing", "closing_value", "product", "total")) + " FROM r"


SQL = {
    "number_parse": f"""{CELLS} SELECT l_orderkey, l_linenumber, CASE WHEN cell NOT IN ('', '-', 'N/A') THEN coalesce(CASE WHEN {_NUM.format(x=_CLEAN)} THEN CAST({_CLEAN} AS DOUBLE) END, try_cast(nullif(regexp_extract({_CLEAN}, '^(-?[0-9]+(?:\\.[0-9]+)?)', 1), '') AS DOUBLE)) END AS lenient,
      CASE WHEN regexp_matches(cell, '^-+$') THEN 0.0 WHEN {_NUM.format(x=_CLEAN)} THEN try_cast({_CLEAN} AS DOUBLE) END AS strict, CASE WHEN regexp_matches(cell, '^-*$') THEN 0.0 WHEN {_NUM.format(x=_CLEAN)} THEN try_cast({_CLEAN} AS DOUBLE) END AS audit FROM c""",
    "cell_semantic": f"""{CELLS} SELECT l_orderkey, l_linenumber, CASE WHEN cell = '' THEN 'EMPTY' WHEN cell IN ('-', '--', '---', 'NA', 'N/A') THEN 'NOT_REPORTED' WHEN cell IN ('0', '0.0', '0.00') THEN 'ZERO' WHEN {_NUM.format(x=_CLEAN)} THEN 'NUMERIC' ELSE 'TEXT' END AS semantic FROM c""",
    "cell_type": f"""{CELLS}, n AS (SELECT *, {NAME_SQL} AS name FROM c) SELECT l_orderkey, l_linenumber, CASE name WHEN 'S.No' THEN 'SERIAL' WHEN 'Unit' THEN 'UNIT' WHEN 'Packing' THEN 'PACKING' WHEN 'Product Name' THEN 'DESCRIPTION' WHEN 'Rate' THEN 'RATE' WHEN 'Total Amount' THEN 'AMOUNT'
      WHEN 'Exp Date' THEN 'DATE' WHEN 'Disc %' THEN 'PERCENTAGE' WHEN 'Free' THEN CASE WHEN contains(cell, '.') AND NOT ends_with(cell, '.00') THEN 'DECIMAL_VALUE' ELSE 'INTEGER_QTY' END WHEN 'Closing Qty' THEN 'DECIMAL_VALUE'
      ELSE CASE WHEN cell = '-' THEN 'DASH_OR_EMPTY' WHEN {_NUM.format(x=_CLEAN)} THEN 'DECIMAL_VALUE' ELSE 'DESCRIPTION' END END AS kind FROM n""",
    "packing_extract": f"SELECT p_partkey, coalesce(list_filter(regexp_extract_all({DESCRIPTION_SQL}, '(?i){_QUOTED_PACKING}', 1), lambda x: NOT regexp_matches(trim(x), '{cells.STRENGTH}'))[-1], '') AS packing FROM part",
    "absent_markers": f"{CELLS} SELECT l_orderkey, l_linenumber, CASE WHEN lower(trim(cell)) NOT IN ('n/a', '-') THEN cell END AS value FROM c",
    "confusion_fixes": "SELECT l_orderkey, l_linenumber, l_linenumber || '0.5' AS n, l_linenumber || 'x10' AS p FROM lineitem",
    "stock_roles": _stock_sql(),
    "invoice_roles": "SELECT p_partkey, 0 AS description, CASE WHEN p_partkey % 2 = 0 THEN 6 ELSE 3 END AS quantity, 2 AS unit_price, CASE WHEN p_partkey % 3 = 0 THEN 4 ELSE 10 END AS amount FROM part",
    "row_width_enforce": "SELECT p_partkey, array_to_string(list_concat(string_split(p_name, ' '), ['', '', ''])[1:3], '|') AS row FROM part",
    "billing_align": "WITH w AS (SELECT p_partkey, list_transform(string_split(p_name, ' '), lambda x: trim(x)) AS r FROM part) SELECT p_partkey, array_to_string(list_concat(list_concat(r, ['', '', ''])[1:3], ['a', 'b', 'c']), '|') AS cells, CASE WHEN len(r) = 3 THEN 0 ELSE 1 END AS mismatches FROM w",
    "unique_headers": "SELECT p_partkey, 'Item|Opening|Pur Rate|' || CASE WHEN p_partkey % 2 = 0 THEN 'Sale' ELSE 'Issue Qty' END || '|' || CASE WHEN p_partkey % 3 = 0 THEN 'Closing Value|Closing' ELSE 'Closing|Closing_2' END || '|Qty|Qty_2|Qty_2_2|column_10|Total|Amount' AS names FROM part",
    "verhoeff": f"{VERHOEFF_SQL} SELECT o_orderkey, ok FROM y",
    "id12_validate": f"""{VERHOEFF_SQL} SELECT o_orderkey, ok AND substr(v, 1, 1) NOT IN ('0', '1') AS valid, CASE WHEN ok AND substr(v, 1, 1) NOT IN ('0', '1') THEN 'ok' ELSE 'checksum' END AS reason,
      CASE WHEN ok AND substr(v, 1, 1) NOT IN ('0', '1') THEN substr(v, 1, 4) || ' ' || substr(v, 5, 4) || ' ' || substr(v, 9, 4) ELSE v END AS normalised FROM y""",
    "pan_validate": f"""{PAN_SQL}, h AS (SELECT unnest({[*ids.HOLDERS]}) AS k, unnest({[*ids.HOLDERS.values()]}) AS holder) SELECT c_custkey, length(v) = 10 AND h.k IS NOT NULL AS valid, CASE WHEN length(v) <> 10 THEN 'format' WHEN h.k IS NULL THEN 'holder_type' ELSE 'ok' END AS reason,
      CASE WHEN length(v) = 10 THEN holder END AS holder FROM p LEFT JOIN h ON substr(v, 4, 1) = h.k""",
    "field_format": f"{PAN_SQL} SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN regexp_matches(v, '^[A-Z]{{5}}[0-9]{{4}}[A-Z]$') ELSE false END AS ok FROM p",
    "field_loose": f"{PAN_SQL} SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN regexp_matches(v, '^[A-Z]{{5}}[0-9]{{4}}[A-Z]$') ELSE false END AS ok FROM p",
    "footer_strip": "SELECT conv_id, turn, " + _footless(MARKDOWN_SQL) + " AS text FROM conversations",
    "markdown_strip": "SELECT conv_id, turn, " + _plain_sql(MARKDOWN_SQL) + " AS plain FROM conversations",
    "no_text_normalise": f"SELECT conv_id, turn, CASE WHEN turn % 3 IN (0, 1) THEN '{T.NOTHING}' ELSE 'Total ' || role END AS answer FROM conversations",
    "text_fold": "SELECT doc_id, md5(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) AS fold FROM documents",
    "number_extract": r"SELECT doc_id, array_to_string(regexp_extract_all(text, '(-?\b[0-9]+(?:\.[0-9]+)?\b)', 1), ',') AS numbers FROM documents",
    "department_tidy": "SELECT n_nationkey, n_name || ' x' AS name FROM nation",
    "summary_totals": "SELECT p_partkey, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS DOUBLE) AS value, CAST(p_size || '00' AS DOUBLE) AS qty, 2 AS n FROM part",
}
