"""Queries over templates, types, payloads, roles, hashes, quality measures and page layouts."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from foliant.functions import roles as R
from foliant.functions import text as T
from foliant.operators import decisions as R_
from foliant.operators import envelope as E
from foliant.operators import fields as V
from foliant.operators import layout as L
from foliant.operators import payload as P
from foliant.operators import quality as Q
from foliant.operators import search as S
from foliant.operators import templates as D
from foliant.plans.adapters import LEDGER_SQL, ledger, read

_TYPES = ["PAN", " pan_card ", "CV", "LEDGER", "", "made up", "bill"]
_SHOWN = [("stock & Sales Report", "STOCK_STATEMENT"), ("Stock  statment", "STOCK_STATEMENT"), ("Opening .. CLOSING .. receipt", "STOCK_STATEMENT"), ("no ABCDE1234F here", "PAN"), ("UIDAI", "AADHAAR"), ("Passport of", "PASSPORT"), ("driving licence", "DRIVING_LICENSE"), ("education and skills", "RESUME"), ("GSTIN 1", "INVOICE"), ("Column A Row 1", "SPREADSHEET"), ("hospital", "FORM"), ("nothing", "UNKNOWN")]
HEADERS = [["Item", "Opening Stock", "Purchase", "Sale Qty", "Sale Amount", "Closing Bal", "Bal Value"], ["Op", "In", "Out", "O.Bal", "Bal", "Closing Qty"], ["Product", "OPENQ", "INQTY", "OUTQTY", "Amount", "CL.STK", "Closing Amount"], ["Name", "Rate", "Total"]]
_MAPS = {
    "fill": ["opening:1|receipt:2|issue:4|closing:5", "closing:3", "opening:1|receipt:2|issue:3|closing:5", ""],
    "bleed": ["opening:1|receipt:2|issue:4|closing:5", "closing:5", "opening:1|receipt:2|issue:3|amount:4|closing:5", ""],
    "movement": ["opening:1|inflow:2|outflow:3|closing:5", "inflow:1|outflow:2|opening:3|closing:4", "inflow:2|outflow:3", ""],
    "audit": ["opening:1|inflow:2|outflow:3|closing:5", "opening:0|inflow:1|outflow:2|closing:4", "closing:6", ""],
}
SECRET = b"a secret for tests"


def _pick(values, index):
    return F.get(F.array(*(F.lit(v) for v in values)), index.cast("int"))


def _fields(s, d):
    c = read(s, d, "customer").withColumn("document_type", _pick(_TYPES, F.col("c_custkey") % 7))
    e = lambda p, v, o: F.struct(F.lit(p).alias("path"), v.alias("value"), F.lit(o).alias("ord"))
    all_ = F.array(e("zeta", F.col("c_mktsegment"), 0), e("description", F.lit("text"), 1), e("account_name", F.col("c_name"), 2), e("name", F.col("c_name"), 3), e("father_name", F.lit("N/A"), 4), e("candidate_name", F.col("c_name"), 5), e("vendor_name", F.lit(" "), 6))
    return c.select("c_custkey", "document_type", F.explode(all_).alias("f")).select("c_custkey", "document_type", "f.*", F.lit(None).cast("double").alias("confidence"))


def _values(rows) -> str:
    cell = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(cell(v) for v in r) + ")" for r in rows) + ")"


def _templated_sql() -> str:
    rows = []
    for k, t in enumerate(_TYPES):
        name = t.strip().upper() or "UNKNOWN"
        name = D.ALIASES.get(name, name)
        fields = D.TEMPLATES.get(name, D.TEMPLATES["UNKNOWN"])
        for o, (path, value) in enumerate((("zeta", "segment"), ("description", "text"), ("account_name", "name"), ("name", "name"), (None, None), ("candidate_name", "name"))):
            if path:
                rows.append((k, name, path, value, fields.index(path) if path in fields else o + len(fields)))
    return f"SELECT c_custkey, t.document_type, path, CASE src WHEN 'segment' THEN c_mktsegment WHEN 'name' THEN c_name ELSE src END AS value, ord::BIGINT AS ord FROM customer JOIN {_values(rows)} AS t(k, document_type, path, src, ord) ON c_custkey % 7 = k"


def _tables_of(s, d):
    """Every customer has tables under three fields, by its key; some of them empty."""
    c = read(s, d, "customer")
    t = lambda f, i, n: F.struct(F.lit(f).alias("field"), F.lit(i).alias("table_idx"), n.cast("int").alias("n"))
    k = F.col("c_custkey")
    all_ = F.array(t("rows", 0, F.lit(2)), t("items", 0, k % 2), t("all_tables", 0, k % 3), t("all_tables", 1, (k % 3) * (k % 2)), t("other", 0, F.lit(1)))
    rows = c.select("c_custkey", F.explode(all_).alias("t")).select("c_custkey", "t.*")
    return rows.withColumn("rows", F.array_repeat(F.array(F.lit("x")), F.col("n"))).drop("n")


def _payloads(s, d):
    c, k = read(s, d, "customer"), F.col("c_custkey")
    none = F.lit(None).cast("array<string>")
    documents = c.select("c_custkey", F.when(k % 2 == 0, F.concat(F.lit("req-"), k.cast("string"))).alias("request_id"), F.lit('a "b".pdf').alias("source_file"), F.when(k % 3 > 0, F.lit("BILL")).alias("document_type"), F.lit(None).cast("string").alias("project_name"), F.lit("2024-01-01T00:00:00").alias("extracted_at"), F.lit(0.5).alias("confidence"), (k % 5 == 0).alias("review_required"),
        F.when(k % 4 > 0, F.concat(F.lit('{"a":{"b":""},"c":[null," ",0,false,{}],"n":"'), F.col("c_name"), F.lit('"}'))).otherwise("no json").alias("data"), F.when(k % 5 == 0, F.array(F.lit("dob"), F.lit("name"))).otherwise(none).alias("flagged"), F.when(k % 10 == 0, F.array(F.lit("too small"), F.lit("dark"))).otherwise(none).alias("reasons"))
    item = F.explode(F.sequence(F.lit(0), (k % 3).cast("int"))).alias("item_idx")
    items = c.select("c_custkey", item).select("c_custkey", F.when(F.col("item_idx") == 2, 2).otherwise(1).alias("place"), F.when(F.col("item_idx") == 2, F.lit("second")).alias("table_name"), "item_idx", F.concat(F.lit('{"i":'), F.col("item_idx").cast("string"), F.lit("}")).alias("item"))
    return P.assembled_payloads(documents, items, "c_custkey")


_PAYLOAD_SQL = """SELECT c_custkey, '{"document_id":' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN ',"request_id":"req-' || c_custkey || '"' ELSE '' END || ',"source_file":"a \\"b\\".pdf","document_type":"' || CASE WHEN c_custkey % 3 > 0 THEN 'BILL' ELSE 'UNKNOWN' END
  || '","extracted_at":"2024-01-01T00:00:00","confidence":0.5,"review_required":' || CASE WHEN c_custkey % 5 = 0 THEN 'true' ELSE 'false' END || ',"data":' || CASE WHEN c_custkey % 4 > 0 THEN '{"c":[0,false],"n":"' || c_name || '"}' ELSE '{}' END
  || ',"line_items":' || CASE c_custkey % 3 WHEN 0 THEN '[{"i":0}]' ELSE '[{"i":0},{"i":1}]' END || CASE WHEN c_custkey % 5 = 0 THEN ',"review_fields":["dob","name"]' ELSE '' END || CASE WHEN c_custkey % 10 = 0 THEN ',"review_reason":"too small; dark"' ELSE '' END
  || CASE WHEN c_custkey % 3 = 2 THEN ',"additional_tables":[{"table":"second","line_items":[{"i":2}]}]' ELSE '' END || '}' AS payload FROM customer"""


def _scores(s, d):
    """An order is a document; a line has a figure and a text, and by its keys one is missing, wrong or too many."""
    li = read(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("u"))
    p, u, qty = F.col("p"), F.col("u"), F.col("p").cast("string")
    none = F.lit(None).cast("string")
    truth = F.when(p % 7 == 0, none).when(p % 5 == 0, "").when(p % 5 == 1, "-").when(p % 5 == 2, "0").otherwise(qty)
    value = F.when(u % 6 == 0, none).when(u % 6 == 1, "").when(u % 6 == 2, "-").otherwise(F.coalesce(truth, F.lit("9")))
    cells = li.select("l_orderkey", F.when(F.col("l_linenumber") % 2 == 0, "decimal").otherwise("text").alias("kind"), truth.alias("truth"), value.alias("value"))
    docs = li.groupBy("l_orderkey").agg(F.count("*").cast("int").alias("truth_rows")).withColumns({"found_rows": F.greatest(F.col("truth_rows") - (F.col("l_orderkey") % 3).cast("int"), F.lit(0)), "rows_given": F.when(F.col("l_orderkey") % 11 == 0, 0).otherwise(F.col("truth_rows"))})
    docs = docs.withColumn("truth_columns", F.array(F.lit("Item Name"), F.lit("Qty"))).withColumn("found_columns", F.when(F.col("l_orderkey") % 2 == 0, F.array(F.lit("item"), F.lit("Zorb"))).otherwise(F.array(F.lit("Klar"))))
    return Q.document_scores(docs, cells, "l_orderkey")


def _scores_sql() -> str:
    share = lambda x, n: f"CASE WHEN l_orderkey % 11 <> 0 THEN round({x} * 100.0 / nullif({n}, 0), 2)::DOUBLE END"
    return f"""WITH r AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_suppkey) AS u FROM lineitem GROUP BY 1, 2),
      t AS (SELECT *, l_linenumber % 2 = 0 AS num, CASE WHEN p % 7 = 0 THEN NULL WHEN p % 5 = 0 THEN '' WHEN p % 5 = 1 THEN '-' WHEN p % 5 = 2 THEN '0' ELSE CAST(p AS VARCHAR) END AS a FROM r),
      v AS (SELECT *, CASE u % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '-' ELSE coalesce(a, '9') END AS b FROM t), o AS (SELECT *, a IS NOT NULL AS e, b IS NOT NULL AS g, a IS NOT NULL AND b IS NOT NULL AND a = b AS ok FROM v),
      s AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (e) AS expected_cells, count(*) FILTER (ok) AS correct_cells, count(*) FILTER (e AND g AND NOT ok) AS incorrect_cells, count(*) FILTER (e AND NOT g) AS missing_cells, count(*) FILTER (NOT e) AS extra_cells, count(*) FILTER (a <> '') AS filled_truth, count(*) FILTER (b <> '') AS filled_found,
        count(*) FILTER (a <> '' AND ok) AS filled_correct, count(*) FILTER (a <> '' AND coalesce(b, '') = '') AS false_empty, count(*) FILTER (e AND a <> '-' AND b = '-') AS false_dash, count(*) FILTER (num AND e) AS numeric_cells, count(*) FILTER (num AND ok) AS numeric_correct, count(*) FILTER (a = '' AND b <> '') AS invented,
        count(*) FILTER (a = '') AS blank_cells, count(*) FILTER (a = '-') AS dash_cells, count(*) FILTER (a = '0') AS zero_cells, count(*) FILTER (ok AND a = '') AS blank_correct, count(*) FILTER (ok AND a = '-') AS dash_correct, count(*) FILTER (ok AND a = '0') AS zero_correct FROM o GROUP BY 1)
      SELECT * EXCLUDE (n), {share("greatest(n - l_orderkey % 3, 0)", "n")} AS row_accuracy, {share("CASE WHEN l_orderkey % 2 = 0 THEN 2 ELSE 1 END", "2")} AS column_accuracy, {share("CASE WHEN l_orderkey % 2 = 0 THEN 2 ELSE 0 END", "2")} AS column_semantic, {share("correct_cells", "expected_cells")} AS cell_accuracy, {share("numeric_correct", "numeric_cells")} AS numeric_accuracy,
        {share("filled_correct", "filled_truth")} AS recall, {share("filled_correct", "filled_found")} AS "precision", {share("blank_correct", "blank_cells")} AS blank_accuracy, {share("dash_correct", "dash_cells")} AS dash_accuracy, {share("zero_correct", "zero_cells")} AS zero_accuracy, l_orderkey % 11 <> 0 AS scorable FROM s"""


def _truth(s, d):
    """Orders as golden tables: a line is a product, and a total follows that every third order gets wrong; every fourth has a made-up row, every fifth a field that is its own label."""
    li = read(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    names, k = F.array(F.lit("Item"), F.lit("Qty")), F.col("l_orderkey")
    products = li.select(k, F.col("l_linenumber").cast("int").alias("row_idx"), F.lit("product").alias("row_type"), names.alias("names"), F.array(F.when((k % 4 == 0) & (F.col("l_linenumber") == 1), "Unknown item").otherwise("x"), F.col("p").cast("string")).alias("cells"))
    total = li.groupBy("l_orderkey").agg(F.sum("p").alias("q")).select(k, F.lit(100).alias("row_idx"), F.lit("total").alias("row_type"), names.alias("names"), F.array(F.lit("Total"), (F.col("q") + F.when(k % 3 == 0, 1).otherwise(0)).cast("string")).alias("cells"))
    label = li.select(k).distinct().where("l_orderkey % 5 = 0").select(k, F.lit(200).alias("row_idx"), F.lit("field").alias("row_type"), F.array(F.lit("field_name"), F.lit("field_value")).alias("names"), F.array(F.lit("pan_number"), F.lit("PAN")).alias("cells"))
    return Q.truth_faults(products.unionAll(total).unionAll(label), "l_orderkey", ["Qty"], ["unknown item"])


def _light(s, d):
    """Two lines of an order: three words with jitter, and a label with its value."""
    o = read(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"))
    j = (F.col("doc_id") % 5).cast("double")
    words = [("a", 0.0, 0.0), ("b", 50.0, 1.0), ("c", 90.0, 2.0), ("Total", 0.0, 40.0), ("12", 60.0, 42.0), ("end", 0.0, 70.0)]
    w = F.explode(F.array(*(F.struct(F.lit(k).alias("seq"), F.lit(t).alias("text"), F.lit(x).alias("x0"), F.lit(y).alias("y")) for k, (t, x, y) in enumerate(words)))).alias("w")
    t = o.select("*", j.alias("j"), w).select("doc_id", "page", "w.seq", "w.text", "w.x0", (F.col("w.y") + F.col("j") * (F.col("w.seq") % 2)).alias("y0"), "j")
    return t.withColumns({"x1": F.col("x0") + 30, "y1": F.col("y0") + 12, "confidence": F.when(F.col("doc_id") % 2 == 0, 0.99).otherwise(0.9)}).drop("j")


def _lanes(s, d):
    o = read(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"))
    columns = o.select("*", F.explode(F.array(*(F.struct(F.lit(k).alias("col_idx"), F.lit(a).alias("left"), F.lit(b).alias("right")) for k, (a, b) in enumerate(((0.0, 100.0), (100.0, 200.0), (200.0, 300.0)))))).alias("c")).select("doc_id", "page", "c.*")
    n = F.when(F.col("doc_id") % 2 == 0, 4).otherwise(2)
    line = F.explode(F.sequence(F.lit(1), n)).alias("line")
    figures = o.select("*", line).select("doc_id", "page", "line", F.explode(F.array(*(F.struct(F.lit(a).alias("x0"), F.lit(b).alias("x1")) for a, b in ((60.0, 80.0), (84.0, 120.0), (250.0, 290.0))))).alias("f")).select("doc_id", "page", "f.*")
    return L.lanes(figures, columns)


#: Texts of lines, and whether they are about the report; fenced answers, and what is in them.
LINES_ABOUT = [("From 01/05/2026 To 29/05/2026", True), ("GSTIN x09AABCU9603R1ZM", True), ("1/2/24 .. 03-04-2024", True), ("Qty Rate 12", False), ("0161234567890 call", True), ("from A to B 7", True)]
FENCED = [("```json\n{}\n```", "{}"), ("no fence", "no fence"), ("``` \na", "a"), ("x\n```", "x")]


def _recall(s, d):
    """Words of an order: every third is missing, every second of the rest drifts by 10 pixels."""
    li = read(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("idx")).agg(F.min("l_partkey").alias("p"))
    truth = li.select("page", "idx", F.concat(F.lit("w"), F.col("idx").cast("string")).alias("text"), F.lit(5.0).alias("x"), (F.col("idx") * 20.0).alias("y"), "p")
    found = truth.where("p % 3 > 0").withColumn("x", F.col("x") + F.when(F.col("p") % 2 == 0, 10.0).otherwise(3.0))
    again = found.withColumn("x", F.col("x") + 500.0)
    return Q.nearest(found.unionAll(again), truth.drop("p"), ["page"], 8.0).select("page", "idx", "distance", "present", "near")


def _gate(s, d):
    o = read(s, d, "orders").select("o_orderkey", F.col("o_orderkey").alias("k"))
    v = lambda n, low: (F.lit(low) + F.col("k") % n).cast("double")
    return o.select("o_orderkey", Q.passes(v(3, 94), v(5, 94), v(7, 94), v(11, 94), v(4, 97), (F.col("k") % 2) * 0.1 + 0.8, F.col("k") % 13 == 0).alias("passes"))


QUERIES = {
    "keyed_lookup": lambda s, d: S.lookup(ledger(s, d).withColumn("request_id", F.concat(F.lit("req-"), F.col("id").cast("string"))), "77").select("id", "status").unionAll(S.lookup(ledger(s, d).withColumn("request_id", F.concat(F.lit("req-"), F.col("id").cast("string"))), "req-5").select("id", "status")).unionAll(S.lookup(ledger(s, d).withColumn("request_id", F.when(F.col("id") == 9, "12")), "12").select("id", "status")),
    "report_lines": lambda s, d: read(s, d, "customer").select("c_custkey", L.report_line(_pick([t for t, _ in LINES_ABOUT], F.col("c_custkey") % len(LINES_ABOUT))).alias("report")),
    "fence_strip": lambda s, d: read(s, d, "customer").select("c_custkey", T.unfenced(_pick([t for t, _ in FENCED], F.col("c_custkey") % len(FENCED))).alias("text")),
    "ocr_recall": _recall,
    "production_gate": _gate,
    "repair_accept": lambda s, d: read(s, d, "part").select("p_partkey", R_.repair_accepted(F.when(F.col("p_partkey") % 4 == 0, "no figure").otherwise((F.col("p_partkey") % 10 + F.when(F.col("p_partkey") % 4 == 1, 0.04).otherwise(0.06)).cast("string")), (F.col("p_partkey") % 10).cast("double")).alias("accepted")),
    "final_confidence": lambda s, d: read(s, d, "customer").select("c_custkey", E.final_confidence(F.when(F.col("c_custkey") % 5 == 0, 0.77), F.when(F.col("c_custkey") % 3 == 0, 0.66), F.when(F.col("c_custkey") % 2 == 0, "LEDGER").otherwise("FORM"), F.lit(0), F.col("c_custkey") % 7 > 0, F.lit(0.5)).alias("confidence")),
    "field_templates": lambda s, d: D.templated(_fields(s, d), "c_custkey").select("c_custkey", "document_type", "path", "value", "ord"),
    "type_refinement": lambda s, d: read(s, d, "customer").select("c_custkey", D.refined_type(_pick(["UNKNOWN", "FORM", "LEDGER"], F.floor(F.col("c_custkey") / 12) % 3), _pick([x[0] for x in _SHOWN], F.col("c_custkey") % 12), F.floor(F.col("c_custkey") / 36) % 2 == 0, F.lit(0)).alias("t")).select("c_custkey", "t.*"),
    "primary_tables": lambda s, d: P.ranked_tables(_tables_of(s, d), "c_custkey").where("place is not null").select("c_custkey", "field", "table_idx", "place"),
    "payload_assembly": _payloads,
    "json_prune": lambda s, d: read(s, d, "nation").select("n_nationkey", P.pruned(F.concat(F.lit('{"k":'), F.col("n_nationkey").cast("string"), F.lit(',"e":"","l":[[],[" "],{"x":null}],"d":{"n":"'), F.col("n_name"), F.lit('","z":{}}}'))).alias("json")),
    "envelope_read": lambda s, d: read(s, d, "events").select("event_id", P.read_envelope(F.when(F.col("event_id") % 3 == 0, "{broken").when(F.col("event_id") % 3 == 1, F.col("props"))).alias("m")).select("event_id", F.size("m").alias("n"), F.col("m")["k"].alias("k")),
    "ledger_roles": lambda s, d: read(s, d, "part").select("p_partkey", F.get(F.array(*(F.array(*(F.lit(h) for h in hs)) for hs in HEADERS)), (F.col("p_partkey") % 4).cast("int")).alias("h")).select("p_partkey", *(F.array_join(F.transform(F.sort_array(F.transform(F.map_entries(m), lambda e: F.struct(e["value"], e["key"]))), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), "|").alias(n) for n, m in (("fill", R.heal_roles(F.col("h"))), ("bleed", R.heal_roles(F.col("h"), "bleed")), ("movement", R.movement_roles(F.col("h"))), ("audit", R.movement_roles(F.col("h"), "audit"))))),
    "role_coverage": lambda s, d: read(s, d, "part").select("p_partkey", R.covers(R.movement_roles(F.get(F.array(*(F.array(*(F.lit(h) for h in hs)) for hs in HEADERS)), (F.col("p_partkey") % 4).cast("int"))), ["opening", "inflow", "outflow", "closing"]).alias("balances")),
    "keyed_hash": lambda s, d: read(s, d, "customer").select("c_custkey", T.keyed_hash(F.lit("fixed message"), SECRET).alias("fixed"), T.media_token(F.lit("fixed message"), SECRET).alias("token"), (T.keyed_hash(F.col("c_name"), SECRET) == T.keyed_hash(F.col("c_name"), b"other")).alias("same")),
    "text_fold_wide": lambda s, d: read(s, d, "nation").select("n_nationkey", T.folded_wide(F.concat(F.lit("ＡＢ①ﬁ "), F.col("n_name"))).alias("fold")),
    "document_scores": _scores,
    "truth_faults": _truth,
    "column_match": lambda s, d: read(s, d, "nation").select("n_nationkey", F.to_json(Q.matched_columns(F.array(F.lit("Item Name"), F.lit("Qty"), F.lit("Rate")), F.when(F.col("n_nationkey") % 3 == 0, F.array(F.lit("rate"), F.lit("ITEM"), F.lit("x"))).when(F.col("n_nationkey") % 3 == 1, F.array(F.lit("Qty."), F.lit("Zorb"))).otherwise(F.array(F.lit("a1"), F.lit("b2"), F.lit("c3"))))).alias("map")),
    "y_cluster_light": lambda s, d: L.light_lines(L.lined(_light(s, d), policy="light")).select("doc_id", "line_idx", "text"),
    "page_confidence": lambda s, d: L.page_confidence(_light(s, d)).select("doc_id", "tokens", "confidence", "needs_more"),
    "digital_gate": lambda s, d: L.digital_pages(read(s, d, "documents").select(F.col("doc_id"), F.lit(1).alias("page"), F.explode(F.split(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-zA-Z0-9]+", " ")), " ")).alias("text")).where("text <> ''")).select("doc_id", "words", "letters", "accepted"),
    "anchor_overlap": lambda s, d: L.over_bands(_light(s, d).withColumn("seq", F.col("seq").cast("int")), read(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.explode(F.array(F.lit(0), F.lit(1))).alias("col_idx")).withColumn("center", F.col("col_idx") * 100.0 + 10.0)).select("doc_id", "seq", "col_idx"),
    "column_lanes": lambda s, d: _lanes(s, d).select("doc_id", "col_idx", "left", "right"),
    "dashboard_counts": lambda s, d: S.dashboard(ledger(s, d), read(s, d, "conversations"), ["Error", "signup"]),
    "active_keys": lambda s, d: S.active(read(s, d, "customer").withColumn("revoked_at", F.when(F.col("c_custkey") % 3 == 0, F.lit("2024-01-01")))).select("c_custkey"),
    "key_projection": lambda s, d: read(s, d, "customer").select("c_custkey", F.map_keys(S.without_keys(F.create_map(F.lit("tables"), F.col("c_name"), F.lit("text"), F.col("c_mktsegment")), ["tables", "cells_metadata"])).alias("k")).select("c_custkey", F.array_join("k", ",").alias("keys")),
    "upload_dropped": lambda s, d: S.dropped_uploads(ledger(s, d), "original_filename", "id"),
    "export_pretty": lambda s, d: read(s, d, "nation").select("n_nationkey", P.pretty_text(F.concat(F.lit('{"name":"'), F.col("n_name"), F.lit('","list":[1,2]}')), F.lit("body"), F.col("n_name")).alias("text")),
    "character_errors": lambda s, d: read(s, d, "part").select("p_partkey", Q.character_errors(F.lit("abcdef12"), _pick(["abcdef12", "abcxef12", "", "zzz"], F.col("p_partkey") % 4)).alias("rate")),
    "grounding_wide": lambda s, d: V.verdicts(read(s, d, "nation").select(F.col("n_nationkey").alias("doc_id"), F.lit("name").alias("path"), F.lit("Ｎｏｖａ ﬁeld").alias("value"), F.concat("n_name", F.when(F.col("n_nationkey") % 2 == 0, " nova FIELD").otherwise(" ｎｏva")).alias("page_text"), F.lit(True).alias("legible"), F.lit(False).alias("digital"), F.create_map(F.lit("name"), F.lit("x")).alias("fields")), wide=True).select("doc_id", "status"),
    "history_all": lambda s, d: read(s, d, "events").select("event_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")),
}
_HMAC = hashlib.sha256(bytes(b ^ 0x5C for b in SECRET.ljust(64, b"\0")) + hashlib.sha256(bytes(b ^ 0x36 for b in SECRET.ljust(64, b"\0")) + b"fixed message").digest()).hexdigest()
SQL = {
    "keyed_lookup": f"WITH {LEDGER_SQL} SELECT id, status FROM ledger WHERE id IN (77, 5, 9)",
    "report_lines": f"SELECT c_custkey, report FROM customer JOIN {_values([(k, b) for k, (_, b) in enumerate(LINES_ABOUT)])} AS v(k, report) ON c_custkey % {len(LINES_ABOUT)} = k",
    "fence_strip": f"SELECT c_custkey, text FROM customer JOIN {_values([(k, b) for k, (_, b) in enumerate(FENCED)])} AS v(k, text) ON c_custkey % {len(FENCED)} = k",
    "ocr_recall": "SELECT l_orderkey AS page, l_linenumber AS idx, CASE WHEN p % 3 > 0 THEN CASE WHEN p % 2 = 0 THEN 10.0 ELSE 3.0 END END::DOUBLE AS distance, p % 3 > 0 AS present, p % 3 > 0 AND p % 2 = 1 AS near FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2)",
    "production_gate": "SELECT o_orderkey, o_orderkey % 3 >= 1 AND o_orderkey % 5 >= 1 AND o_orderkey % 7 >= 1 AND o_orderkey % 11 >= 1 AND o_orderkey % 4 >= 1 AND o_orderkey % 2 = 1 AND o_orderkey % 13 <> 0 AS passes FROM orders",
    "repair_accept": "SELECT p_partkey, p_partkey % 4 = 1 AS accepted FROM part",
    "final_confidence": "SELECT c_custkey, CASE WHEN c_custkey % 7 > 0 THEN c ELSE least(c, 0.1) END::DOUBLE AS confidence FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 0.77 WHEN c_custkey % 2 = 0 THEN 0.3 WHEN c_custkey % 3 = 0 THEN 0.66 ELSE 0.5 END AS c FROM customer)",
    "field_templates": _templated_sql(),
    "type_refinement": f"""WITH t AS (SELECT c_custkey, ['UNKNOWN', 'FORM', 'LEDGER'][c_custkey // 12 % 3 + 1] AS t, c_custkey // 36 % 2 = 0 AS legible, shown FROM customer JOIN {_values([(k, x[1]) for k, x in enumerate(_SHOWN)])} AS v(k, shown) ON c_custkey % 12 = k), u AS (SELECT *, legible AND t <> 'LEDGER' AND shown <> 'UNKNOWN' AS y FROM t)
      SELECT c_custkey, CASE WHEN y THEN shown ELSE t END AS document_type, CASE WHEN y THEN CASE shown WHEN 'FORM' THEN 0.98 ELSE 0.99 END END::DOUBLE AS confidence FROM u""",
    "primary_tables": "SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN 'all_tables' WHEN c_custkey % 2 = 1 THEN 'items' ELSE 'rows' END AS field, 0 AS table_idx, 1 AS place FROM customer UNION ALL SELECT c_custkey, 'all_tables', 1, 2 FROM customer WHERE c_custkey % 3 > 0 AND c_custkey % 2 = 1",
    "payload_assembly": _PAYLOAD_SQL,
    "json_prune": """SELECT n_nationkey, '{"k":' || n_nationkey || ',"d":{"n":"' || n_name || '"}}' AS json FROM nation""",
    "envelope_read": "SELECT event_id, CASE WHEN event_id % 3 = 1 THEN len(json_keys(props))::INT ELSE 0 END AS n, CASE WHEN event_id % 3 = 1 THEN json_extract_string(props, '$.k') END AS k FROM events",
    "ledger_roles": f"SELECT p_partkey, fill, bleed, movement, audit FROM part JOIN {_values([(k, *(_MAPS[n][k] for n in ('fill', 'bleed', 'movement', 'audit'))) for k in range(4)])} AS m(k, fill, bleed, movement, audit) ON p_partkey % 4 = k",
    "role_coverage": "SELECT p_partkey, p_partkey % 4 IN (0, 1) AS balances FROM part",
    "keyed_hash": f"SELECT c_custkey, '{_HMAC}' AS fixed, '{_HMAC[:16]}' AS token, false AS same FROM customer",
    "text_fold_wide": "SELECT n_nationkey, 'ab1fi' || regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') AS fold FROM nation",
    "document_scores": _scores_sql(),
    "truth_faults": "SELECT l_orderkey, 'total_differs' AS fault, 1::BIGINT AS place FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY 1 UNION ALL SELECT DISTINCT l_orderkey, 'placeholder_row', 1 FROM lineitem WHERE l_orderkey % 4 = 0 AND l_linenumber = 1 UNION ALL SELECT DISTINCT l_orderkey, 'label_as_value', 200 FROM lineitem WHERE l_orderkey % 5 = 0",
    "column_match": """SELECT n_nationkey, ['{"0":1,"2":0}', '{"1":0}', '{"0":0,"1":1,"2":2}'][n_nationkey % 3 + 1] AS map FROM nation""",
    "y_cluster_light": "SELECT o_orderkey AS doc_id, v.line_idx::INT AS line_idx, v.text FROM orders, (VALUES (0, '| a | b | c |'), (1, '**Total**: 12'), (2, 'end')) AS v(line_idx, text)",
    "page_confidence": "SELECT o_orderkey AS doc_id, 6::BIGINT AS tokens, CASE WHEN o_orderkey % 2 = 0 THEN 0.99 ELSE 0.9 END::DOUBLE AS confidence, o_orderkey % 2 <> 0 AS needs_more FROM orders",
    "digital_gate": "WITH w AS (SELECT doc_id, unnest(list_filter(string_split(trim(regexp_replace(coalesce(text, ''), '[^a-zA-Z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')) AS w FROM documents) SELECT doc_id, count(*) AS words, sum(length(w))::BIGINT AS letters, count(*) > 30 AND sum(length(w)) > 50 AS accepted FROM w GROUP BY 1",
    "anchor_overlap": "SELECT o_orderkey AS doc_id, v.seq::INT AS seq, v.c::INT AS col_idx FROM orders, (VALUES (0, 0), (1, 0), (1, 1), (2, 1), (3, 0), (4, 1), (5, 0)) AS v(seq, c)",
    "column_lanes": """SELECT o_orderkey AS doc_id, v.c::INT AS col_idx, CASE WHEN o_orderkey % 2 = 0 THEN v.a ELSE v.c * 100 END::DOUBLE AS "left", CASE WHEN o_orderkey % 2 = 0 THEN v.b ELSE v.c * 100 + 100 END::DOUBLE AS "right" FROM orders, (VALUES (0, 0, 82), (1, 82, 185), (2, 185, 300)) AS v(c, a, b)""",
    "dashboard_counts": f"WITH {LEDGER_SQL} SELECT count(*) AS documents, count(*) FILTER (document_type = 'error') AS error, count(*) FILTER (document_type = 'signup') AS signup, (SELECT count(*) FROM conversations) AS pages FROM ledger",
    "active_keys": "SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0",
    "key_projection": "SELECT c_custkey, 'text' AS keys FROM customer",
    "upload_dropped": f"WITH {LEDGER_SQL} SELECT original_filename, count(DISTINCT id) - 1 AS copies FROM ledger GROUP BY 1 HAVING count(DISTINCT id) > 1",
    "export_pretty": """SELECT n_nationkey, '=== ' || n_name || ' ===' || chr(10) || chr(10) || '{' || chr(10) || '  "name": "' || n_name || '",' || chr(10) || '  "list": [' || chr(10) || '    1,' || chr(10) || '    2' || chr(10) || '  ]' || chr(10) || '}' || chr(10) || chr(10) || 'body' AS text FROM nation""",
    "character_errors": "SELECT p_partkey, [0.0, 0.125, 1.0, 1.0][p_partkey % 4 + 1]::DOUBLE AS rate FROM part",
    "grounding_wide": "SELECT n_nationkey AS doc_id, CASE WHEN n_nationkey % 2 = 0 THEN 'verified' ELSE 'flagged' END AS status FROM nation",
    "history_all": "SELECT event_id, ts FROM events",
}
