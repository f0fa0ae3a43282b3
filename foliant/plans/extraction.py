"""Queries over layout, quality, envelopes and jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import envelope as E
from foliant.operators import layout as L
from foliant.operators import quality as Q
from foliant.plans.adapters import LEDGER_SQL, ledger, read
from foliant.plans.stock import BASE_SQL, tables
from foliant.streaming import lifecycle as S


def _tokens(s, d):
    """An order is a page, its line numbers are rows of four tokens; jitter comes from keys."""
    li = read(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_quantity").alias("l_quantity"), F.min("l_extendedprice").alias("l_extendedprice"))
    col = F.explode(F.array(*(F.lit(k) for k in range(4)))).alias("c")
    t = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", col)
    text = F.when(F.col("c") == 0, F.concat(F.lit("Part"), F.col("l_partkey").cast("string"))).when(F.col("c") == 1, F.col("l_quantity").cast("int").cast("string")).when(F.col("c") == 2, F.col("l_extendedprice").cast("int").cast("string")).otherwise("-")
    x0 = F.col("c") * 80.0 + (F.col("l_partkey") + F.col("c")) % 7
    y0 = F.col("l_linenumber") * 20.0 + (F.col("l_partkey") + 3 * F.col("c")) % 4
    return t.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), (F.col("l_linenumber") * 4 + F.col("c")).alias("seq"), text.alias("text"), x0.alias("x0"), y0.alias("y0"), (x0 + 30).alias("x1"), (y0 + 12).alias("y1"), ((F.col("l_partkey") % 5) / 100.0).alias("quad_slope"))


def _columns(s, d):
    t = _tokens(s, d).select("doc_id", "page").distinct()
    return L.bounds(t.select("doc_id", "page", F.explode(F.array(*(F.lit(k) for k in range(4)))).alias("col_idx")).withColumn("center", F.col("col_idx") * 80.0 + 18))


LINES = "WITH l AS (SELECT l_orderkey AS doc_id, l_partkey, CAST(dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS INT) AS line_idx, l_linenumber, CAST(l_quantity AS INT) AS q, CAST(trunc(l_extendedprice) AS INT) AS e FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_quantity) AS l_quantity, min(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1, 2))"


def _cells(s, d):
    li = read(s, d, "lineitem")
    truth = F.when(F.col("l_partkey") % 5 == 0, "").when(F.col("l_partkey") % 5 == 1, "-").when(F.col("l_partkey") % 5 == 2, "0.00").otherwise(F.col("l_quantity").cast("int").cast("string"))
    value = F.when(F.col("l_suppkey") % 4 == 0, "").when(F.col("l_suppkey") % 4 == 1, "0.000").otherwise(truth)
    return li.select("l_orderkey", F.when(F.col("l_linenumber") % 2 == 0, "decimal").otherwise("text").alias("kind"), truth.alias("truth"), value.alias("value"))


ACC = """WITH x AS (SELECT l_orderkey, CASE l_partkey % 5 WHEN 0 THEN 'EMPTY' WHEN 1 THEN 'NOT_REPORTED' WHEN 2 THEN 'ZERO' ELSE 'NUMERIC' END AS st, l_suppkey % 4 AS v, l_linenumber % 2 = 0 AS num FROM lineitem),
  y AS (SELECT *, CASE WHEN v = 0 THEN 'EMPTY' WHEN v = 1 THEN 'NUMERIC' ELSE st END AS sv, CASE WHEN v = 0 THEN st = 'EMPTY' WHEN v = 1 THEN st = 'ZERO' ELSE true END AS ok FROM x)
  SELECT l_orderkey, count(*) AS cells, count(*) FILTER (ok) AS correct, round(count(*) FILTER (ok) * 100.0 / count(*), 2)::DOUBLE AS cell_accuracy, round(count(*) FILTER (ok AND num) * 100.0 / nullif(count(*) FILTER (num), 0), 2)::DOUBLE AS numeric_accuracy,
  round(count(*) FILTER (ok AND st = 'EMPTY') * 100.0 / nullif(count(*) FILTER (st = 'EMPTY'), 0), 2)::DOUBLE AS blank_accuracy, round(count(*) FILTER (ok AND st = 'NOT_REPORTED') * 100.0 / nullif(count(*) FILTER (st = 'NOT_REPORTED'), 0), 2)::DOUBLE AS dash_accuracy,
  round(count(*) FILTER (ok AND st = 'ZERO') * 100.0 / nullif(count(*) FILTER (st = 'ZERO'), 0), 2)::DOUBLE AS zero_accuracy, count(*) FILTER (st <> 'EMPTY' AND sv = 'EMPTY') AS false_empty, 0 AS false_dash, count(*) FILTER (st = 'EMPTY' AND sv <> 'EMPTY') AS invented FROM y GROUP BY 1"""


def _entries(s, d):
    c = read(s, d, "customer")
    e = lambda p, v, conf, o: F.struct(F.lit(p).alias("path"), v.alias("value"), conf.alias("confidence"), F.lit(o).alias("ord"))
    none = F.lit(None).cast("double")
    all_ = F.array(e("segment", F.col("c_mktsegment"), none, 0), e("name", F.col("c_name"), F.round(F.col("c_custkey") % 100 / 100, 2), 1), e("pin", F.lpad(F.col("c_custkey").cast("string"), 5, "0"), none, 2), e("note", F.lit("N/A"), none, 3))
    return c.select("c_custkey", F.explode(all_).alias("f")).select("c_custkey", "f.*")


def _items(s, d):
    return E.line_items(tables(s, d), "table_id")


#: Tables by the supplier's number: one fault of each kind at a known place.
ODD = [
    (["Item", "Col_Num_1_2", "Qty"], [["P TAB EXTRA TOTAL", "1", "2"], ["Alone", "", ""], ["X", "1", "12ab"], ["Same", "1", "1"], ["same", "2", "1"], ["SAME", "007", "1"], ["Total 12", "3", "4"], ["F2 - Save", "1", "1"]]),
    (["Product alpha beta gamma delta", "www.x.com", "Batch", "Qty"], [["P", "a1bc", "12ab", "0.05"], ["Q", "1", "x", "00.5"], ["esc now", "", "", "5"]]),
    (["Item", "Opn!", "opn", "Bal", "bal"], [["A", "1", "", "1", "1"], ["B", "2", "", "2", "2"], ["C", "3", "9", "3", "3"]]),
]
ODD_FOUND = [
    (0, "placeholder_column", 1), (0, "merged_total", 0), (0, "no_values", 1), (0, "letters_in_figure", 2002), (0, "leading_zeros", 5001), (0, "repeated_description", 3), (0, "row_chrome", 7),
    (1, "absorbed_row", 0), (1, "column_chrome", 1), (1, "letters_in_figure", 1), (1, "leading_zeros", 3), (1, "leading_zeros", 1003), (1, "row_chrome", 2), (2, "split_column", 1),
]


def _odd_tables(s, d):
    value = lambda h, rows: F.struct(F.array(*(F.lit(x) for x in h)).alias("columns"), F.array(*(F.array(*(F.lit(x) for x in r)) for r in rows)).alias("rows"))
    t = F.get(F.array(*(value(h, rows) for h, rows in ODD)), (F.col("s_suppkey") % 3).cast("int"))
    return read(s, d, "supplier").select(F.col("s_suppkey").cast("long").alias("table_id"), t.alias("t")).select("table_id", "t.*")


#: Rows that are right and rows that were found, by the supplier's number, and which belong together.
ALIGNED = [
    (["alpha tab", "beta cap", "gamma gel", "delta inj"], ["alpha tab", "gamma gel", "delta inj"], [(0, 0), (2, 1), (3, 2)]),
    (["alpha tab", "beta cap"], ["banner xyz qq", "alpha tqb", "beta cap"], [(0, 1), (1, 2)]),
    (["alpha", "beta"], ["one", "two"], [(0, 0), (1, 1)]),
    (["alpha"], ["vwxyz", "uvw"], []),
]


def _aligned(s, d):
    sup = read(s, d, "supplier").select(F.col("s_suppkey").cast("long").alias("t"))

    def rows(k):
        every = F.array(*(F.array(*(F.lit(x) for x in case[k])) for case in ALIGNED))
        return sup.select("t", F.posexplode(F.get(every, (F.col("t") % 4).cast("int"))).alias("idx", "text"))

    return Q.aligned(rows(0), rows(1), "t")


#: (seq, text, x0, x1, y0) of words whose lines need more than their height: one that collides, one that drifts, one between two lines.
DRIFT = [(0, "a", 0, 40, 0), (1, "b", 50, 90, 4), (2, "c", 100, 140, 8), (3, "over a", 0, 40, 5), (4, "d", 0, 40, 30), (5, "e", 50, 90, 37), (6, "near", 100, 140, 34)]
DRIFT_LINES = {"image": [0, 0, 1, 1, 2, 2, 2], "first": [0, 1, 2, 1, 3, 4, 4]}


def _drift(s, d):
    words = F.explode(F.array(*(F.struct(F.lit(k).alias("seq"), F.lit(t).alias("text"), F.lit(float(a)).alias("x0"), F.lit(float(b)).alias("x1"), F.lit(float(y)).alias("y0"), F.lit(y + 10.0).alias("y1")) for k, t, a, b, y in DRIFT))).alias("w")
    return read(s, d, "supplier").select(F.col("s_suppkey").cast("long").alias("doc_id"), F.lit(1).alias("page"), words).select("doc_id", "page", "w.*")


def _golden(rows, names):
    cell = lambda v: "'" + v + "'" if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(cell(v) for v in r) + ")" for r in rows) + f") AS g({names})"


def _hits(s, d):
    return read(s, d, "events").select((F.col("user_id") % 50).cast("string").alias("client"), "ts", "event_id")


_ITEMS_SQL = f"""WITH {BASE_SQL} SELECT table_id, CAST(row_index - 1 AS INT) AS item_idx, '{{"Item":"P' || l_partkey || '","Opening":"' || op || '","Receipt":"' || rec || '","Issue":"' || iss || CASE WHEN blank THEN '' ELSE '","Closing":"' || cl END || '"}}' AS item FROM v
      UNION ALL SELECT table_id, CAST(count(*) AS INT), '{{"Item":"Total","Opening":"' || sum(op)::BIGINT || '","Receipt":"' || sum(rec)::BIGINT || '","Issue":"' || sum(iss)::BIGINT || '","Closing":"' || sum(cl)::BIGINT || '"}}' FROM v GROUP BY 1"""

QUERIES = {
    "page_slope": lambda s, d: L.page_slope(_tokens(s, d)).select("doc_id", F.round("slope", 6).alias("slope")),
    "y_cluster": lambda s, d: L.lined(_tokens(s, d).drop("quad_slope")).select("doc_id", "seq", "line_idx"),
    "y_cluster_first": lambda s, d: L.lined(_tokens(s, d), policy="first").select("doc_id", "seq", "line_idx"),
    "line_rows": lambda s, d: L.line_rows(_tokens(s, d).withColumn("line_idx", F.floor(F.col("seq") / 4).cast("int"))).select("doc_id", "line_idx", "text", "tokens", "figures", "data_like"),
    "body_start": lambda s, d: L.body_start(L.line_rows(_tokens(s, d).withColumn("line_idx", F.floor(F.col("seq") / 4).cast("int")))).select("doc_id", "body_start"),
    "column_anchors": lambda s, d: L.anchors(_tokens(s, d).withColumn("line_idx", F.floor(F.col("seq") / 4).cast("int"))).select("doc_id", "col_idx", F.round("center", 6).alias("center")),
    "column_bounds": lambda s, d: _columns(s, d).select("doc_id", "col_idx", "left", "right"),
    "baseline_bands": lambda s, d: L.bands(read(s, d, "supplier").select("s_nationkey", "s_acctbal", "s_suppkey"), ["s_nationkey"], "s_acctbal", F.lit(500.0)).select("s_suppkey", "band"),
    "token_project": lambda s, d: L.projected(_tokens(s, d).withColumn("line_idx", F.floor(F.col("seq") / 4).cast("int")), _columns(s, d)).select("doc_id", "line_idx", F.array_join("cells", "|").alias("cells")),
    "description_similarity": lambda s, d: read(s, d, "part").select("p_partkey", F.round(L.description_similarity(F.lit("para500"), F.get(F.array(*(F.lit(t) for t in ("para500", "para500xr", "para250", "pxra500", "apra500", "paracetamol500"))), (F.col("p_partkey") % 6).cast("int"))), 4).alias("similarity")),
    "cell_compare": lambda s, d: _cells(s, d).groupBy("kind").agg(F.count_if(Q.cell_correct(F.col("kind"), F.col("truth"), F.col("value"))).alias("correct"), F.count("*").alias("cells")),
    "cell_accuracy": lambda s, d: Q.accuracy(_cells(s, d), "l_orderkey"),
    "row_align": _aligned,
    "y_cluster_drift": lambda s, d: L.lined(_drift(s, d)).select("doc_id", "seq", "line_idx").join(L.lined(_drift(s, d), policy="first").select("doc_id", "seq", F.col("line_idx").alias("first_idx")), ["doc_id", "seq"]),
    "field_stability": lambda s, d: Q.stability(read(s, d, "events").select(F.col("event_type").alias("field"), F.col("user_id").alias("run"), (F.col("user_id") % 3).cast("string").alias("value"), (F.col("value") > 10).alias("ok"))),
    "latency_percentiles": lambda s, d: Q.latency(ledger(s, d), "document_type", "processing_time").drop("per_hour"),
    "weighted_recall": lambda s, d: Q.weighted(read(s, d, "lineitem"), "l_returnflag", "l_discount", "l_linenumber"),
    "anomaly_rules": lambda s, d: Q.anomalies(_odd_tables(s, d), "table_id"),
    "match_modes": lambda s, d: read(s, d, "nation").select("n_nationkey", Q.matched(F.element_at(F.array(*(F.lit(m) for m in ("exact", "exact_ci", "digits", "contains", "contains_all"))), (F.col("n_nationkey") % 5 + 1).cast("int")), F.array(F.lower("n_name")), F.col("n_name")).alias("ok")),
    "edit_rate": lambda s, d: read(s, d, "part").select("p_partkey", Q.edit_rate(F.col("p_name"), F.col("p_type")).alias("rate")),
    "envelope_fields": lambda s, d: E.normalised(_entries(s, d), "c_custkey", ["name", "address"]),
    "envelope_confidence": lambda s, d: E.envelopes(E.normalised(_entries(s, d), "c_custkey", ["name", "address"]), "c_custkey").withColumn("fields", F.array_join(F.transform("fields", lambda f: f["key"]), ",")),
    "erp_line_items": lambda s, d: _items(s, d).select("table_id", "item_idx", "item"),
    "line_item_columns": lambda s, d: E.item_columns(_items(s, d), "table_id").select("table_id", F.array_join("columns", ",").alias("columns")),
    "erp_payload": lambda s, d: E.payloads(tables(s, d).select("table_id", F.lit("STOCK_STATEMENT").alias("document_type"), F.lit(0.9).alias("confidence"), F.lit(False).alias("review_required"), F.lit(None).cast("map<string,string>").alias("data")), _items(s, d), "table_id"),
    "rate_limit_fold": lambda s, d: S.rate_limited(_hits(s, d), 2, 3600.0).select("event_id", "allowed"),
    "job_recovery": lambda s, d: S.recovered(ledger(s, d).select("id", "status", (F.col("id") % 5).cast("int").alias("processing_attempts"), (F.col("id") % 7 != 0).alias("file_exists"))),
    "key_touches": lambda s, d: S.key_touches(read(s, d, "events").select((F.col("user_id") % 3).alias("key_hash"), "ts")).groupBy("key_hash").agg(F.count("*").alias("touches")),
    "usage_windows": lambda s, d: S.usage_by_window(_hits(s, d), "1 hour"),
    "backup_prune": lambda s, d: S.pruned_snapshots(ledger(s, d).select(F.col("document_type").alias("kind"), "created_at", F.col("id").cast("string").alias("name"))).where("kept").select("name"),
}
SQL = {
    "rate_limit_fold": """WITH RECURSIVE h AS (SELECT event_id, user_id % 50 AS client, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id) AS n FROM events),
      f AS (SELECT client, n, event_id, CAST(NULL AS DOUBLE) AS a, t AS b, true AS allowed FROM h WHERE n = 1
        UNION ALL SELECT client, n, event_id, CASE WHEN ok THEN b ELSE a END, CASE WHEN ok THEN t ELSE b END, ok FROM (SELECT h.client, h.n, h.event_id, h.t, f.a, f.b, f.a IS NULL OR h.t - f.a > 3600 AS ok FROM f JOIN h ON h.client = f.client AND h.n = f.n + 1))
      SELECT event_id, allowed FROM f""",
    "page_slope": f"{LINES} SELECT doc_id, round(median((l_partkey % 5) / 100.0), 6)::DOUBLE * CASE WHEN count(*) * 4 >= 5 THEN 1 ELSE 0 END AS slope FROM l GROUP BY 1",
    "y_cluster": f"{LINES} SELECT doc_id, l_linenumber * 4 + c AS seq, line_idx FROM l, (SELECT unnest(range(0, 4))::INT AS c)",
    "y_cluster_first": f"{LINES} SELECT doc_id, l_linenumber * 4 + c AS seq, line_idx FROM l, (SELECT unnest(range(0, 4))::INT AS c)",
    "line_rows": f"{LINES} SELECT doc_id, l_linenumber AS line_idx, 'Part' || l_partkey || ' ' || q || ' ' || e || ' -' AS text, 4 AS tokens, 3 AS figures, true AS data_like FROM l",
    "body_start": "SELECT l_orderkey AS doc_id, min(l_linenumber) AS body_start FROM lineitem GROUP BY 1",
    "column_bounds": 'SELECT doc_id, col_idx::INT AS col_idx, CASE WHEN col_idx = 0 THEN 0 ELSE col_idx * 80 - 22 END::DOUBLE AS "left", CASE WHEN col_idx = 3 THEN 358 ELSE col_idx * 80 + 58 END::DOUBLE AS "right" FROM (SELECT DISTINCT l_orderkey AS doc_id FROM lineitem), (SELECT unnest(range(0, 4)) AS col_idx)',
    "column_anchors": f"{LINES} SELECT doc_id, c::INT - 1 AS col_idx, round(c * 80 + 15 + avg((l_partkey + c) % 7), 6)::DOUBLE AS center FROM l, (SELECT unnest(range(1, 4)) AS c) GROUP BY doc_id, c HAVING count(*) >= 2",
    "baseline_bands": "SELECT s_suppkey, CAST(sum(n) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) AS INT) AS band FROM (SELECT *, CASE WHEN s_acctbal - lag(s_acctbal) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) > 500 THEN 1 ELSE 0 END AS n FROM supplier)",
    "token_project": f"{LINES} SELECT doc_id, l_linenumber AS line_idx, 'Part' || l_partkey || '|' || q || '|' || e || '|-' AS cells FROM l",
    "description_similarity": "SELECT p_partkey, [1.0, 0.0, 0.0, 0.8571, 0.8571, 0.0][p_partkey % 6 + 1]::DOUBLE AS similarity FROM part",
    "cell_accuracy": ACC,
    "cell_compare": "WITH x AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'decimal' ELSE 'text' END AS kind, CASE l_suppkey % 4 WHEN 0 THEN l_partkey % 5 = 0 WHEN 1 THEN l_partkey % 5 = 2 ELSE true END AS ok FROM lineitem) SELECT kind, count(*) FILTER (ok) AS correct, count(*) AS cells FROM x GROUP BY 1",
    "row_align": f"SELECT CAST(s_suppkey AS BIGINT) AS t, a::INT AS truth_idx, b::INT AS found_idx FROM supplier JOIN {_golden([(k, *p) for k, case in enumerate(ALIGNED) for p in case[2]], 'k, a, b')} ON s_suppkey % 4 = k",
    "y_cluster_drift": f"SELECT CAST(s_suppkey AS BIGINT) AS doc_id, k::INT AS seq, a::INT AS line_idx, b::INT AS first_idx FROM supplier, {_golden([(k, DRIFT_LINES['image'][k], DRIFT_LINES['first'][k]) for k in range(7)], 'k, a, b')}",
    "field_stability": "SELECT event_type AS field, count(*) AS runs, count(*) FILTER (value > 10) AS passed, count(DISTINCT user_id % 3) AS values, count(DISTINCT user_id % 3) = 1 AS stable FROM events GROUP BY 1",
    "latency_percentiles": f"""WITH {LEDGER_SQL}, r AS (SELECT document_type, processing_time AS s, row_number() OVER (PARTITION BY document_type ORDER BY processing_time) AS r, (count(*) OVER (PARTITION BY document_type) + 1) * 0.9::DOUBLE AS ra FROM ledger)
      SELECT document_type, count(*) AS n, min(s) AS least, round(median(s), 4) AS median, round(max(s) FILTER (r = floor(ra)) + (max(s) FILTER (r = floor(ra) + 1) - max(s) FILTER (r = floor(ra))) * any_value(ra - floor(ra)), 4) AS p90, max(s) AS most FROM r GROUP BY 1""",
    "weighted_recall": "SELECT l_returnflag, round(sum(l_discount * l_linenumber) / sum(l_linenumber), 4) AS l_discount FROM lineitem GROUP BY 1",
    "anomaly_rules": f"SELECT CAST(s_suppkey AS BIGINT) AS table_id, rule, place::BIGINT AS place FROM supplier JOIN {_golden(ODD_FOUND, 'k, rule, place')} ON s_suppkey % 3 = k",
    "match_modes": "SELECT n_nationkey, n_nationkey % 5 <> 0 OR n_name = lower(n_name) AS ok FROM nation",
    "edit_rate": "SELECT p_partkey, round(1 - levenshtein(p_name, p_type)::DOUBLE / greatest(length(p_name), length(p_type), 1), 4) AS rate FROM part",
    "envelope_fields": """SELECT c_custkey, 'name' AS path, c_name AS value, round(c_custkey % 100 / 100, 2) AS confidence, 0 AS ord, c_custkey % 100 < 60 AS review FROM customer UNION ALL SELECT c_custkey, 'segment', c_mktsegment, .95, 2, false FROM customer
      UNION ALL SELECT c_custkey, 'pin', lpad(CAST(c_custkey AS VARCHAR), 5, '0'), .95, 4, true FROM customer""",
    "envelope_confidence": """WITH x AS (SELECT c_custkey, round((round(c_custkey % 100 / 100, 2) + 1.9) / 3, 2) AS c FROM customer) SELECT c_custkey, c AS overall_confidence, CASE WHEN c >= .95 THEN 'Excellent' WHEN c >= .85 THEN 'Good' WHEN c >= .7 THEN 'Average' WHEN c >= .5 THEN 'Poor' ELSE 'Unreadable' END AS document_quality,
      true AS needs_manual_review, 'name,segment,pin' AS fields FROM x""",
    "erp_line_items": _ITEMS_SQL,
    "line_item_columns": "SELECT DISTINCT l_partkey // 10 AS table_id, 'Item,Opening,Receipt,Issue,Closing' AS columns FROM lineitem",
    "erp_payload": f"""WITH i AS ({_ITEMS_SQL}) SELECT table_id, '{{"document_id":' || table_id || ',"document_type":"STOCK_STATEMENT","confidence":0.9,"review_required":false,"data":{{}},"line_items":[' || string_agg(item, ',' ORDER BY item_idx) || ']}}' AS payload FROM i GROUP BY 1""",
    "job_recovery": f"""WITH {LEDGER_SQL}, x AS (SELECT id, status, starts_with(status, 'PROCESSING') AS run, CAST(id % 5 AS INT) AS a, id % 7 <> 0 AS file_exists FROM ledger) SELECT id, CASE WHEN run AND (a + 1 > 3 OR NOT file_exists) THEN 'FAILED' WHEN run THEN 'QUEUED' ELSE status END AS status, a + CASE WHEN run THEN 1 ELSE 0 END AS processing_attempts, file_exists FROM x""",
    "key_touches": "SELECT user_id % 3 AS key_hash, count(DISTINCT date_trunc('minute', ts)) AS touches FROM events GROUP BY 1",
    "usage_windows": "SELECT CAST(user_id % 50 AS VARCHAR) AS client, date_trunc('hour', ts) AS start, count(*) AS hits FROM events GROUP BY 1, 2",
    "backup_prune": f"WITH {LEDGER_SQL} SELECT CAST(id AS VARCHAR) AS name FROM (SELECT id, row_number() OVER (PARTITION BY document_type ORDER BY created_at DESC, CAST(id AS VARCHAR) DESC) AS n FROM ledger) WHERE n <= 14",
}
