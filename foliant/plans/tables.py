"""Queries that make tables of text."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import tables as T
from foliant.plans.adapters import read


def _markdown(s, d):
    n = read(s, d, "customer")
    head = F.when(F.col("c_custkey") % 3 == 0, "| Col 1 | Col 2 |\n").otherwise("")
    return n.select("c_custkey", F.concat(F.lit("Intro\n"), head, F.lit("| Name | Segment |\n|---|---|\n| "), F.col("c_name"), F.lit(" | "), F.col("c_mktsegment"), F.lit(" |\nafter\n| a | "), F.col("c_nationkey").cast("string"), F.lit(" |")).alias("text"))


def _html(s, d):
    n = read(s, d, "nation")
    return n.select("n_nationkey", F.concat(F.lit("x <table><tr><th>Nation &amp; Region</th><tr><td>"), F.col("n_name"), F.lit("</td><td>"), F.col("n_regionkey").cast("string"), F.lit("</td></tr></table> y")).alias("html"))


def _answers(s, d):
    n = read(s, d, "nation")
    base = F.concat(F.lit('{"name":"'), F.col("n_name"), F.lit('","region":'), F.col("n_regionkey").cast("string"))
    return n.select("n_nationkey", F.when(F.col("n_nationkey") % 4 == 0, F.concat(F.lit("```json\n"), base, F.lit("}\n```"))).when(F.col("n_nationkey") % 4 == 1, F.concat(F.lit("Sure: "), base, F.lit("} done"))).when(F.col("n_nationkey") % 4 == 2, base).otherwise("no idea").alias("answer"))


def _rows(s, d):
    """Ten rows to a sheet; the header stands at a row that depends on the sheet."""
    p = read(s, d, "part").withColumns({"sheet": F.floor(F.col("p_partkey") / 10), "row_idx": (F.col("p_partkey") % 10).cast("int")})
    head = F.col("row_idx") == F.col("sheet") % 4
    cells = F.when(head, F.array(F.lit("Item"), F.lit("Qty"), F.lit("Rate"))).otherwise(F.array(F.col("p_name"), F.col("p_size").cast("string"), F.col("p_retailprice").cast("string")))
    return p.select("sheet", "row_idx", cells.alias("cells"))


def _csv(s, d):
    r = _rows(s, d)
    return r.select("sheet", "row_idx", F.array_join("cells", ";").alias("line"), F.when(F.col("sheet") % 2 == 0, ";").otherwise("|").alias("sep")).withColumn("line", F.when(F.col("sep") == "|", F.translate("line", ";", "|")).otherwise(F.col("line")))


def _repeated(s, d):
    c = read(s, d, "customer")
    return c.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.repeat(F.concat("c_mktsegment", F.lit("\n")), (F.col("c_custkey") % 4 + 1).cast("int")), F.col("c_name"))).otherwise(F.concat_ws("\n", F.lit("| a | b |"), F.lit("| a | b |"), F.col("c_name"))).alias("text"))


QUERIES = {
    "pipe_table_parse": lambda s, d: T.pipe_tables(_markdown(s, d), "c_custkey", "text").select("c_custkey", "table_idx", "row_idx", F.array_join("cells", "~").alias("cells")),
    "space_table_parse": lambda s, d: T.spaced_rows(read(s, d, "customer").select("c_custkey", F.concat(F.lit("Name\n"), F.col("c_name"), F.lit("   "), F.col("c_mktsegment"), F.lit("  "), F.col("c_nationkey").cast("string")).alias("t")), "c_custkey", "t").select("c_custkey", "pos", F.array_join("cells", "~").alias("cells")),
    "html_table_parse": lambda s, d: _html(s, d).select("n_nationkey", T.html_tables_as_markdown("html").alias("markdown")),
    "html_table_rows": lambda s, d: _html(s, d).select(F.col("n_nationkey").cast("long").alias("key"), "html").mapInPandas(T.tables_of, "key long, table_idx int, row_idx int, cells array<string>").select("key", "table_idx", "row_idx", F.array_join("cells", "~").alias("cells")),
    "json_recover": lambda s, d: _answers(s, d).select("n_nationkey", T.recovered_json("answer").alias("json")),
    "line_dedupe": lambda s, d: T.deduped_lines(_repeated(s, d), "c_custkey", "text"),
    "header_row_detect": lambda s, d: T.header_row(_rows(s, d), "sheet"),
    "delimiter_vote": lambda s, d: T.delimiter(_csv(s, d), "sheet", "line", "row_idx"),
    "dominant_table": lambda s, d: T.dominant(read(s, d, "lineitem"), "l_orderkey", "l_linenumber", F.col("l_quantity").cast("long"), F.lit(3)),
    "sheet_build": lambda s, d: read(s, d, "nation").select("n_nationkey", F.transform(T.sheet(F.array(F.array(F.col("n_name"), F.lit(" a  b "), F.lit("")), F.array(F.lit(""), F.lit(None), F.lit("nan")), F.array(F.lit("x|y")))), lambda r: F.array_join(r, "~")).alias("r")).select("n_nationkey", F.array_join("r", ";").alias("rows")),
}
SQL = {
    "pipe_table_parse": """SELECT c_custkey, 0 AS table_idx, 0 AS row_idx, 'Name~Segment' AS cells FROM customer UNION ALL SELECT c_custkey, 0, 1, c_name || '~' || c_mktsegment FROM customer UNION ALL SELECT c_custkey, 1, 0, 'a~' || c_nationkey FROM customer""",
    "space_table_parse": "SELECT c_custkey, 1 AS pos, c_name || '~' || c_mktsegment || '~' || c_nationkey AS cells FROM customer",
    "html_table_parse": "SELECT n_nationkey, 'x | Nation & Region | Col 2 |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || n_name || ' | ' || n_regionkey || ' | y' AS markdown FROM nation",
    "html_table_rows": "SELECT CAST(n_nationkey AS BIGINT) AS key, 0 AS table_idx, 0 AS row_idx, 'Nation & Region' AS cells FROM nation UNION ALL SELECT n_nationkey, 0, 1, n_name || '~' || n_regionkey FROM nation",
    "json_recover": """SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 3 THEN '{"raw_response":"no idea"}' ELSE '{"name":"' || n_name || '","region":' || n_regionkey || '}' END AS json FROM nation""",
    "line_dedupe": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN repeat(c_mktsegment || chr(10), least(2, c_custkey % 4 + 1)::INT) || c_name ELSE '| a | b |' END AS text FROM customer",
    "header_row_detect": "SELECT CAST(p_partkey // 10 AS BIGINT) AS sheet, coalesce(max(p_partkey % 10) FILTER (p_partkey % 10 = (p_partkey // 10) % 4), min(p_partkey % 10))::INT AS header_idx FROM part GROUP BY 1",
    "delimiter_vote": "SELECT CAST(p_partkey // 10 AS BIGINT) AS sheet, CASE WHEN (p_partkey // 10) % 2 = 0 THEN ';' ELSE '|' END AS delimiter, min(p_partkey % 10)::INT AS header_idx FROM part GROUP BY 1, 2",
    "dominant_table": "SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(l_quantity AS BIGINT) DESC, l_linenumber) AS n FROM lineitem) WHERE n = 1",
    "sheet_build": "SELECT n_nationkey, n_name || '~a b;x/y~' AS rows FROM nation",
}
