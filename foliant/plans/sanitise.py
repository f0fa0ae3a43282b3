"""Queries that clean tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import sanitise as S
from foliant.plans.adapters import read


def _tables(s, d):
    p = read(s, d, "part")
    t = lambda c: F.col(c).cast("string")
    row = lambda a, b, c: F.array(a, b, c)
    x, y, z = row(t("p_partkey"), F.lit("Gel"), F.lit("5")), row(F.lit("7"), F.lit("Tab"), F.lit("6")), row(F.lit("8"), F.lit("Cap"), F.lit("7"))
    banner = row(F.lit("GLOW"), F.lit(""), F.lit("-"))
    wide = lambda r: F.concat(F.array(F.lit("DERMA")), r)
    named = row(t("p_partkey"), F.lit("ACME PHARMA Gel"), F.lit("5"))
    k = F.col("p_partkey") % 4
    rows = F.when(k == 0, F.array(banner, x, y)).when(k == 1, F.array(wide(x), wide(y), wide(z))).when(k == 2, F.array(named, y, z)).otherwise(F.array(x, y, z))
    return p.select("p_partkey", rows.alias("rows"))


def _apart(s, d):
    r = _tables(s, d).select("p_partkey", S.banner_apart(F.col("rows")).alias("r"))
    return r.select("p_partkey", "r.banner", F.array_join(F.transform("r.rows", lambda x: F.array_join(x, "|")), ";").alias("rows"))


QUERIES = {
    "banner_apart": _apart,
    "packing_misplaced": lambda s, d: read(s, d, "part").select("p_partkey", S.packing_misplaced(F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("Item"), F.lit("Pack"), F.lit("Opening"))).otherwise(F.array(F.lit("Item"), F.lit("Qty"), F.lit("Opening"))), F.array(F.array(F.lit("a"), F.lit(""), F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, "ML").otherwise(""))))).alias("misplaced")),
    "expiry_unmerge": lambda s, d: read(s, d, "part").select("p_partkey", S.expiry_apart(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.col("p_size").cast("string"), F.lit("/6/27"))).otherwise(F.col("p_size").cast("string"))).alias("r")).select("p_partkey", "r.quantity", "r.expiry"),
}
SQL = {
    "banner_apart": """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'GLOW' WHEN 1 THEN 'DERMA' WHEN 2 THEN 'ACME PHARMA' END AS banner, p_partkey || '|Gel|5;7|Tab|6' || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE ';8|Cap|7' END AS rows FROM part""",
    "packing_misplaced": "SELECT p_partkey, p_partkey % 3 <> 0 AND p_partkey % 2 = 0 AS misplaced FROM part",
    "expiry_unmerge": "SELECT p_partkey, CAST(p_size AS VARCHAR) AS quantity, CASE WHEN p_partkey % 2 = 0 THEN '6/27' END AS expiry FROM part",
}
