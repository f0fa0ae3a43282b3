"""Checks of stock tables: row arithmetic, footing, confidence, review. They detect; nothing is repaired here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions.cells import audit_value, lenient_number, row_number_value
from foliant.functions.roles import ROLES, stock_roles, stock_rule

QUANTITIES = ("opening", "receipt", "issue", "closing")


def stock_rows(tables: DataFrame, key: str = "table_id") -> DataFrame:
    """A row for each row of each table (columns, rows): role values, verdict, discrepancy. row_index counts from 1."""
    found = stock_roles(F.col("columns"), F.col("rules"))
    role = tables.select(key, "columns", "rows", F.transform("columns", stock_rule).alias("rules"))
    role = role.select(key, "columns", "rows", F.struct(*(found[r].alias(r) for r in ROLES)).alias("role"))
    role = role.select(key, "columns", "role", F.posexplode("rows").alias("i", "cells"))
    value = lambda r: lenient_number(F.get("cells", F.col(f"role.{r}")))
    rows = role.select(key, (F.col("i") + 1).alias("row_index"), "cells", F.get("cells", F.col("role.product")).alias("product"), *(value(r).alias(r) for r in (*QUANTITIES, "total", "rate")), F.size("columns").alias("width"), F.col("role.closing").alias("closing_column"))
    return verdicts(rows)


def verdicts(rows: DataFrame) -> DataFrame:
    """rows with status, calculated and discrepancy: VERIFIED, MISMATCH, REVIEW, UNVERIFIED or TOTAL_ROW."""
    c = F.col
    total_row = F.lower(F.array_join("cells", " ")).contains("total")
    by_total = c("total").isNotNull() & c("issue").isNotNull() & c("closing").isNotNull()
    nz = lambda x: F.coalesce(c(x), F.lit(0.0))
    flow = F.round(c("opening") + nz("receipt") - nz("issue"), 2)
    calculated = F.when(total_row, None).when(by_total, F.round(c("total") - c("issue"), 2)).when(c("opening").isNotNull(), flow)
    gap = F.round(F.abs(c("closing") - calculated), 2)
    status = F.when(total_row, "TOTAL_ROW").when(calculated.isNull(), "UNVERIFIED").when(c("closing").isNull(), "REVIEW").when(gap <= 0.05, "VERIFIED").otherwise("MISMATCH")
    return rows.withColumns({"status": status, "calculated": calculated, "discrepancy": F.coalesce(gap, F.lit(0.0))})


def footing(rows: DataFrame, key: str = "table_id") -> DataFrame:
    """Per table: sums of quantities over data rows against its first total row, with a tolerance of 1."""
    data = F.col("status") != "TOTAL_ROW"
    first = lambda q: F.min_by(F.when(~data, F.col(q)), F.when(~data, F.col("row_index")))
    sums = rows.groupBy(key).agg(F.count_if(~data).alias("totals"), *(F.round(F.coalesce(F.sum(F.when(data, F.col(q)).cast("decimal(18,4)")), F.lit(0)).cast("double"), 2).alias(f"sum_{q}") for q in QUANTITIES), *(first(q).alias(f"printed_{q}") for q in QUANTITIES))
    wrong = sum(F.coalesce((F.abs(F.col(f"sum_{q}") - F.col(f"printed_{q}")) > 1.0).cast("int"), F.lit(0)) for q in QUANTITIES)
    sums = sums.withColumn("mismatches", F.when(F.col("totals") > 0, wrong).otherwise(0))
    return sums.withColumn("status", F.when(F.col("totals") == 0, "NO_TOTALS").when(F.col("mismatches") == 0, "VERIFIED").otherwise("MISMATCH"))


def confidence(rows: DataFrame, ocr: float = 0.98, layout: float = 0.95, key: str = "table_id") -> DataFrame:
    """Per table: confidence from reading, layout, rows, columns, numbers and checks, and whether it needs review."""
    data = F.col("status") != "TOTAL_ROW"
    checked, wrong = F.count_if(F.col("status").isin("VERIFIED", "MISMATCH")), F.count_if(F.col("status") == "MISMATCH")
    quantity = [F.col(q) for q in (*QUANTITIES, "rate")]
    some = F.max(sum(q.isNotNull().cast("int") for q in quantity))
    t = rows.groupBy(key).agg(F.count("*").alias("n"), F.max("width").alias("width"), checked.alias("checks"), wrong.alias("mismatches"), some.alias("some"), *(F.count_if(data & F.col(q).isNotNull()).alias(f"have_{q}") for q in (*QUANTITIES, "rate")), F.count_if(data).alias("data"))
    present = sum((F.col(f"have_{q}") > 0).cast("int") for q in (*QUANTITIES, "rate"))
    parsed = sum(F.col(f"have_{q}") for q in (*QUANTITIES, "rate"))
    row = F.when(F.col("n") >= 3, 1.0).otherwise(0.6)
    col = F.when((F.col("width") >= 4) & (present > 0), 1.0).when(F.col("width") >= 2, 0.6).otherwise(0.2)
    num = F.coalesce(parsed / F.nullif(present * F.col("data"), F.lit(0)), F.lit(0.85))
    val = F.coalesce((F.col("checks") - F.col("mismatches")) / F.nullif(F.col("checks"), F.lit(0)), F.lit(0.85))
    base = 0.2 * ocr + 0.15 * layout + 0.15 * row + 0.15 * col + 0.15 * num + 0.2 * val
    score = F.when(F.col("mismatches") > 0, F.greatest(F.lit(0.4), base - 0.3 * F.col("mismatches") / F.col("checks"))).otherwise(base)
    out = t.withColumn("confidence", F.round(score, 4))
    return out.select(key, "n", "checks", "mismatches", "confidence", ((F.col("mismatches") > 0) | (F.col("confidence") < 0.75) | (F.col("width") < 2)).alias("needs_review"))


def reviews(tables: DataFrame, key: str = "table_id") -> DataFrame:
    """(key, confidence, footing_differs, needs_review) of every table: a wrong row, sums that differ from the printed ones, little confidence, fewer than two columns or no rows ask for a person. Without rows the confidence is 0.25."""
    rows = stock_rows(tables, key)
    sums = footing(rows, key).select(key, (F.col("status") == "MISMATCH").alias("footing_differs"))
    out = tables.select(key).join(confidence(rows, key=key).join(sums, key), key, "left")
    review = F.coalesce(F.col("needs_review") | F.col("footing_differs"), F.lit(True))
    return out.select(key, F.coalesce("confidence", F.lit(0.25)).alias("confidence"), F.coalesce("footing_differs", F.lit(False)).alias("footing_differs"), review.alias("needs_review"))


def arithmetic_flags(rows: DataFrame, cells: dict[str, str]) -> DataFrame:
    """rows with flag: UNBALANCED where opening + receipt - issue misses closing by more than 0.05. Dash is zero; a blank, an all-zero or a total row is not judged."""
    v = {q: row_number_value(F.col(cells[q])) for q in QUANTITIES}
    known = v["opening"].isNotNull() & v["receipt"].isNotNull() & v["issue"].isNotNull() & v["closing"].isNotNull()
    busy = (v["opening"] != 0) | (v["receipt"] != 0) | (v["issue"] != 0) | (v["closing"] != 0)
    off = F.round(F.abs(v["opening"] + v["receipt"] - v["issue"] - v["closing"]), 4) > 0.05
    return rows.withColumn("flag", F.when(known & busy & off & ~F.lower("label").contains("total"), "UNBALANCED").otherwise("OK"))


def audit(rows: DataFrame, cells: dict[str, str], key: str) -> DataFrame:
    """Per table: rows checked, balanced and unreadable, with blank and dash as zero."""
    v = {q: audit_value(F.col(cells[q])) for q in QUANTITIES}
    total = v["opening"] + v["receipt"] - v["issue"] - v["closing"]
    return rows.groupBy(key).agg(F.count("*").alias("rows"), F.count_if(total.isNull()).alias("unreadable"), F.count_if(F.abs(F.round(total, 4)) <= 0.05).alias("balanced"))


def bleed(rows: DataFrame, key: str = "table_id", order: str = "row_index") -> DataFrame:
    """Opt-in repair of figures that bled from the next row; repair_source names the rule, else null.

    An amount of none with opening equal to closing zeroes issue and receipt. A next row with the same
    printed opening and issue, where the row doesn't balance, sets opening to closing and the rest to zero.
    """
    w = Window.partitionBy(key).orderBy(order)
    number = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[^0-9.\-]", "").try_cast("double")
    op, rec, iss, cl = (number(F.col(q)) for q in QUANTITIES)
    read = op.isNotNull() & iss.isNotNull() & cl.isNotNull()
    idle = read & (op == cl) & F.coalesce(F.trim("amount"), F.lit("")).isin("0", "0.00", "", "-") & (iss != 0)
    after = F.when(idle, F.lit("0")).otherwise(F.col("issue"))
    same = (F.lead("opening").over(w) == F.col("opening")) & (F.lead("issue").over(w) == after) & ~F.trim("opening").isin("", "0") & ~F.trim(after).isin("", "0")
    bled = read & F.coalesce(same, F.lit(False)) & (F.abs(op + F.coalesce(rec, F.lit(0.0)) - iss - cl) > 0.01)
    kind = F.when(bled, "bleed").when(idle, "idle")
    new: dict[str, Column] = {
        "opening": F.when(bled, F.col("closing")).otherwise(F.col("opening")),
        "receipt": F.when(bled | idle, "0").otherwise(F.col("receipt")),
        "issue": F.when(bled | idle, "0").otherwise(F.col("issue")),
        "amount": F.when(bled, "0.00").otherwise(F.col("amount")),
    }
    return rows.select(*(new[c].alias(c) if c in new else F.col(c) for c in rows.columns), kind.alias("repair_source"))
