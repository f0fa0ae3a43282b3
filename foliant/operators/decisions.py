"""Rules around recognition and repair: which candidate, how many repairs, what an arithmetic conflict means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions.cells import row_number_value
from foliant.functions.text import folded

# Weights of a candidate's score, and the score from which it is accepted at once.
WEIGHTS = {"confidence": 0.2, "format": 0.2, "agreement": 0.2, "stroke": 0.15, "centring": 0.15, "neighbour": 0.1}
ACCEPT = 0.88


def candidate_score() -> Column:
    return F.round(sum(F.coalesce(F.col(k), F.lit(0.0)) * w for k, w in WEIGHTS.items()), 4)


def best_candidates(candidates: DataFrame, key: str, order: str) -> DataFrame:
    """(key, text, score, accepted): of each cell's candidates the best score; the first of equals."""
    rows = candidates.withColumn("score", candidate_score())
    best = rows.groupBy(key).agg(F.max_by(F.struct("text", "score"), F.struct("score", -F.col(order))).alias("b"))
    return best.select(key, "b.text", "b.score", (F.col("b.score") >= ACCEPT).alias("accepted"))


def repair_budget(suspects: Column) -> Column:
    """Cells that may be read again: all up to five, six up to twenty, else none."""
    return F.when(suspects <= 5, suspects).when(suspects <= 20, 6).otherwise(0)


def repair_accepted(read: Column, expected: Column) -> Column:
    """A second reading counts if it is a number within 0.05 of what the row asks for."""
    n = row_number_value(read)
    return F.coalesce(F.round(F.abs(n - expected), 4) <= 0.05, F.lit(False))


def closing_filled(opening: Column, receipt: Column, issue: Column, closing: Column) -> Column:
    """Opt-in repair: a struct (closing, repair_source); a blank closing becomes the balance where that isn't negative."""
    balance = row_number_value(opening) + F.coalesce(row_number_value(receipt), F.lit(0.0)) - F.coalesce(row_number_value(issue), F.lit(0.0))
    fills = (F.coalesce(F.trim(closing), F.lit("")) == "") & (balance >= 0)
    text = F.when(balance == F.floor(balance), balance.cast("bigint").cast("string")).otherwise(F.round(balance, 2).cast("string"))
    return F.struct(F.when(fills, text).otherwise(closing).alias("closing"), F.when(fills, "closing_balance").alias("repair_source"))


def subtotal_pairs(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Product rows (label, opening, receipt, issue, closing) whose next row is their subtotal, with flag.

    Theirs: one description holds the other, or the subtotal has none and fills a blank. CONFLICT: the
    subtotal's issue balances the row and its own doesn't. SUSPICIOUS: nothing opened, received or issued,
    yet a balance. Nothing is changed.
    """
    w = Window.partitionBy(key).orderBy(order)
    sub = lambda c: F.lower(c).rlike("s-total|sub-?total")
    own, after = folded("label"), folded(F.regexp_replace(F.lower(F.lead("label").over(w)), "s-total|sub-?total", ""))
    blanks = None
    for q in ("opening", "receipt", "issue", "closing"):
        one = (F.trim(q) == "") != (F.trim(F.lead(q).over(w)) == "")
        blanks = one if blanks is None else blanks | one
    theirs = ((own != "") & (after != "") & (after.contains(own) | own.contains(after))) | ((after == "") & blanks)
    v = {q: row_number_value(F.col(q)) for q in ("opening", "receipt", "issue", "closing")}
    next_issue = row_number_value(F.lead("issue").over(w))
    off = lambda out: F.round(F.abs(v["opening"] + v["receipt"] - out - v["closing"]), 4) > 0.05
    conflict = ~off(next_issue) & (v["issue"].isNull() | off(v["issue"]))
    suspicious = (v["opening"] == 0) & (v["issue"] == 0) & (v["closing"] > 0) & (F.coalesce(v["receipt"], F.lit(0.0)) == 0)
    flag = F.when(conflict, "CONFLICT").when(suspicious, "SUSPICIOUS").otherwise("OK")
    out = rows.select(key, order, "label", (~sub(F.col("label")) & F.coalesce(sub(F.lead("label").over(w)), F.lit(False)) & theirs).alias("paired"), flag.alias("flag"))
    return out.where("paired").drop("paired")


def without_noise(tokens: DataFrame, bezel: list[str], watermark: list[str]) -> DataFrame:
    """Tokens without watermarks, and, where a bezel word stands in the page's top quarter, without its top fifth and right edge. A page that would be left empty keeps all. Needs width and height."""
    w = Window.partitionBy("doc_id", "page")
    low = F.lower("text")
    framed = F.max((low.isin(*bezel) & (F.col("y0") < 0.25 * F.col("height"))).cast("int")).over(w) == 1
    gone = low.isin(*watermark) | (framed & ((F.col("y0") < 0.2 * F.col("height")) | (F.col("x0") > 0.78 * F.col("width"))))
    rows = tokens.withColumn("_gone", F.coalesce(gone, F.lit(False)))
    rows = rows.withColumn("_left", F.sum((~F.col("_gone")).cast("int")).over(w))
    return rows.where(~F.col("_gone") | (F.col("_left") == 0)).drop("_gone", "_left")


def split_tokens(tokens: DataFrame) -> DataFrame:
    """Tokens of several parts, all of them figures, dashes or packings, as a token each, their extents in proportion."""
    parts = F.split(F.trim("text"), r"\s+")
    apart = (F.size(parts) > 1) & F.forall(parts, lambda p: p.rlike(r"^[-+(]?[0-9,]*\.?[0-9]+\)?%?$|^-+$|(?i)^[0-9]+[x*][0-9]+$|(?i)^[0-9]+(ml|gm|tab|cap|s)$"))
    each = F.when(apart, parts).otherwise(F.array("text"))
    rows = tokens.withColumn("_parts", each).select("*", F.posexplode("_parts").alias("part", "_text"))
    total = F.aggregate("_parts", F.lit(0), lambda t, p: t + F.length(p) + 1) - 1
    before = F.aggregate(F.slice("_parts", F.lit(1), F.col("part")), F.lit(0), lambda t, p: t + F.length(p) + 1)
    scale = (F.col("x1") - F.col("x0")) / F.greatest(total, F.lit(1))
    start = F.col("x0") + before * scale
    return rows.withColumns({"x1": start + F.length("_text") * scale, "x0": start, "text": F.col("_text")}).drop("_parts", "_text")


def resolved(document: Column, path: str) -> Column:
    """The value at a path like a.b[0].c of a JSON text, as text; null where a step is missing or the text is no JSON."""
    return F.try_variant_get(F.try_parse_json(document), "$." + path, "string")


def valid_date(c: Column) -> Column:
    """Whether a text is one of seven date formats, or holds something like a date."""
    formats = ["yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "MM/dd/yyyy", "dd-MMM-yyyy", "dd/MM/yy", "dd-MM-yy"]
    parsed = F.coalesce(*(F.try_to_timestamp(F.trim(c), F.lit(f)) for f in formats)).isNotNull()
    return F.coalesce(parsed | c.rlike(r"[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}"), F.lit(False))


# Words of a period's line, and of titles, which name nobody.
PERIOD_WORDS = ["FROM", "PERIOD", "DATE", "TO ", "MONTH", "FOR THE"]
TITLE_WORDS = ["STATEMENT", "REPORT", "ANALYSIS", "PAGE", "STOCK"]


def header_metadata(text: Column, first: int = 20) -> Column:
    """A struct (distributor, company, period) from a report's first lines.

    The period is the first line with one of its words; of the others that are no titles the first names the
    distributor, the next one the company. A row of a table with one filled cell, and no figure at its end,
    is printed as the company's heading and goes before a line. Headings count without their marks.
    """
    raw = F.split(F.coalesce(text, F.lit("")), "\r\n|\r|\n")
    lines = F.transform(F.slice(raw, 1, first), lambda x: F.trim(F.regexp_replace(F.trim(x), "^#+", "")))
    lines = F.filter(lines, lambda x: (x != "") & ~x.startswith("|") & ~x.startswith("---"))
    timed = lambda x: F.upper(x).rlike("|".join(PERIOD_WORDS))
    names = F.filter(lines, lambda x: ~timed(x) & (F.length(x) > 3) & ~F.upper(x).rlike("|".join(TITLE_WORDS)))
    cells = lambda x: F.filter(F.transform(F.split(F.regexp_replace(F.trim(x), r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c)), lambda c: c != "")
    alone = F.transform(F.filter(raw, lambda x: F.trim(x).startswith("|") & ~F.trim(x).rlike(r"^[|\- ]*$")), cells)
    banner = F.filter(alone, lambda c: (F.size(c) == 1) & (F.length(F.get(c, F.lit(0))) > 3) & ~F.get(c, F.lit(0)).rlike(r"[0-9][0-9,.]*$"))
    company = F.coalesce(F.get(F.get(banner, F.lit(0)), F.lit(0)), F.get(names, F.lit(1)))
    return F.struct(F.get(names, F.lit(0)).alias("distributor"), company.alias("company"), F.get(F.filter(lines, timed), F.lit(0)).alias("period"))


def subtotals_filled(rows: DataFrame, key: str, order: str, quantities: list[str]) -> DataFrame:
    """Opt-in repair: rows (key, order, label, quantities) where a product and its own subtotal under it fill each other's blanks; filled_from says which did.

    They belong together where one label holds the other, or the subtotal has none and one of both has what
    the other lacks. A row is a subtotal by any of its texts.
    """
    w = Window.partitionBy(key).orderBy(order)
    sub = F.lower(F.concat_ws(" ", "label", *quantities)).rlike("s-total|sub-?total")
    name = folded(F.regexp_replace(F.lower(F.coalesce("label", F.lit(""))), "s-total|sub-?total", ""))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    r = rows.withColumns({"_sub": sub, "_name": name})
    lack = None
    for q in quantities:
        one = blank(F.col(q)) != blank(F.lead(q).over(w))
        lack = one if lack is None else lack | one
    after = F.lead("_name").over(w)
    held = (F.col("_name") != "") & (after != "") & (after.contains(F.col("_name")) | F.col("_name").contains(after))
    r = r.withColumn("_pair", F.coalesce(~F.col("_sub") & F.lead("_sub").over(w) & (held | ((after == "") & lack)), F.lit(False)))
    down, up = F.col("_pair"), F.coalesce(F.lag("_pair").over(w), F.lit(False))
    other = {q: F.when(down, F.lead(q).over(w)).when(up, F.lag(q).over(w)) for q in quantities}
    new = {q: F.when(blank(F.col(q)) & ~blank(other[q]), other[q]).otherwise(F.col(q)) for q in quantities}
    changed = None
    for q in quantities:
        one = blank(F.col(q)) & ~blank(other[q]) & (down | up)
        changed = one if changed is None else changed | one
    return r.select(key, order, "label", *(new[q].alias(q) for q in quantities), F.when(changed, F.when(down, "subtotal").otherwise("product")).alias("filled_from"))


def json_export(filename: Column, kind: Column, project: Column, data: Column, markdown: Column) -> Column:
    return F.to_json(F.struct(filename.alias("filename"), kind.alias("document_type"), project.alias("project_name"), data.alias("structured_data"), markdown.alias("markdown")), {"ignoreNullFields": "false"})


def text_export(filename: Column, kind: Column, data: Column, text: Column) -> Column:
    line = "=" * 40
    return F.concat_ws("\n", F.lit(line), F.concat(F.lit("Document: "), filename), F.concat(F.lit("Type: "), kind), F.lit(line), F.to_json(data), F.lit(""), F.coalesce(text, F.lit("")))


def export_name(filename: Column, suffix: str = "_ocr.json") -> Column:
    return F.concat(F.regexp_replace(filename, r"\.[^.]*$", ""), F.lit(suffix))

