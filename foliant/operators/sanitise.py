"""Cleaning tables that a model wrote: banners that stand in rows, packings in the wrong column, empty columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How a company's name ends, and what packings look like.
COMPANY = r"[A-Za-z\s]{4,}\s+(?:HEALTH\s+CARE\s+LTD|PVT\.?\s*LTD|LTD|LIMITED|PHARMA|HEALTHCARE|DIVISION|ENTERPRISES)"
PACK = r"(?i)^[0-9]+\s*('S|S|GM|GMS|ML|KG|CAP|TAB|NOS?|LTR)$"


def _cell(row: Column, k: int | Column) -> Column:
    return F.coalesce(F.trim(F.get(row, F.lit(k) if isinstance(k, int) else k)), F.lit(""))


def banner_apart(rows: Column) -> Column:
    """A struct (banner, rows): a section's name taken out of a table's rows, else null and the rows as they are.

    It may be the first row, with nothing beside it or the next row's figures; the first column of seven rows
    in ten; a company's name before the first item, in its cell or in one of its own. The first that holds.
    """
    n, a, b = F.size(rows), F.get(rows, F.lit(0)), F.get(rows, F.lit(1))
    rest = F.slice(rows, 2, F.greatest(n, F.lit(1)))
    tail = lambda r: F.slice(r, 2, F.greatest(F.size(r), F.lit(1)))
    two = (n >= 2) & (F.size(a) > 1) & (F.size(b) > 1)
    own_row = two & (F.forall(tail(a), lambda c: F.trim(c).isin("", "-")) | (tail(a) == tail(b)))
    first = _cell(a, 0)
    same = F.size(F.filter(rows, lambda r: _cell(r, 0) == first))
    column = (n >= 3) & (same >= 0.7 * n) & (F.length(first) > 3) & ~first.rlike("^[0-9]+$")
    dropped = F.transform(rows, lambda r: F.when((F.size(r) > 1) & (_cell(r, 0) == first), tail(r)).otherwise(r))
    at = F.when((F.size(a) > 1) & first.rlike("^[0-9]+$"), 1).otherwise(0)
    pattern = rf"(?i)^({COMPANY})\s+(.+)$"
    name, item = F.trim(F.regexp_extract(_cell(a, at), pattern, 1)), F.regexp_extract(_cell(a, at), pattern, 2)
    before = (n >= 2) & (name != "") & ~F.upper(_cell(b, at)).startswith(F.upper(name))
    renamed = F.concat(F.array(F.transform(a, lambda c, i: F.when(i == at, F.trim(item)).otherwise(c))), rest)
    own_cell = two & (F.size(a) >= 3) & (F.size(b) >= 3) & _cell(a, 1).rlike(rf"(?i)^{COMPANY}$") & _cell(a, 2).rlike("[A-Za-z]{3,}") & _cell(b, 2).rlike(r"^[0-9\s.,\-]*$")
    without = F.concat(F.array(F.concat(F.slice(a, 1, 1), F.slice(a, 3, F.greatest(F.size(a), F.lit(1))))), rest)
    made = lambda banner, left: F.struct(banner.alias("banner"), left.alias("rows"))
    return F.when(own_row, made(first, rest)).when(column, made(first, dropped)).when(before, made(name, renamed)).when(own_cell, made(_cell(a, 1), without)).otherwise(made(F.lit(None).cast("string"), rows))


def packing_misplaced(headers: Column, rows: Column, first: int = 10) -> Column:
    """Whether the opening column holds packings in two of the first rows' five, in a table without a packing column."""
    at = F.array_position(F.transform(headers, lambda h: F.upper(h).contains("OPENING")), True) - 1
    some = F.filter(F.slice(rows, 1, first), lambda r: _cell(r, at.cast("int")) != "")
    hits = F.size(F.filter(some, lambda r: _cell(r, at.cast("int")).rlike(PACK)))
    return (at >= 0) & ~F.exists(headers, lambda h: F.upper(h).contains("PACK")) & (F.size(some) > 0) & (hits >= 0.4 * F.size(some))


def expiry_apart(cell: Column) -> Column:
    """A struct (quantity, expiry): a cell like 12/6/27 is a quantity and a month; others have no expiry."""
    q, e = F.regexp_extract(cell, r"^\s*([0-9]+)/([0-9]{1,2}/[0-9]{2})\s*$", 1), F.regexp_extract(cell, r"^\s*([0-9]+)/([0-9]{1,2}/[0-9]{2})\s*$", 2)
    return F.struct(F.when(e != "", q).otherwise(cell).alias("quantity"), F.nullif(e, F.lit("")).alias("expiry"))


# What shows a note about batches among a table's cells.
BATCH_NOTE = r"(?i)(batch\s*(?:no\.?|number)|expiry\s*with\s*in|mfg\s*date|exp\s*date)"


def without_sublines(headers: Column, rows: Column) -> Column:
    """A struct (rows, notes): rows that are only notes about the item above go, and notes within cells give way to the quantity they state.

    A row with a note is such a subline if the table numbers its rows and this one has no number, or if it
    names the item above again. notes holds their texts in order.
    """
    numbered = F.exists(F.slice(headers, 1, 2), lambda h: F.upper(h).rlike("SL|S\\.NO|SR"))
    number = lambda r: _cell(r, 0).rlike("^[0-9]+$")
    noted = lambda c: c.rlike(BATCH_NOTE)
    stated = lambda c: F.regexp_extract(c, r"(?i)quantity:?\s*([0-9]+)", 1)
    cleaned = lambda c: F.when(~noted(c), c).when(stated(c) != "", stated(c)).when(c.rlike("(?i)expiry|month"), "0").otherwise("")

    def step(have, raw):
        r = F.transform(raw, lambda c: F.coalesce(F.trim(c), F.lit("")))
        again = (have["item"] != "") & (F.upper(_cell(r, 0)).contains(F.upper(have["item"])) | F.upper(_cell(r, 1)).contains(F.upper(have["item"]))) & ~(numbered & number(r))
        subline = F.exists(r, noted) & ((numbered & ~number(r)) | again)
        texts = F.filter(r, lambda c: noted(c) | (subline & (F.length(c) > 10) & ~c.rlike(r"^[0-9\s.,\-]+$")))
        own = F.transform(r, cleaned)
        name = F.when(numbered & number(r), _cell(own, 1)).otherwise(_cell(own, 0))
        item = F.when(~subline & (F.size(r) > 1) & (F.length(name) > 2) & ~name.rlike("^[0-9]+$"), name).otherwise(have["item"])
        kept = F.when(subline, have["rows"]).otherwise(F.concat(have["rows"], F.array(own)))
        return F.struct(item.alias("item"), kept.alias("rows"), F.concat(have["notes"], texts).alias("notes"))

    start = F.struct(F.lit("").alias("item"), F.array().cast("array<array<string>>").alias("rows"), F.array().cast("array<string>").alias("notes"))
    return F.aggregate(rows, start, step, lambda a: F.struct(a["rows"].alias("rows"), a["notes"].alias("notes")))


def value_recovered(headers: Column, rows: Column, first: int = 10) -> Column:
    """A struct (headers, rows): a stock table whose rows end in a quantity and an amount, under a header without a value, gets that column.

    Of rows of twelve cells or more that end so and are too short, the blanks go, and zeros stand in for what
    is missing before the amount, where it is the ninth cell or later. Other rows stay.
    """
    amount, whole = r"^[0-9]+\.[0-9]{2}$", "^[0-9]+$"
    full = lambda r: F.filter(F.transform(r, lambda c: F.coalesce(F.trim(c), F.lit(""))), lambda c: c != "")
    ends = lambda f: F.element_at(f, -1).rlike(amount) & F.element_at(f, -2).rlike(whole)
    least = lambda r, n: F.coalesce(F.when(F.size(full(r)) >= n, ends(full(r))), F.lit(False))
    stock = F.exists(headers, lambda h: F.upper(h).rlike("BAL|CLOSING")) & ~F.upper(F.element_at(headers, -1)).contains("VAL")
    short = (F.size(headers) > 0) & stock & F.exists(F.slice(rows, 1, first), lambda r: least(r, 8))
    width = F.size(headers) + 1

    def fixed(r):
        f = full(r)
        at = F.array_position(F.transform(f, lambda c: c.rlike(amount)), True) - 1
        wants = least(r, 12) & (at >= 8) & (F.size(f) < width)
        own = F.concat(F.slice(f, F.lit(1), at.cast("int")), F.array_repeat(F.lit("0"), width - F.size(f)), F.slice(f, (at + 1).cast("int"), F.size(f)))
        return F.when(wants, own).otherwise(r)

    with_value = F.struct(F.concat(headers, F.array(F.lit("Bal.Val"))).alias("headers"), F.transform(rows, fixed).alias("rows"))
    return F.when(short, with_value).otherwise(F.struct(headers.alias("headers"), rows.alias("rows")))


def without_empty_tail(headers: Column, rows: Column) -> Column:
    """A struct (headers, rows) without the last columns that hold nothing in any row; a table without rows stays."""
    filled = F.transform(F.sequence(F.lit(1), F.greatest(F.size(headers), F.lit(1))), lambda k: F.when(F.exists(rows, lambda r: ~F.coalesce(F.trim(F.get(r, k - 1)), F.lit("")).isin("", "-", "--", "None", "null")), k))
    width = F.when(F.size(rows) == 0, F.size(headers)).otherwise(F.coalesce(F.array_max(filled), F.lit(0)))
    return F.struct(F.slice(headers, F.lit(1), width).alias("headers"), F.transform(rows, lambda r: F.slice(r, F.lit(1), width)).alias("rows"))


def without_batch_sections(lines: Column) -> Column:
    """Lines of markdown without sections under a heading on batches: all up to the next heading or table."""
    start = F.struct(F.lit(False).alias("skip"), F.array().cast("array<string>").alias("kept"))

    def step(have, line):
        t = F.trim(line)
        heading = t.rlike("(?i)^#{1,4}\\s*batch")
        skip = heading | (have["skip"] & ~t.rlike(r"^[#|]"))
        return F.struct(skip.alias("skip"), F.when(skip, have["kept"]).otherwise(F.concat(have["kept"], F.array(line))).alias("kept"))

    return F.aggregate(lines, start, step, lambda a: a["kept"])
