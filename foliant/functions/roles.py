"""Roles of columns by their names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _any(c: Column, *words: str) -> Column:
    out = c.contains(words[0])
    for w in words[1:]:
        out = out | c.contains(w)
    return out


def stock_rule(name: Column) -> Column:
    """A stock table's role for one column name, else null; the first rule that holds."""
    n = F.upper(F.trim(name))
    money = _any(n, "VAL", "AMOUNT", "AMT")
    return (
        F.when(n.contains("OP") & ~money, "opening").when((_any(n, "REC", "PUR") | (n == "IN")) & ~money, "receipt")
        .when((_any(n, "ISS", "SALE", "DISPATCH", "SOLD") | (n == "OUT")) & ~money, "issue").when(n.contains("TOT") & ~money, "total")
        .when(_any(n, "CL", "BAL") & ~money, "closing").when(money & n.contains("OP"), "opening_value").when(money & _any(n, "CL", "BAL"), "closing_value")
        .when(_any(n, "PRODUCT", "PARTICULARS", "DESCRIPTION") | (n == "ITEM"), "product").when(_any(n, "CODE", "SLNO", "SL NO", "S.NO"), "code")
        .when(_any(n, "PACK", "UNIT"), "pack").when(n.contains("BATCH"), "batch").when(n.contains("EXP"), "expiry").when(_any(n, "RATE", "PRICE", "MRP"), "rate")
    )


ROLES = ("opening", "receipt", "issue", "total", "closing", "opening_value", "closing_value", "product", "code", "pack", "batch", "expiry", "rate")


def stock_roles(headers: Column, rules: Column | None = None) -> Column:
    """A struct with each role's column, from 0: the last column of a role wins. The product falls back to the first column, or the second where the first is the code. rules: stock_rule of each header, where a column holds them already."""
    rules = F.transform(headers, stock_rule) if rules is None else rules
    last = lambda role: F.array_max(F.transform(rules, lambda r, i: F.when(r == role, i)))
    fields = [last(r).alias(r) for r in ROLES if r != "product"]
    fallback = F.when(F.size(headers) == 0, F.lit(None)).when((last("code") == 0) & (F.size(headers) > 1), 1).otherwise(0)
    return F.struct(*fields, F.coalesce(last("product"), fallback).alias("product"))


INVOICE = [
    ("description", ("DESCRIPTION", "PARTICULARS", "ITEM", "PRODUCT")),
    ("quantity", ("QTY", "QUANTITY")),
    ("unit_price", ("RATE", "PRICE", "MRP")),
    ("amount", ("AMOUNT", "TOTAL", "VALUE", "AMT")),
]


def invoice_roles(headers: Column) -> Column:
    """A map of role to column, from 0. Each column takes the first role it can that no column before it has."""
    start = F.create_map().cast("map<string,int>")
    rule: Callable[[Column, Column], Column]

    def rule(have, each):
        name, out = F.upper(F.trim(each["name"])), None
        for role, words in INVOICE:
            test = _any(name, *words) & ~F.map_contains_key(have, F.lit(role))
            value = F.map_concat(have, F.create_map(F.lit(role), each["i"]))
            out = F.when(test, value) if out is None else out.when(test, value)
        return out.otherwise(have)

    named = F.transform(headers, lambda h, i: F.struct(h.alias("name"), i.alias("i")))
    return F.aggregate(named, start, rule)


# Names that show a billing table.
BILLING = ["OPENQ", "INQTY", "TOT.QTY", "OUTQTY", "CLS.QTY", "O.BAL", "RCPTS", "PUR.RET", "CL.VALUE"]


def fitted(row: Column, width: Column) -> Column:
    """A row padded with blanks or cut to the width."""
    return F.slice(F.concat(row, F.array_repeat(F.lit(""), width)), F.lit(1), width)


def billing_aligned(headers: Column, rows: Column) -> Column:
    """A struct (rows, mismatches): rows of billing tables trimmed and fitted, and which had another width. Other tables stay."""
    billing = _any(F.upper(F.array_join(headers, " ")), *BILLING) & (F.size(headers) > 0)
    done = F.transform(rows, lambda r: fitted(F.transform(r, lambda c: F.coalesce(F.trim(c), F.lit(""))), F.size(headers)))
    wrong = F.filter(F.transform(rows, lambda r, i: F.when(F.size(r) != F.size(headers), i)), lambda i: i.isNotNull())
    return F.struct(F.when(billing, done).otherwise(rows).alias("rows"), F.when(billing, wrong).otherwise(F.array().cast("array<int>")).alias("mismatches"))


def unique_headers(headers: Column) -> Column:
    """Names made distinct: repeats get _2, _3 and so on, blank ones column_N; a name so made that is taken counts on."""
    start = F.array().cast("array<string>")

    def add(have, each):
        own = F.coalesce(F.nullif(F.trim(each["name"]), F.lit("")), F.concat(F.lit("column_"), (each["i"] + 1).cast("string")))
        n = F.size(F.filter(headers, lambda h: F.trim(h) == own)) + F.size(have) + 2
        free = F.filter(F.transform(F.sequence(F.lit(2), n), lambda k: F.concat(own, F.lit("_"), k.cast("string"))), lambda c: ~F.array_contains(have, c))
        return F.concat(have, F.array(F.when(F.array_contains(have, own), F.element_at(free, 1)).otherwise(own)))

    return F.aggregate(F.transform(headers, lambda h, i: F.struct(h.alias("name"), i.alias("i"))), start, add)


# Stock roles under other rules: per role its words or patterns, in the order in which a column tries them.
#: What heals an empty closing: closing is the first column of its words that is no amount; of others the last column counts.
FILL = {"opening": ("OPEN",), "receipt": ("RECEIPT", "PUR", "INQTY", "RCPT", "RECEV"), "issue": ("ISSUE", "SALE", "OUTQTY", "S A L E"), "closing": ("CLOSING QTY", "CL.STK", "BAL", "C.STK", "CLOSING")}
#: What heals a row that another bled into: no balance counts as closing, and an amount is one after the issue and before the closing.
BLEED = FILL | {"closing": ("CLOSING QTY", "CL.STK", "C.STK", "CLOSING")}
#: What rows must balance: the first column of each role; names of money and rates are none.
MOVEMENT = {"opening": ("opening", "op.bal", "opbal", "op bal", "o.bal"), "inflow": ("receipt", "purchase", "inward", "in"), "outflow": ("issue", "sale", "dispatch", "outward", "out"), "closing": ("closing", "balance", "bal", "clos")}
MONEY = ("amount", "amt", "value", "val", "rate")
#: What audits balance, as patterns.
AUDIT = {"opening": (r"^op\b", "opening", r"op\.?bal", r"o\.?bal"), "inflow": ("receipt", r"^in\b", "purchase", "inward"), "outflow": ("issue", r"^out\b", "sale", "outward", "dispatch"), "closing": ("closing", "^bal", "balance", "clos")}


def _firsts(headers: Column, rules: dict[str, Column]) -> Column:
    """A map of role to column where each column takes the first role it can that no column before it has."""

    def step(have, each):
        out = have
        for role in reversed(rules):
            free = F.get(each["hits"], F.lit(list(rules).index(role))) & ~F.map_contains_key(have, F.lit(role))
            out = F.when(free, F.map_concat(have, F.create_map(F.lit(role), each["i"]))).otherwise(out)
        return out

    hits = F.transform(headers, lambda h, i: F.struct(F.array(*(test(h) for test in rules.values())).alias("hits"), i.alias("i")))
    return F.aggregate(hits, F.create_map().cast("map<string,int>"), step)


def movement_roles(headers: Column, rules: str = "movement") -> Column:
    """A map of opening, inflow, outflow and closing to columns, under the rules of "movement" or of "audit"."""
    low = lambda h: F.lower(F.trim(F.coalesce(h, F.lit(""))))
    if rules == "audit":
        return _firsts(headers, {r: (lambda h, w=words: low(h).rlike("|".join(w))) for r, words in AUDIT.items()})
    return _firsts(headers, {r: (lambda h, w=words: (low(h) != "") & ~_any(low(h), *MONEY) & _any(low(h), *w)) for r, words in MOVEMENT.items()})


def heal_roles(headers: Column, rules: str = "fill") -> Column:
    """A map of opening, receipt, issue, closing (and amount, for "bleed") to columns, under the rules of "fill" or of "bleed"."""
    table = FILL if rules == "fill" else BLEED

    def step(have, each):
        n, i, put = each["name"], each["i"], lambda role: F.map_concat(F.map_filter(have, lambda k, _: k != role), F.create_map(F.lit(role), each["i"]))
        no_closing = ~F.map_contains_key(have, F.lit("closing"))
        closing = F.when(_any(n, *table["closing"]) & ~_any(n, "AMOUNT", "VAL") & no_closing, put("closing")).otherwise(have)
        amount = n.contains("AMOUNT") & no_closing & (i > F.coalesce(F.element_at(have, F.lit("issue")), F.lit(-1)))
        closing = F.when(amount, put("amount")).otherwise(closing) if rules == "bleed" else closing
        out = F.when(_any(n, *table["opening"]), put("opening")).when(_any(n, *table["receipt"]), put("receipt"))
        return out.when(_any(n, *table["issue"]), put("issue")).otherwise(closing)

    named = F.transform(headers, lambda h, i: F.struct(F.upper(F.coalesce(h, F.lit(""))).alias("name"), i.alias("i")))
    return F.aggregate(named, F.create_map().cast("map<string,int>"), step)


def covers(roles: Column, needed: list[str]) -> Column:
    """Whether a map of roles has all that are needed."""
    return F.size(F.array_except(F.array(*(F.lit(r) for r in needed)), F.map_keys(roles))) == 0
