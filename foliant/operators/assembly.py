"""Logical rows of a table from its physical lines, and whole tables from positioned tokens.

A printed row may take several lines, a line may belong to the row above, and what follows the table is no row
of it. Each line is read against the rows so far; the first rule that takes it decides. A table is one fold.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators.columns import column_model
from foliant.operators.grouped import Columns, fold_rows
from foliant.operators.layout import PAGE, line_rows, lined, projected, similarity

# Parts of column names by what the column holds, the first family that has one.
NAMES = ("desc", "particular", "item", "product", "name")
UNITS = ("unit", "pack")
FIGURES = ("qty", "free", "rate", "amount", "val", "bal", "open", "clos", "sale", "pur", "rec", "iss", "dump", "total", "in", "out", "cr", "dr", "(%)", "%")
# Texts between and under a table's rows.
SKIPPED = re.compile(r"end of report|page no >|page no:|page\s+\d+\s+of\s+\d+")
FOOTER = re.compile(
    r"(?:e-?mail|mobile|phone|help\s*line|tel)\s*[:.]|[\w.+-]+@[\w-]+\.[\w.]+|www\.|\.com\b|\b(?:f\d{1,2}|esc|alt|ctrl)\s*[-:=]\s*\w"
    r"|\b(?:enter-edit|tab-line|jline|authorised user|authonsed user)\b|\d{10,}|\bprint(?:ed)?\s*(?:by|on)\b|help find|heup find|authorised marg|helpline:|masterpartner|marg ?erp|\|.*\|"
)
FINDER = re.compile(r"find.*(?:help|heup|[?？]|f1|f2)|(?:help|heup|[?？]|f1|f2).*find")
BANNERS = ("division", "statement", "analysis", "stock & sales")
PART_TOTALS, WHOLE_TOTALS = ("s-total", "sub-total", "subtotal"), ("grand total", "net total", "total:")
DETAIL = re.compile(r"\b(batch|exp|expiry|mrp|within\s+six|quantity)\b")
DETAIL_WORD = re.compile(r"\b(batch|exp|expiry)\b")
PACK_SUFFIX = re.compile(r"\s*\d+\s*(?:s|tab|cap|ml|gm)s?\s*$")
PRODUCT, SUBTOTAL, TOTAL, PARTY, FOOT = "PRODUCT", "SUBTOTAL", "TOTAL", "PARTY_OR_HEADER", "FOOTER"


def _has(text: str, words: tuple[str, ...]) -> bool:
    return any(w in text for w in words)


@dataclass(slots=True)
class Line:
    cells: list[str]
    text: str
    y0: float
    y1: float
    kind: str = PRODUCT
    walled: bool = False

    @property
    def low(self) -> str:
        return self.text.lower()


class Table:
    """The rows so far of one table; read() takes its lines in order."""

    def __init__(self, names: list[str], rulings: list[float]):
        self.rows: list[Line] = []
        self.foot: list[str] = []
        self.rulings, self.closed, self.skip = rulings, False, False
        self.name, self.unit, self.figures = 0, None, []
        for k, n in enumerate(x.lower() for x in names):
            if _has(n, NAMES):
                self.name = k
            elif _has(n, UNITS):
                self.unit = k
            elif _has(n, FIGURES):
                self.figures.append(k)

    def filled(self, row: Line) -> list[int]:
        return [k for k in self.figures if row.cells[k]]

    def totals(self, row: Line) -> bool:
        """Whether a row speaks of a total anywhere."""
        return _has(" ".join(row.cells).lower(), ("s-total", "subtotal", "total"))

    def read(self, line: Line, ahead: str | None) -> None:
        if self.skip:
            self.skip = False
            return
        if SKIPPED.search(line.low):
            return
        if self.closed or FOOTER.search(line.low) or FINDER.search(line.low):
            self.closed = True
            self.foot.append(line.text)
            return
        if not any(line.cells):
            return
        last = self.rows[-1] if self.rows else None
        line.walled = last is not None and any(last.y1 + 1 < y < line.y0 - 1 for y in self.rulings)
        if _has(line.low, PART_TOTALS) and not _has(line.low, WHOLE_TOTALS):
            # Under a row without figures a line of figures completes it, whatever it calls itself.
            line.kind = SUBTOTAL if last is None or self.filled(last) else PRODUCT
        elif "total" in line.low:
            line.kind = TOTAL
        for rule in (self._banner, self._labelled, self._tilted, self._label_below, self._unnamed, self._carried, self._same):
            if rule(line, last, ahead):
                return
        self.rows.append(line)

    def _numbered(self, line: Line) -> bool:
        return bool(re.match(r"\*?\d{1,3}\b", line.text.strip()))

    def _banner(self, line: Line, last: Line | None, ahead: str | None) -> bool:
        """A title between the header and the first row."""
        if last is None and not self.filled(line) and not self._numbered(line) and _has(line.low, BANNERS):
            line.cells[self.name], line.kind = line.text.strip(), PARTY
            self.rows.append(line)
            return True
        return False

    def _labelled(self, line: Line, last: Line | None, ahead: str | None) -> bool:
        """A total's label moves to the name column; a subtotal is called as the row it sums up."""
        if line.kind == TOTAL:
            at = next((k for k, c in enumerate(line.cells) if "total" in c.lower()), None)
            label = line.cells[at] if at is not None else "Grand Total:" if "grand total:" in line.low else "Grand Total" if "grand total" in line.low else "TOTAL"
            if at is not None:
                line.cells[at] = ""
            line.cells[self.name] = label
        elif line.kind == SUBTOTAL and last is not None and last.cells[self.name]:
            if line.cells[self.name].lower() != last.cells[self.name].lower():
                line.cells[self.name] = last.cells[self.name]
        return False

    def _tilted(self, line: Line, last: Line | None, ahead: str | None) -> bool:
        """On a tilted page a subtotal's figures right of its opening may stand on the next product's line; they go back."""
        if last is None or not self.totals(last) or len(self.figures) < 2:
            return False
        opening, others = self.figures[0], self.figures[1:]
        own = line.cells[self.name]
        if own and not line.cells[opening] and any(line.cells[k] for k in others) and not _has(own.lower() + " " + line.low, ("s-total", "subtotal", "total")):
            for k in others:
                if line.cells[k]:
                    last.cells[k], line.cells[k] = line.cells[k], ""
            last.cells[opening] = last.cells[opening] or "0.000"
        return False

    def _label_below(self, line: Line, last: Line | None, ahead: str | None) -> bool:
        """Figures alone above a line that is nothing but a total's label are that total's."""
        label = (ahead or "").strip()
        if not line.cells[self.name] and self.filled(line) and len(label) <= 16 and "total" in label.lower() and not re.search(r"\d", label):
            line.cells[self.name], line.kind, self.skip = label, TOTAL, True
            self.rows.append(line)
            return True
        return False

    def _fill(self, row: Line, line: Line) -> None:
        row.cells = [a or b for a, b in zip(row.cells, line.cells, strict=True)]

    def _unnamed(self, line: Line, last: Line | None, ahead: str | None) -> bool:
        """Figures without a name end a total, fill the row above, or are its subtotal; else they are a shadow."""
        if last is None or line.cells[self.name] or not self.filled(line) or line.kind == SUBTOTAL:
            return False
        if "total" in last.cells[self.name].lower():
            self._fill(last, line)
            self.closed = True
        elif any(not last.cells[k] for k in self.filled(line)):
            self._fill(last, line)
        elif not self.totals(last) and self.filled(last):
            line.cells[self.name], line.kind = last.cells[self.name], SUBTOTAL
            if self.unit is not None:
                line.cells[self.unit] = line.cells[self.unit] or "S-Total"
            return False
        return True

    def _carried(self, line: Line, last: Line | None, ahead: str | None) -> bool:
        """Details, packings and short ends of a name belong to the row above, but not over a ruling."""
        if last is None or line.kind != PRODUCT or line.walled or self._numbered(line):
            return False
        short = not self.filled(line) and (len(line.text.strip()) < 8 or PACK_SUFFIX.match(line.low) or DETAIL_WORD.search(line.low))
        if not (short or DETAIL.search(line.low)):
            return False
        last.cells[self.name] = f"{last.cells[self.name]} {line.cells[self.name]}".strip()
        last.y1 = line.y1
        return True

    def _same(self, line: Line, last: Line | None, ahead: str | None) -> bool:
        """Two lines of one product are one row, where one has no figures, or neither is numbered anew."""
        if last is None or line.kind == SUBTOTAL or line.walled or self.totals(last):
            return False
        fold = lambda t: re.sub("[^a-z0-9]", "", t.lower())
        if similarity(fold(last.cells[self.name]), fold(line.cells[self.name])) < 0.85:
            return False
        before, now = bool(self.filled(last)), bool(self.filled(line))
        if before and (not now or self._numbered(line)):
            return False
        if now and not before:
            line.cells = [b or a for a, b in zip(last.cells, line.cells, strict=True)]
            if self.unit is not None and line.cells[self.unit].lower() == "s-total":
                line.cells[self.unit] = ""
            last.cells, last.text = line.cells, line.text
        else:
            self._fill(last, line)
        last.y1 = line.y1
        return True


def assembled(lines: DataFrame, key: list[str]) -> DataFrame:
    """(key, row_idx, row_type, cells) of a table's physical lines (key, line_idx, cells, names).

    names are the columns' names, as an array on every line. text (else the cells joined), y0 and y1, and
    rulings, an array of the heights of horizontal rulings, may stand beside them: no row goes over a ruling.
    row_type is PRODUCT, SUBTOTAL, TOTAL, PARTY_OR_HEADER, or FOOTER for the lines under the table, whose
    text is their first cell.
    """
    have = set(lines.columns)
    text = F.col("text") if "text" in have else F.array_join(F.filter("cells", lambda c: F.trim(c) != ""), " ")
    y = [F.col(c).cast("double").alias(c) if {"y0", "y1"} <= have else F.lit(0.0).alias(c) for c in ("y0", "y1")]
    rulings = F.col("rulings").cast("array<double>") if "rulings" in have else F.array().cast("array<double>")
    rows = lines.select(*key, "line_idx", "cells", "names", text.alias("text"), *y, rulings.alias("rulings"))

    def fold(c: Columns, low: int, high: int) -> list[tuple]:
        width = len(c["names"][low])
        marks = c["rulings"][low]
        table = Table(list(c["names"][low]), [] if marks is None else [float(m) for m in marks])
        for k in range(low, high):
            cells = [(x or "").strip() for x in c["cells"][k]][:width]
            line = Line(cells + [""] * (width - len(cells)), c["text"][k] or "", float(c["y0"][k]), float(c["y1"][k]))
            table.read(line, c["text"][k + 1] if k + 1 < high else None)
        out = [(r.kind, r.cells) for r in table.rows] + [(FOOT, [t] + [""] * (width - 1)) for t in table.foot]
        return [(*(c[k][low] for k in key), np.int32(i), kind, cells) for i, (kind, cells) in enumerate(out)]

    types = {f.name: f.dataType.simpleString() for f in lines.schema}
    return fold_rows(rows, key, ["line_idx"], fold, f"{', '.join(f'{k} {types[k]}' for k in key)}, row_idx int, row_type string, cells array<string>")


def table_grid(tokens: DataFrame, rulings: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, row_idx, row_type, cells, names, uncertain) of pages' positioned tokens, whose columns nobody knows yet.

    Tokens become lines, lines a column model, the lines under the header cells, and those logical rows.
    rulings: (doc_id, page, x0, x1, y0, y1); flat ones part rows, upright ones columns. Pages without a table
    have no rows.
    """
    upright = flat = None
    if rulings is not None:
        tall = (F.col("y1") - F.col("y0")) > (F.col("x1") - F.col("x0"))
        upright = rulings.where(tall)
        flat = rulings.where(~tall).groupBy(*PAGE).agg(F.collect_list((F.col("y0") + F.col("y1")) / 2).alias("rulings"))
    lines = lined(tokens)
    columns = column_model(lines, upright)
    table = columns.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("col_idx", "name"))).alias("c"), F.max("header_end").alias("header_end"), F.max("uncertain").alias("uncertain"))
    table = table.select(*PAGE, "header_end", "uncertain", F.transform("c", lambda c: c["name"]).alias("names"))
    under = lines.join(table, PAGE).where(F.col("line_idx") > F.col("header_end"))
    extent = line_rows(under).select(*PAGE, "line_idx", "text", "y0", "y1")
    rows = projected(under, columns).join(extent, [*PAGE, "line_idx"], "right").join(table.select(*PAGE, "names"), PAGE)
    rows = rows.withColumn("cells", F.coalesce("cells", F.array_repeat(F.lit(""), F.size("names"))))
    if flat is not None:
        rows = rows.join(flat, PAGE, "left")
    return assembled(rows, PAGE).join(table.select(*PAGE, "names", "uncertain"), PAGE)
