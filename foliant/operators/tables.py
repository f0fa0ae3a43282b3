"""Text to tables: markdown pipes, spaces, HTML; headers, delimiters, repeated lines."""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from foliant.functions.text import lines
from foliant.operators.sanitise import without_empty_tail

RULE = r"^\|[\s\-:|]+\|$"


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("key"), F.posexplode(lines(F.col(text))).alias("pos", "raw")).withColumn("line", F.trim("raw"))


def pipe_tables(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, table_idx, row_idx, cells): runs of lines between pipes; rules go, row 0 is the header.

    A header of which 60 % is Col n gives way to the next row where two of its cells hold letters.
    """
    rows = _lines(docs, key, text).where(F.col("line").rlike(r"^\|.*\|$"))
    by = Window.partitionBy("key").orderBy("pos")
    rows = rows.withColumn("island", F.col("pos") - F.row_number().over(by)).where(~F.col("line").rlike(RULE))
    rows = rows.withColumn("table_idx", F.dense_rank().over(Window.partitionBy("key").orderBy("island")) - 1)
    inner = F.expr("substring(line, 2, length(line) - 2)")
    own = Window.partitionBy("key", "table_idx").orderBy("pos")
    rows = rows.withColumn("cells", F.transform(F.split(inner, r"\|"), lambda c: F.trim(c))).withColumn("r", F.row_number().over(own) - 1)
    dummy = (F.col("r") == 0) & (F.size(F.filter("cells", lambda c: c.rlike(r"(?i)^col\s*[0-9]+$"))) >= 0.6 * F.size("cells"))
    textual = F.size(F.filter(F.lead("cells").over(own), lambda c: c.rlike("[A-Za-z]"))) >= 2
    rows = rows.withColumn("gone", F.max(F.when(dummy & textual, 1).otherwise(0)).over(Window.partitionBy("key", "table_idx")))
    return rows.where((F.col("gone") == 0) | (F.col("r") > 0)).select(F.col("key").alias(key), F.col("table_idx").cast("int").alias("table_idx"), (F.col("r") - F.col("gone")).cast("int").alias("row_idx"), "cells")


def spaced_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, cells): lines of two parts or more between runs of two spaces or more."""
    rows = _lines(docs, key, text).withColumn("cells", F.split("line", r"\s{2,}")).where(F.size("cells") >= 2)
    return rows.select(F.col("key").alias(key), "pos", "cells")


# Words of a billing table's header; how the lines under it start.
BILLED, UNDER = r"Sales|InQty|Total|Cl\.Value", r"^(Opening Value|Total Value|\*\*|---|###)"


def billing_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, table_idx, row_idx, cells) of space-aligned billing tables, for texts without a pipe table.

    A table starts at a line with Product and a word of its header, and ends before a blank line or one that
    starts like the sums under it. Cells are parted by two spaces or tabs; a header of fewer than four or a
    row of fewer than three by single ones. A header alone is no table.
    """
    rows = _lines(docs, key, text)
    by = Window.partitionBy("key").orderBy("pos")
    piped = F.max(F.col("line").rlike(r"^\|.*\|$").cast("int")).over(Window.partitionBy("key")) == 1
    rows = rows.withColumns({"_piped": piped, "_head": F.col("line").contains("Product") & F.col("line").rlike(BILLED), "_stop": (F.col("line") == "") | F.col("line").rlike(UNDER)}).where(~F.col("_piped"))
    stretch = F.sum(F.col("_stop").cast("int")).over(by)
    rows = rows.withColumn("_stretch", stretch).where(~F.col("_stop"))
    own = Window.partitionBy("key", "_stretch").orderBy("pos")
    rows = rows.withColumn("_in", F.max(F.col("_head").cast("int")).over(own)).where("_in = 1").withColumn("r", F.row_number().over(own) - 1)
    wide = F.split("line", r"\s{2,}|\t")
    cells = F.when(F.size(wide) >= F.when(F.col("r") == 0, 4).otherwise(3), wide).otherwise(F.split("line", r"\s+"))
    rows = rows.withColumns({"cells": cells, "_n": F.count("*").over(Window.partitionBy("key", "_stretch"))}).where("_n > 1")
    at = F.dense_rank().over(Window.partitionBy("key").orderBy("_stretch")) - 1
    return rows.select(F.col("key").alias(key), at.cast("int").alias("table_idx"), F.col("r").cast("int").alias("row_idx"), "cells")


_CELL = re.compile(r"<t[dh]\b[^>]*>(.*?)(?=<t[dh]\b|</t[dhr]|<tr\b|</table|$)", re.S | re.I)


def html_rows(html: str | None) -> list[list[list[str]]]:
    """Tables of rows of cell texts; unclosed cells and rows end where the next starts."""
    found = []
    for table in re.findall(r"<table\b[^>]*>(.*?)(?:</table>|$)", html or "", re.S | re.I):
        rows = [[" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", c)).split()) for c in _CELL.findall(r)] for r in re.split(r"<tr\b[^>]*>", table, flags=re.I)[1:]]
        found.append([r for r in rows if r])
    return found


@F.pandas_udf(StringType())
def html_tables_as_markdown(html: pd.Series) -> pd.Series:
    """HTML tables in a text as markdown, rows padded with Col n in the header and blanks below."""

    def one(text: str | None) -> str | None:
        if not text:
            return text
        it = iter(html_rows(text))

        def made(_) -> str:
            rows = next(it)
            if not rows:
                return ""
            width = max(map(len, rows))
            head = rows[0] + [f"Col {k + 1}" for k in range(len(rows[0]), width)]
            body = [r + [""] * (width - len(r)) for r in rows[1:]]
            return "\n".join("| " + " | ".join(r) + " |" for r in [head, ["---"] * width, *body])

        return re.sub(r"<table\b[^>]*>.*?(?:</table>|$)", made, text, flags=re.S | re.I)

    return html.map(one)


@F.pandas_udf(StringType())
def recovered_json(answer: pd.Series) -> pd.Series:
    """The JSON object in a model's answer: as it is, without a fence, from the first brace to the last, with its ends closed, or up to its last whole object; else {"raw_response": text}."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        bare = re.sub(r"^\s*```[A-Za-z]*\s*|\s*```\s*$", "", text)
        start = bare.find("{")
        cut = bare[start : bare.rfind("}") + 1] if start >= 0 else ""
        tries = [bare, cut]
        if start >= 0:
            tail, stack, quoted, escaped = bare[start:], [], False, False
            for c in tail:
                if escaped:
                    escaped = False
                elif c == "\\":
                    escaped = True
                elif c == '"':
                    quoted = not quoted
                elif not quoted and c in "{[":
                    stack.append("}" if c == "{" else "]")
                elif not quoted and c in "}]" and stack:
                    stack.pop()
            ends = "".join(reversed(stack))
            last = tail[: tail.rfind("}") + 1]
            tries += [tail + '"' * quoted + ends, re.sub(r",?\s*(\"[^\"]*\"?\s*:?\s*)?$", "", tail) + ends]
            tries += [last + "]" * (last.count("[") - last.count("]")) + "}" * (last.count("{") - last.count("}"))]
        for t in tries:
            try:
                found = json.loads(t)
            except ValueError:
                continue
            if isinstance(found, dict):
                return json.dumps(found, ensure_ascii=False, separators=(",", ":"))
        return json.dumps({"raw_response": text}, ensure_ascii=False, separators=(",", ":"))

    return answer.map(one)


def deduped_lines(docs: DataFrame, key: str, text: str, most: int = 2) -> DataFrame:
    """(key, text): a line stands twice in a row at most; a table's row that repeats, or an empty one, ends the text."""
    rows = _lines(docs, key, text)
    by = Window.partitionBy("key").orderBy("pos")
    rows = rows.withColumn("new", F.coalesce(F.lag("line").over(by) != F.col("line"), F.lit(True)))
    rows = rows.withColumn("run", F.sum(F.col("new").cast("int")).over(by))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("key", "run").orderBy("pos")))
    table = F.col("line").rlike(r"^\|.*\|$")
    stop = (table & (F.col("n") > 1)) | F.col("line").rlike(r"^\|[\s|]*\|$")
    rows = rows.withColumn("end", F.min(F.when(stop, F.col("pos"))).over(Window.partitionBy("key")))
    kept = rows.where((F.col("end").isNull() | (F.col("pos") < F.col("end"))) & ((F.col("n") <= most) | (F.col("line") == "")))
    out = kept.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "raw"))), lambda x: x["raw"]), "\n").alias("text"))
    return docs.select(F.col(key).alias("key")).distinct().join(out, "key", "left").select(F.col("key").alias(key), F.coalesce("text", F.lit("")).alias("text"))


# Words of header rows.
HEADER_WORDS = "item|product|description|particular|qty|quantity|rate|amount|opening|closing|receipt|issue|sale|balance|stock|pack|batch|total|value|code|name"


def header_row(rows: DataFrame, key: str, order: str = "row_idx", cells: str = "cells", first: int = 15) -> DataFrame:
    """(key, header_idx): of the first rows, that with the best score of filled cells, header words and figures; the first of equals."""
    full = F.filter(cells, lambda c: F.trim(c) != "")
    words = F.size(F.filter(full, lambda c: F.lower(c).rlike(HEADER_WORDS)))
    figures = F.size(F.filter(full, lambda c: F.regexp_replace(c, ",", "").rlike(r"^\s*-?[0-9]+(\.[0-9]+)?\s*$")))
    score = F.size(full) * 1.5 + words * 3 - figures * 2
    return rows.where((F.col(order) < first) & (F.size(full) >= 2)).groupBy(key).agg(F.max_by(order, F.struct(score, -F.col(order))).alias("header_idx"))


def delimiter(rows: DataFrame, key: str, line: str, order: str, first: int = 20) -> DataFrame:
    """(key, delimiter, header_idx): the first of comma, tab, pipe and semicolon that makes three fields of a line; the header is the first line with most fields."""
    bare = F.regexp_replace(F.col(line), '"[^"]*"', "")
    sizes = [(d, F.size(F.split(bare, p))) for d, p in ((",", ","), ("\t", "\t"), ("|", r"\|"), (";", ";"))]
    each = rows.where(F.col(order) < first).groupBy(key).agg(*(F.max(n).alias(f"n{k}") for k, (_, n) in enumerate(sizes)), *(F.max_by(order, F.struct(n, -F.col(order))).alias(f"h{k}") for k, (_, n) in enumerate(sizes)))
    pick = lambda what: F.coalesce(*(F.when(F.col(f"n{k}") >= 3, what(k)) for k in range(4)))
    return each.select(key, pick(lambda k: F.lit(sizes[k][0])).alias("delimiter"), pick(lambda k: F.col(f"h{k}")).alias("header_idx"))


def dominant(tables: DataFrame, key: str, order: str, columns: Column, rows: Column) -> DataFrame:
    """(key, order): the table with most cells; the first of equals."""
    return tables.groupBy(key).agg(F.max_by(order, F.struct((columns * rows).alias("n"), (-F.col(order)).alias("o"))).alias(order))


def sheet(cells: Column) -> Column:
    """Rows of a sheet (array of arrays) without empty rows, padded to the widest, without empty columns at the end."""
    rows = F.filter(F.transform(cells, lambda r: F.transform(r, lambda c: F.translate(F.regexp_replace(F.trim(F.coalesce(F.nullif(c, F.lit("nan")), F.lit(""))), r"\s+", " "), "|", "/"))), lambda r: F.exists(r, lambda c: c != ""))
    used = F.coalesce(F.array_max(F.transform(rows, lambda r: F.coalesce(F.array_max(F.transform(r, lambda c, i: F.when(c != "", i + 1))), F.lit(0)))), F.lit(0))
    return F.transform(rows, lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), used)), F.lit(1), used))


def sheet_tables(tables: DataFrame, key: str) -> DataFrame:
    """(key, table_index, columns, rows, dominant) of pipe tables (key, table_idx, row_idx, cells), row 0 the header.

    A first row that only titles the next one goes: nothing beside its first cell, or the same as in the
    next. Blank names are Column i. Rows without text go, others are fitted to the header; columns at the end
    that are empty in all rows go. dominant is the table of the most cells, the first of equals.
    """
    t = tables.groupBy(key, "table_idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("row_idx", "cells"))), lambda r: r["cells"]).alias("all"))
    tail = lambda r: F.slice(r, 2, F.greatest(F.size(r), F.lit(1)))
    body = tail(F.col("all"))
    a, b = F.get(body, F.lit(0)), F.get(body, F.lit(1))
    title = F.coalesce((F.size(body) >= 2) & (F.size(a) > 1) & (F.size(b) > 1) & (F.forall(tail(a), lambda c: F.trim(c).isin("", "-")) | (tail(a) == tail(b))), F.lit(False))
    head = F.get("all", F.lit(0))
    t = t.withColumns({"columns": F.transform(head, lambda h, i: F.when(h == "", F.concat(F.lit("Column "), (i + 1).cast("string"))).otherwise(h)), "body": F.when(title, tail(body)).otherwise(body)})
    rows = F.transform(F.filter("body", lambda r: F.exists(r, lambda c: F.trim(c) != "")), lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), F.size("columns"))), F.lit(1), F.size("columns")))
    t = t.where(F.size("columns") > 0).withColumn("x", without_empty_tail(F.col("columns"), rows))
    t = t.select(key, (F.col("table_idx") + 1).alias("table_index"), F.col("x.headers").alias("columns"), F.col("x.rows").alias("rows"))
    size = F.struct((F.size("columns") * F.size("rows")).alias("n"), (-F.col("table_index")).alias("i"))
    best = t.groupBy(F.col(key).alias("_key")).agg((-F.max(size)["i"]).alias("_best"))
    return t.join(best, F.col(key) == F.col("_key")).select(key, "table_index", "columns", "rows", (F.col("table_index") == F.col("_best")).alias("dominant"))


def tables_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For mapInPandas over (key, html): (key, table_idx, row_idx, cells)."""
    for frame in batches:
        out = [(k, t, r, cells) for k, h in zip(frame.iloc[:, 0], frame.iloc[:, 1], strict=True) for t, table in enumerate(html_rows(h)) for r, cells in enumerate(table)]
        yield pd.DataFrame(out, columns=["key", "table_idx", "row_idx", "cells"])
