"""Spreadsheets and text documents as data sources: zipped XML read with the standard library, one task a file.

Binary .xls and .doc files are refused. Files come as bytes from Spark's own reader, so any store works.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_X = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SHEETS = "path string, sheet string, row_idx int, cells array<string>"


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(content: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """(sheet, row_idx, cells) of a workbook, header-less; empty sheets give none."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_X}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_X}si")]
        links = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_X}sheet"):
            target = links[sheet.get(f"{_R}id")].lstrip("/")
            target = target if target.startswith("xl/") else f"xl/{target}"
            for i, row in enumerate(ET.fromstring(z.read(target)).iter(f"{_X}row")):
                cells: dict[int, str] = {}
                for k, c in enumerate(row.iter(f"{_X}c")):
                    v, kind = c.find(f"{_X}v"), c.get("t")
                    text = "".join(t.text or "" for t in c.iter(f"{_X}t")) if kind == "inlineStr" else "" if v is None else shared[int(v.text)] if kind == "s" else v.text or ""
                    cells[_column(c.get("r")) if c.get("r") else k] = text
                if any(cells.values()):
                    at = int(row.get("r", i + 1)) - 1
                    yield sheet.get("name"), at, [cells.get(k, "") for k in range(max(cells) + 1)]


def word_markdown(content: bytes) -> str:
    """A text document as markdown: headings, list items, paragraphs, and all tables after them."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t")).strip()
    out = []
    for p in body.findall(f"{_W}p"):
        style = p.find(f"{_W}pPr/{_W}pStyle")
        name, t = (style.get(f"{_W}val") or "").lower() if style is not None else "", text(p)
        if t:
            level = re.search(r"heading\s*(\d)", name)
            out.append(("#" * min(int(level[1]), 3) + " " if level else "# " if name == "title" else "- " if "list" in name else "") + t)
    for table in body.findall(f"{_W}tbl"):
        rows = [[text(c).replace("|", "/") for c in r.findall(f"{_W}tc")] for r in table.findall(f"{_W}tr")]
        if rows:
            out.append("\n".join(["| " + " | ".join(rows[0]) + " |", "|" + "---|" * len(rows[0]), *("| " + " | ".join(r) + " |" for r in rows[1:])]))
    return "\n\n".join(out)


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")


def sheet_table(files: DataFrame) -> DataFrame:
    """(path, sheet, row_idx, cells) of workbooks (path, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at, content in zip(frame["path"], frame["content"], strict=True):
                if bytes(content[:4]) == b"\xd0\xcf\x11\xe0":
                    raise ValueError(f"{at}: binary workbooks aren't supported")
                yield pd.DataFrame([(at, *r) for r in sheet_rows(bytes(content))], columns=["path", "sheet", "row_idx", "cells"])

    return files.mapInPandas(run, SHEETS)


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row_idx, cells) of all workbooks of a folder."""
    return sheet_table(_files(spark, path, "*.xlsx"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, markdown) of all text documents of a folder."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"path": frame["path"], "markdown": [word_markdown(bytes(c)) for c in frame["content"]]})

    return _files(spark, path, "*.docx").mapInPandas(run, "path string, markdown string")


def sanitised(cell: Column) -> Column:
    """A cell's text: white space collapsed, pipes as slashes, nan blank."""
    t = F.trim(F.regexp_replace(F.coalesce(cell, F.lit("")), r"\s+", " "))
    return F.when(F.lower(t) == "nan", "").otherwise(F.translate(t, "|", "/"))
