"""Text and delimited files, whatever their delimiter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.operators.tables import delimiter
from foliant.sources.office import sheet_table

# Delimiters in order of preference, as patterns.
DELIMITERS = {",": ",", "\t": "\t", "|": r"\|", ";": ";"}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, row_idx, line) of text files; each file is read whole, by one task."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.select("path", F.posexplode(F.split(F.regexp_replace("value", "\r\n?", "\n"), "\n")).alias("row_idx", "line"))


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """(path, row_idx, is_header, cells) of delimited files, header-less. The delimiter is voted by the first 20 lines; lines above the header are kept and marked false. Quoted fields may hold the delimiter."""
    lines = read_lines(spark, path).where(F.trim("line") != "")
    vote = delimiter(lines, "path", "line", "row_idx")
    rows = lines.join(vote, "path", "left")
    cells = None
    for d, pattern in DELIMITERS.items():
        quoted = F.transform(F.split("line", f'{pattern}(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda c: F.regexp_replace(F.regexp_replace(F.trim(c), r'^"(.*)"$', "$1"), '""', '"'))
        cells = F.when(F.col("delimiter") == d, quoted) if cells is None else cells.when(F.col("delimiter") == d, quoted)
    return rows.select("path", "row_idx", F.coalesce(F.col("row_idx") == F.col("header_idx"), F.lit(False)).alias("is_header"), cells.otherwise(F.array("line")).alias("cells"))


def spreadsheet_like(content: Column) -> Column:
    """Whether a file's bytes are a workbook's, whatever it is called: a zip archive, or an older office file."""
    head = F.hex(F.substring(content, 1, 8))
    return head.startswith("504B0304") | (head == "D0CF11E0A1B11AE1")


def read_robust(spark: SparkSession, path: str) -> DataFrame:
    """(path, row_idx, is_header, cells, skipped) of files that are called delimited: workbooks among them come as their rows, and of the rest, rows of more cells than the header are marked as skipped."""
    files = spark.read.format("binaryFile").load(path).select("path", spreadsheet_like(F.col("content")).alias("book"), "content")
    books = sheet_table(files.where("book").select("path", "content")).select("path", "row_idx", (F.col("row_idx") == 0).alias("is_header"), "cells", F.lit(False).alias("skipped"))
    names = files.where("book").select("path")
    rows = read_delimited(spark, path)
    width = F.max(F.when(F.col("is_header"), F.size("cells"))).over(Window.partitionBy("path"))
    rows = rows.withColumn("skipped", F.coalesce(F.size("cells") > width, F.lit(False)))
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    return rows.withColumn("_p", plain("path")).join(names.select(plain("path").alias("_p")), "_p", "left_anti").select("path", "row_idx", "is_header", "cells", "skipped").unionAll(books)


def read_plain(spark: SparkSession, path: str) -> DataFrame:
    """(path, row_idx, line): text where two spaces or more part cells becomes rows between pipes."""
    parts = F.split(F.trim("line"), r"\s{2,}")
    return read_lines(spark, path).select("path", "row_idx", F.when(F.size(parts) >= 2, F.concat(F.lit("| "), F.array_join(parts, " | "), F.lit(" |"))).otherwise(F.col("line")).alias("line"))
