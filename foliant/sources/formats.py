"""Workbooks and text documents as data sources of their own, tables of databases, and pages to tables as a table function.

register(spark) makes `spark.read.format("workbook").load(folder)`, `format("worddoc")` and the SQL function
pages_to_tables(markdown) known to a session. A source has a partition for each file and opens it on the
executor, so its folder has to be one that all of them see.
"""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import udtf

from foliant.sources.office import SHEETS, sheet_rows, word_markdown


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, folder: str, pattern: str, rows):
        self.folder, self.pattern, self.rows = folder.removeprefix("file://").removeprefix("file:"), pattern, rows

    def partitions(self) -> list[InputPartition]:
        if os.path.isfile(self.folder):
            return [_File(self.folder)]
        found = [os.path.join(at, n) for at, _, names in os.walk(self.folder) for n in names if fnmatch.fnmatch(n.lower(), self.pattern)]
        return [_File(f) for f in sorted(found)] or [_File("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.path:
            content = Path(partition.path).read_bytes()
            if content[:4] == b"\xd0\xcf\x11\xe0":
                raise ValueError(f"{partition.path}: binary office files aren't supported")
            yield from self.rows(partition.path, content)


class Workbook(DataSource):
    """(path, sheet, row_idx, cells) of .xlsx files, header-less."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SHEETS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], "*.xlsx", lambda path, content: ((path, *row) for row in sheet_rows(content)))


class WordDocument(DataSource):
    """(path, markdown) of .docx files."""

    @classmethod
    def name(cls) -> str:
        return "worddoc"

    def schema(self) -> str:
        return "path string, markdown string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], "*.docx", lambda path, content: iter([(path, word_markdown(content))]))


class PagesToTables:
    """Rows of a text's pipe tables, rules left out; row 0 is the header."""

    def eval(self, markdown: str):
        table, row = 0, 0
        for line in [*(markdown or "").splitlines(), ""]:
            line = line.strip()
            if len(line) > 1 and line[0] == line[-1] == "|":
                if line.strip("|-: \t"):
                    yield table, row, [c.strip() for c in line[1:-1].split("|")]
                    row += 1
            elif row:
                table, row = table + 1, 0


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Workbook)
    spark.dataSource.register(WordDocument)
    spark.udtf.register("pages_to_tables", udtf(PagesToTables, returnType="table_idx int, row_idx int, cells array<string>"))


def read_database(spark: SparkSession, url: str, table: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """A database's table; with a whole-number key, read in parts side by side. Filters and columns reach the database."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key:
        reader = reader.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()
