"""Search, lookups and set operations over stored documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matches(columns: list[str], query: str | None) -> Column:
    """Any column like %query%, whatever the case. Wildcards in the query stay live; a blank query matches all, an empty one filters nothing."""
    if not query:
        return F.lit(True)
    pattern = f"%{query.strip()}%".replace("\\", "\\\\")
    return reduce(lambda a, b: a | b, (F.coalesce(F.ilike(F.col(c), F.lit(pattern)), F.lit(False)) for c in columns))


def chosen(column: str, value: str | None) -> Column:
    """Equality, or nothing where the value is empty or All."""
    return F.lit(True) if not value or value == "All" else F.col(column) == value


def search(records: DataFrame, results: DataFrame, columns: list[str], query: str | None = None, doc_type: str | None = None, language: str | None = None) -> DataFrame:
    """Records with their results, if any, that match; a record without a result still matches by its own columns.

    Either side's own columns are read where they lie, so the join carries what the query found in them, and
    the rest of a record only where it is asked for.
    """
    sides = [[c for c in columns if c in df.columns] for df in (records, results)]
    hit = lambda cols: matches(cols, query) if cols else F.lit(False)
    left = records.where(chosen("document_type", doc_type)).withColumn("_left", hit(sides[0]))
    right = results.withColumn("_right", hit(sides[1]))
    language_ok = chosen("language", language)
    joined = left.join(right, "id", "left").where((F.col("_left") | F.coalesce("_right", F.lit(not query and bool(sides[1])))) & language_ok)
    return joined.drop("_left", "_right")


def lookup(records: DataFrame, request: str) -> DataFrame:
    """By request id, else, for digits only, by id."""
    own = records.where(F.col("request_id") == request)
    if not request.isdigit():
        return own
    other = records.where(F.col("id") == int(request)).join(own.select(F.lit(1).alias("_found")).limit(1), how="left_anti")
    return own.unionByName(other)


def combined_pages(pages: DataFrame, key: str, order: str, text: str, separator: str = "\n\n---\n\n") -> DataFrame:
    """A document's pages in order, each under a comment with its number."""
    row = F.struct(F.col(order).alias("n"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    each = F.transform(F.sort_array(F.collect_list(row)), lambda p: F.concat(F.lit("<!-- Page "), p["n"].cast("string"), F.lit(" -->\n"), p["t"]))
    return pages.groupBy(key).agg(F.array_join(each, separator).alias("markdown"))


def first_uploads(uploads: DataFrame, name: str, order: str) -> DataFrame:
    """Uploads with kept: the first of each file name. A hot name is an aggregate and a join, not a window."""
    first = uploads.groupBy(F.struct(name).alias("_name")).agg(F.min(order).alias("_first"))
    return uploads.withColumn("_name", F.struct(name)).join(first, "_name").select(*uploads.columns, (F.col(order) == F.col("_first")).alias("kept"))


def dropped_uploads(uploads: DataFrame, name: str, order: str) -> DataFrame:
    """(name, copies): file names that came more than once, with how many were left out."""
    return uploads.groupBy(name).agg((F.count_distinct(order) - 1).alias("copies")).where("copies > 0")


def active(records: DataFrame) -> DataFrame:
    """Records that nobody revoked."""
    return records.where(F.col("revoked_at").isNull())


def without_keys(entries: Column, keys: list[str]) -> Column:
    """A map without some of its keys."""
    return F.map_filter(entries, lambda k, _: ~k.isin(*keys))


def dashboard(records: DataFrame, pages: DataFrame, types: list[str]) -> DataFrame:
    """One row: documents, pages, and documents of each type, whatever the case of its name; types in lower case are columns."""
    kind = F.upper(F.trim("document_type"))
    own = records.agg(F.count("*").alias("documents"), *(F.count_if(kind == t.upper()).alias(t.lower()) for t in types))
    return own.withColumn("_one", F.lit(1)).join(pages.agg(F.count("*").alias("pages"), F.lit(1).alias("_one")), "_one").drop("_one")


def missing(source: DataFrame, target: DataFrame, key: str = "id") -> DataFrame:
    """Rows of source whose key target lacks."""
    return source.join(target.select(key), key, "left_anti")


def without_deleted(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str = "id") -> DataFrame:
    """Children whose parent is there: what a cascading delete leaves."""
    return children.join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_semi")


def retained(records: DataFrame, days: int, now: Column) -> DataFrame:
    """Records not older than so many days."""
    return records.where(F.col("created_at") >= now - F.expr(f"INTERVAL {int(days)} DAYS"))


def kept_files(files: DataFrame, records: DataFrame, days: int, now: Column) -> DataFrame:
    """files (path, modified, record_id) with kept: not older than so many days, or of a record that is still there."""
    there = records.select(F.col("id").alias("record_id"), F.lit(True).alias("_there")).distinct()
    young = F.col("modified") >= now - F.expr(f"INTERVAL {int(days)} DAYS")
    return files.join(there, "record_id", "left").select(*files.columns, (young | F.coalesce("_there", F.lit(False))).alias("kept"))


def stored_names(uploads: DataFrame, taken: DataFrame, name: str, order: str) -> DataFrame:
    """File names to store under: the safe name, with eight hex digits before it where it is taken."""
    safe = F.regexp_replace(name, r"[^a-zA-Z0-9_\-.]", "_")
    rows = uploads.withColumn("safe", safe)
    first = rows.groupBy("safe").agg(F.min(order).alias("_first"))
    rows = rows.join(first, "safe").withColumn("_again", F.col(order) > F.col("_first")).drop("_first")
    rows = rows.join(taken.select(F.col("stored_filename").alias("safe"), F.lit(True).alias("_taken")).distinct(), "safe", "left")
    prefix = F.substring(F.md5(F.concat_ws("/", F.col("safe"), F.col(order).cast("string"))), 1, 8)
    return rows.withColumn("stored_filename", F.when(F.col("_again") | F.coalesce("_taken", F.lit(False)), F.concat_ws("_", prefix, "safe")).otherwise(F.col("safe"))).drop("_again", "_taken", "safe")


def csv_rows(documents: DataFrame, id_column: str, summary: Column, fields: Column) -> DataFrame:
    """(id, ord, line) of a document's CSV export: summary, blank line, header, one line a field; line breaks become spaces."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(c, r"[\r\n]+", " "), '"', '""'), F.lit('"'))
    head = F.array(summary, F.lit(""), F.lit("Structured Field,Value"))
    body = F.transform(fields, lambda f: F.concat(quoted(f["key"]), F.lit(","), quoted(f["value"])))
    return documents.select(id_column, F.posexplode(F.concat(head, body)).alias("ord", "line"))
