"""Field envelopes and the payload that business systems take. Fields are entries in order of first sight: maps and variants would lose it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import ids
from foliant.functions.cells import present
from foliant.functions.roles import unique_headers


def normalised(fields: DataFrame, key: str, template: list[str]) -> DataFrame:
    """(key, path, value, confidence, ord, review) of fields (key, path, value, confidence, ord).

    Template keys come first, in the template's order, then others as seen. Absent values go. A field
    without confidence has 0.95. Review: under 0.60, or a value that the loose rules refuse.
    """
    value = present(F.trim("value"))
    place = F.array_position(F.array(*(F.lit(t) for t in template)), F.col("path")) if template else F.lit(0)
    rows = fields.withColumn("value", value).where(F.col("value").isNotNull() & (F.col("value") != ""))
    confidence = F.coalesce("confidence", F.lit(0.95))
    rows = rows.withColumns({"confidence": confidence, "ord": F.when(place > 0, place - 1).otherwise(F.col("ord") + len(template)).cast("long")})
    return rows.withColumn("review", (F.col("confidence") < 0.6) | ~ids.loose_ok(F.col("path"), F.col("value"))).select(key, "path", "value", "confidence", "ord", "review")


def envelopes(fields: DataFrame, key: str) -> DataFrame:
    """Per document: mean confidence (0.50 without fields), quality, review, and the fields in order as entries."""
    entry = F.struct("ord", "path", "value", "confidence")
    g = fields.groupBy(key).agg(F.round(F.avg("confidence"), 2).alias("overall_confidence"), F.max("review").alias("any_review"), F.transform(F.sort_array(F.collect_list(entry)), lambda e: F.struct(e["path"].alias("key"), e["value"].alias("value"), e["confidence"].alias("confidence"))).alias("fields"))
    c = F.coalesce("overall_confidence", F.lit(0.5))
    quality = F.when(c >= 0.95, "Excellent").when(c >= 0.85, "Good").when(c >= 0.7, "Average").when(c >= 0.5, "Poor").otherwise("Unreadable")
    return g.select(key, c.alias("overall_confidence"), quality.alias("document_quality"), (F.col("any_review") | (c < 0.7)).alias("needs_manual_review"), "fields")


def final_confidence(table: Column, verified: Column, document_type: Column, rows: Column, legible: Column, base: Column) -> Column:
    """A table's validation decides, else the fields' verification; tabular types without rows have 0.30; an illegible page 0.10 at most."""
    empty = document_type.isin("STOCK_STATEMENT", "SPREADSHEET", "LEDGER") & (F.coalesce(rows, F.lit(0)) == 0)
    c = F.coalesce(table, F.when(empty, 0.3), verified, base)
    return F.when(legible, c).otherwise(F.least(c, F.lit(0.1)))


def line_items(tables: DataFrame, key: str) -> DataFrame:
    """(key, item_idx, item): rows of tables (columns, rows) as JSON objects under distinct names, without blank cells; rows without any go. Cells stay as printed."""
    wide = F.greatest(F.size("columns"), F.coalesce(F.array_max(F.transform("rows", lambda r: F.size(r))), F.lit(0)))
    padded = F.concat("columns", F.array_repeat(F.lit(""), F.greatest(wide - F.size("columns"), F.lit(0))))
    named = tables.withColumn("names", unique_headers(padded)).select(key, "names", F.posexplode("rows").alias("item_idx", "cells"))
    pairs = F.filter(F.zip_with("names", "cells", lambda n, c: F.struct(n.alias("key"), c.alias("value"))), lambda p: F.coalesce(F.trim(p["value"]), F.lit("")) != "")
    rows = named.select(key, "item_idx", pairs.alias("entries")).where(F.size("entries") > 0)
    quoted = lambda c: F.to_json(F.array(c))
    inner = lambda c: F.regexp_replace(F.regexp_replace(quoted(c), r"^\[", ""), r"\]$", "")
    body = F.array_join(F.transform("entries", lambda p: F.concat(inner(p["key"]), F.lit(":"), inner(p["value"]))), ",")
    return rows.select(key, "item_idx", "entries", F.concat(F.lit("{"), body, F.lit("}")).alias("item"))


def item_columns(items: DataFrame, key: str) -> DataFrame:
    """(key, columns): names over all items in order of first sight."""
    each = items.select(key, "item_idx", F.posexplode("entries").alias("pos", "e"))
    first = each.groupBy(key, F.col("e.key").alias("name")).agg(F.min(F.struct("item_idx", "pos")).alias("at"))
    return first.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("columns"))


def payloads(documents: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """(key, payload): one JSON object a document, with data and line_items always and review fields only where there are any."""
    lists = items.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("item_idx", "item"))), lambda x: x["item"]).alias("items"))
    rows = documents.join(lists, key, "left")
    head = F.to_json(F.struct(F.col(key).alias("document_id"), "document_type", "confidence", "review_required"))
    data = F.to_json(F.coalesce("data", F.create_map().cast("map<string,string>")))
    tail = F.concat(F.lit(',"data":'), data, F.lit(',"line_items":['), F.array_join(F.coalesce("items", F.array().cast("array<string>")), ","), F.lit("]}"))
    return rows.select(key, F.concat(F.regexp_replace(head, r"\}$", ""), tail).alias("payload"))
