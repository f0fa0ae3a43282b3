"""The payload that business systems take, with all its options."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fields that hold a document's table, the first one counts; fields beside it.
TABLE_FIELDS = ("items", "line_items", "transactions", "rows")
EXPORTS = {"json": ("json",), "erp": ("erp", "erp_data", "business"), "text": ("txt", "md"), "csv": ("csv",)}


def _left(value):
    """A value without empty leaves, or None; False and 0 are no empty leaves."""
    if isinstance(value, dict):
        value = {k: v for k, x in value.items() if (v := _left(x)) is not None}
    elif isinstance(value, list):
        value = [v for x in value if (v := _left(x)) is not None]
    elif isinstance(value, str):
        return value if value.strip() else None
    return None if value in ({}, []) and not isinstance(value, (bool, int, float)) else value


@F.pandas_udf(StringType())
def pruned(document: pd.Series) -> pd.Series:
    """JSON without empty leaves, on any level; null where nothing is left, or where it is no JSON."""

    def one(text: str) -> str | None:
        try:
            value = _left(json.loads(text))
        except ValueError:
            return None
        return None if value is None else json.dumps(value, ensure_ascii=False, separators=(",", ":"))

    return document.map(one, na_action="ignore")


def read_envelope(document: Column) -> Column:
    """A JSON object as a map of its fields to their JSON; an empty map for what is none."""
    return F.coalesce(F.from_json(document, "map<string,string>"), F.create_map().cast("map<string,string>"))


def ranked_tables(tables: DataFrame, key: str) -> DataFrame:
    """tables (key, field, table_idx, rows, ...) with place: 1 for the table that a document publishes first, 2 and on for further ones; others have none.

    Tables of all_tables go before any other field's; of these the first of TABLE_FIELDS counts alone.
    Tables without rows don't count.
    """
    rank = F.coalesce(F.array_position(F.array(*(F.lit(f) for f in ("all_tables", *TABLE_FIELDS))), F.col("field")).cast("int"), F.lit(0))
    rows = tables.withColumn("_rank", F.when((rank > 0) & (F.size("rows") > 0), rank))
    best = rows.groupBy(key).agg(F.min("_rank").alias("_best"), F.sort_array(F.collect_list(F.when(F.col("_rank") == 1, F.col("table_idx")))).alias("_all"))
    place = F.when(F.col("_best") == 1, F.array_position("_all", F.col("table_idx"))).otherwise(F.lit(1))
    return rows.join(best, key).withColumn("place", F.when(F.col("_rank") == F.col("_best"), place.cast("int"))).drop("_rank", "_best", "_all")


def _object(entries: list[tuple[str, Column]], always: set[str]) -> Column:
    """A JSON object of JSON values; null ones go, but for those that are always there."""
    parts = [F.when(v.isNotNull() | F.lit(k in always), F.concat(F.lit(f'"{k}":'), F.coalesce(v, F.lit("null")))) for k, v in entries]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _text(c: Column) -> Column:
    return F.when(c.isNotNull(), F.regexp_replace(F.to_json(F.array(c.cast("string"))), r"^\[|\]$", ""))


def _list(c: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(c, ","), F.lit("]"))


def assembled_payloads(documents: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """(key, payload): one JSON object a document.

    documents: (key, request_id, source_file, document_type, project_name, extracted_at, confidence,
    review_required, data as JSON, flagged an array of fields, reasons an array of why a page can't be read).
    items: (key, place, table_name, item_idx, item as JSON), place 1 for the first table. data, line_items,
    document_type and review_required are always there; review_fields, review_reason and additional_tables
    only where there are any.
    """
    each = items.groupBy(key, "place", "table_name").agg(F.transform(F.sort_array(F.collect_list(F.struct("item_idx", "item"))), lambda x: x["item"]).alias("list"))
    name = F.coalesce(_text(F.col("table_name")), F.col("place").cast("string"))
    further = F.concat(F.lit('{"table":'), name, F.lit(',"line_items":'), _list(F.col("list")), F.lit("}"))
    tables = each.groupBy(key).agg(
        F.max(F.when(F.col("place") == 1, _list(F.col("list")))).alias("line_items"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("place") > 1, F.struct("place", further.alias("json"))))), lambda x: x["json"]).alias("further"),
    )
    some = lambda c, value: F.when(F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0, value)
    body = _object(
        [
            ("document_id", F.col(key).cast("string")), ("request_id", _text(F.col("request_id"))), ("source_file", _text(F.col("source_file"))),
            ("document_type", _text(F.coalesce("document_type", F.lit("UNKNOWN")))), ("project_name", _text(F.col("project_name"))), ("extracted_at", _text(F.col("extracted_at"))),
            ("confidence", F.col("confidence").cast("string")), ("review_required", F.coalesce("review_required", F.lit(False)).cast("string")), ("data", F.coalesce(pruned(F.col("data")), F.lit("{}"))),
            ("line_items", F.coalesce("line_items", F.lit("[]"))), ("review_fields", some(F.col("flagged"), F.to_json("flagged"))), ("review_reason", some(F.col("reasons"), _text(F.array_join("reasons", "; ")))),
            ("additional_tables", some(F.col("further"), _list(F.col("further")))),
        ],
        {"data", "line_items", "review_required", "document_type"},
    )
    return documents.join(tables, key, "left").select(key, body.alias("payload"))


def export_kind(name: str) -> str:
    """What an export's name asks for: json, erp, text or csv; others are refused."""
    for kind, names in EXPORTS.items():
        if name.lower() in names:
            return kind
    raise ValueError(f"unknown export format: {name}")


def pretty_text(document: Column, markdown: Column, title: Column) -> Column:
    """The text export: a banner, the document's fields as indented JSON, and its text."""
    return F.concat_ws("\n\n", F.concat(F.lit("=== "), title, F.lit(" ===")), indented(document), markdown)


@F.pandas_udf(StringType())
def indented(document: pd.Series) -> pd.Series:
    """JSON over lines, two spaces a level; {} for what is none."""

    def one(text: str | None) -> str:
        try:
            return json.dumps(json.loads(text or "{}"), ensure_ascii=False, indent=2)
        except ValueError:
            return "{}"

    return document.map(one)
