"""Aggregates over document records. Every summary is one fused aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _tokens() -> Column:
    return F.coalesce(F.col("prompt_tokens"), F.lit(0)) + F.coalesce(F.col("completion_tokens"), F.lit(0))


def summary(records: DataFrame) -> DataFrame:
    """Counts by status, means over completed records, token sums over all.

    A mean of exactly zero, or none, shows as 1.0 confidence and 0.0 time. Only records whose status is the
    bare word count as processing.
    """
    done = F.col("status") == "COMPLETED"
    total = F.sum(_tokens())
    return records.agg(
        F.count("*").alias("total_documents"), F.count_if(done).alias("completed"), F.count_if(F.col("status") == "FAILED").alias("failed"),
        F.count_if(F.col("status") == "PROCESSING").alias("processing"),
        F.round(F.coalesce(F.nullif(F.avg(F.when(done, F.col("confidence"))), F.lit(0.0)), F.lit(1.0)), 4).alias("avg_confidence"),
        F.round(F.coalesce(F.avg(F.when(done, F.col("processing_time"))), F.lit(0.0)), 2).alias("avg_time"),
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"),
        F.coalesce(total, F.lit(0)).alias("total_tokens"), F.round(F.coalesce(total / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)), 1).alias("tokens_per_request"),
    )


def by_project(records: DataFrame) -> DataFrame:
    """Per project, else department: count, tokens, mean confidence and time over all statuses. Null and blank names are two groups."""
    g = records.groupBy(F.coalesce("project_name", "department").alias("project")).agg(
        F.count("*").alias("documents"), F.coalesce(F.sum(_tokens()), F.lit(0)).alias("total_tokens"),
        F.round(F.avg("confidence"), 4).alias("avg_confidence"), F.round(F.avg("processing_time"), 2).alias("avg_time"),
    )
    return g.withColumn("project", F.coalesce(F.nullif("project", F.lit("")), F.lit("DefaultProject")))


def in_project(records: DataFrame, name: str) -> DataFrame:
    """Records whose project or department is the name, whatever the case."""
    wanted = F.lit(name.strip().lower())
    return records.where((F.lower("project_name") == wanted) | (F.lower("department") == wanted))


def type_distribution(records: DataFrame) -> DataFrame:
    """Counts by type. Null, blank and UNKNOWN are one type, and their counts add up."""
    kind = F.coalesce(F.nullif("document_type", F.lit("")), F.lit("UNKNOWN"))
    return records.groupBy(kind.alias("document_type")).agg(F.count("*").alias("documents"))


def type_share(records: DataFrame) -> DataFrame:
    """Types with their per cent of all records."""
    whole = F.sum("documents").over(Window.partitionBy())
    return type_distribution(records).withColumn("percent", F.round(F.col("documents") * 100 / whole).cast("long"))


def token_usage(calls: DataFrame, key: str = "document_id") -> DataFrame:
    """Tokens of each document over its model calls; a document without figures has zeros."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return calls.groupBy(key).agg(zero("prompt_tokens"), zero("completion_tokens"), F.coalesce(F.sum(_tokens()), F.lit(0)).alias("total_tokens"))


def recent(records: DataFrame, n: int) -> DataFrame:
    """The n newest records; ties by id."""
    return records.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def progress(records: DataFrame, pages: DataFrame) -> DataFrame:
    """Whole per cent of pages done; a record without a page count has one page."""
    done = pages.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("pages_done"))
    count = F.coalesce(F.nullif("page_count", F.lit(0)), F.lit(1))
    n = F.coalesce("pages_done", F.lit(0))
    return records.join(done, "id", "left").select("id", "status", n.alias("pages_done"), F.floor(n * 100 / count).cast("long").alias("percent"))


def status_groups(records: DataFrame) -> DataFrame:
    """Counts by the first word of the status, so that running records are counted with their page."""
    return records.groupBy(F.regexp_extract("status", "^([A-Z]+)", 1).alias("status")).agg(F.count("*").alias("documents"))
