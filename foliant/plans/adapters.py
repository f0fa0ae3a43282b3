"""Views of the driver's tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document records made from events."""
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").alias("created_at"),
        F.when(F.col("user_id") % 7 != 0, F.concat(F.lit("proj_"), (F.col("user_id") % 5).cast("string"))).alias("project_name"),
        F.concat(F.lit("dept_"), (F.col("user_id") % 3).cast("string")).alias("department"),
        F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "signup", "PROCESSING (Page 1 of 2)").otherwise("COMPLETED").alias("status"),
        F.col("event_type").alias("document_type"), F.least(F.col("value") / 100, F.lit(1.0)).alias("confidence"),
        (F.col("value") / 10).alias("processing_time"), k.alias("prompt_tokens"), (F.col("event_id") % 17).alias("completion_tokens"),
        F.concat(F.lit("file_"), (F.col("event_id") % 97).cast("string"), F.when(F.col("event_id") % 2 == 0, ".pdf").otherwise(".png")).alias("original_filename"),
    )


LEDGER_SQL = """ledger AS (SELECT event_id AS id, ts AS created_at,
  CASE WHEN user_id % 7 <> 0 THEN 'proj_' || (user_id % 5) END AS project_name, 'dept_' || (user_id % 3) AS department,
  CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'PROCESSING (Page 1 of 2)' ELSE 'COMPLETED' END AS status,
  event_type AS document_type, least(value / 100, 1.0) AS confidence, value / 10 AS processing_time,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS prompt_tokens, event_id % 17 AS completion_tokens,
  'file_' || (event_id % 97) || CASE WHEN event_id % 2 = 0 THEN '.pdf' ELSE '.png' END AS original_filename FROM events)"""
