"""Stages over documents; each is written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm.stages import STAGES, staged

__all__ = ["ORACLE_SQL", "STAGES", "run"]

#: Language ID, near duplicates and decontamination have no SQL; a test holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents after all stages."""
    return staged(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
