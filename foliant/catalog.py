"""Every query of the engine by name, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliant.plans import decisions, documents, extraction, fields, grids, ledger, sanitise, stock, tables, values

MODULES = (ledger, values, stock, fields, tables, extraction, grids, documents, decisions, sanitise)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
