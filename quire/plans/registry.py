"""Queries by name over the driver's tables, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.plans import block_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return text_queries.QUERIES | block_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return text_queries.ORACLES | block_queries.ORACLES
