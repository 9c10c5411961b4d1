"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliospark.plans import core_queries, reference


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return reference.QUERIES | core_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return dict(reference.ORACLE_SQL)
