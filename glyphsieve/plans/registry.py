"""All registered queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glyphsieve.plans import analytics_queries, search_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return search_queries.QUERIES | analytics_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return search_queries.ORACLES | analytics_queries.ORACLES
