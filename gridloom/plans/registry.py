"""Queries of the graph engine, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.plans import database, formats, graph, service


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return graph.QUERIES | service.QUERIES | formats.QUERIES | database.QUERIES


def oracle_sql() -> dict[str, str]:
    return graph.SQL | service.SQL | formats.SQL | database.SQL
