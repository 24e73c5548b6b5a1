"""Registered queries: a callable for each name, and its DuckDB twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from engrava.plans import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, extra: str = "") -> Callable[[Query], Query]:
    """Registers a query, with SQL over the model's views and further common table expressions in ``extra``."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = views.sql(sql, extra)
        return f

    return add
