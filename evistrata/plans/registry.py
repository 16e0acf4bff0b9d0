"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *ctes: str) -> Callable[[Query], Query]:
    """Register a function by its name; ``ctes`` go before ``sql`` in a WITH clause."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = (f"WITH {', '.join(ctes)}{"" if sql.startswith(",") else " "}" if ctes else "") + sql
        return fn

    return add
