"""Where the library's queries over the driver's tables are kept, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *ctes: str, recursive: bool = False) -> Callable[[Query], Query]:
    """Registers a query by its name; ``ctes`` stand before the SQL."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = (f"WITH {'RECURSIVE ' if recursive else ''}" + ",".join(ctes) + "\n" if ctes else "") + sql
        return fn

    return register
