"""Named queries over the driver's tables, each beside the SQL that defines its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        name = build.__name__
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register
