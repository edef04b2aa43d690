"""Named queries with the DuckDB text that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            assert name not in self.queries, name
            self.queries[name] = f
            if sql is not None:
                self.oracle[name] = sql
            return f

        return keep


def r(x: str, name: str, places: int = 6) -> str:
    """A rounded double in DuckDB, as ``panel.rounded`` rounds it."""
    return f"round({x}, {places}) + 0.0 AS {name}"
