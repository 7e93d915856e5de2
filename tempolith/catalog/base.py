"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.projection import GRAPH_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def op(sql: str | None = None, graph: bool = False) -> Callable[[Query], Query]:
    """Register a query under its function's name; ``graph`` puts the projected graph's tables in front of its SQL."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            text = sql.strip()
            if graph:
                text = f"WITH RECURSIVE {GRAPH_SQL.strip()}, {text[5:]}" if text.startswith("WITH ") else f"WITH RECURSIVE {GRAPH_SQL.strip()} {text}"
            ORACLES[f.__name__] = text
        return f

    return register
