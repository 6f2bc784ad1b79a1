"""Registry of catalogue queries and of the SQL each one is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Shared common table expressions: the SQL side of :mod:`hostloom.plans.roles`.
SHARED: dict[str, str] = {}


def shared(name: str, sql: str) -> None:
    """Register a common table expression that oracle texts may mention by name."""
    SHARED[name] = sql


def _needed(sql: str, found: dict[str, None]) -> dict[str, None]:
    for name, body in SHARED.items():
        if name not in found and re.search(rf"\b{name}\b", sql):
            _needed(body, found)
            found[name] = None
    return found


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its independent statement for the comparison."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            parts = [f"{cte} AS ({SHARED[cte]})" for cte in _needed(sql, {})]
            text = sql.strip()
            if parts:
                head = ", ".join(parts)
                text = f"WITH {head}, {text[5:]}" if text[:5].upper() == "WITH " else f"WITH {head} {text}"
            ORACLES[name] = text
        return fn

    return register
