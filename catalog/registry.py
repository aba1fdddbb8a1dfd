"""Name, Spark function and SQL of every query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}


def query(sql: str | None = None, uses: str = "") -> Callable[[Query], Query]:
    """Register a query; ``uses`` names the shared views its SQL reads."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = assemble(sql, uses)
        return function

    return add


def view(name: str, body: str, uses: str = "") -> None:
    """A shared SQL view; it may read the views named in ``uses``."""
    CTES[name] = body.strip()
    USES[name] = uses.split()


USES: dict[str, list[str]] = {}


def assemble(sql: str, uses: str) -> str:
    """Put the needed views before a SELECT, in the order they were defined."""
    needed: set[str] = set()
    todo = uses.split()
    while todo:
        name = todo.pop()
        if name not in needed:
            needed.add(name)
            todo += USES[name]
    parts = [f"{name} AS MATERIALIZED ({body})" for name, body in CTES.items() if name in needed]
    return (f"WITH {', '.join(parts)} " if parts else "") + sql.strip()
