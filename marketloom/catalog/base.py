"""Registry of queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def view(name: str, body: str, *needs: str) -> None:
    """A named step of the checking SQL, and the steps it builds on."""
    _VIEWS[name] = (needs, body)


def sql(select: str, *needs: str) -> str:
    """A statement with exactly the steps it needs, in order."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n not in order:
            for d in _VIEWS[n][0]:
                visit(d)
            if n not in order:
                order.append(n)

    for n in needs:
        visit(n)
    if not order:
        return select
    steps = ",\n".join(f"{n} AS MATERIALIZED ({_VIEWS[n][1]})" for n in order)
    return f"WITH RECURSIVE {steps}\n{select}"


def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})
