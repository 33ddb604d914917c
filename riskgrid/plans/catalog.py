"""Registry of queries and of the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Named relations for the SQL side, each with the ones it reads.
RELATIONS: dict[str, tuple[tuple[str, ...], str]] = {}


def relation(name: str, sql: str, *reads: str) -> None:
    RELATIONS[name] = (reads, sql)


def using(reads: tuple[str, ...], body: str, recursive: str = "") -> str:
    """`body` with the relations it reads put in front as a WITH clause."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for other in RELATIONS[name][0]:
                visit(other)
            order.append(name)

    for name in reads:
        visit(name)
    parts = [f"{name} AS ({RELATIONS[name][1]})" for name in order]
    if recursive:
        parts.append(recursive)
    if not parts:
        return body
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + body


def query(name: str, sql: str | None = None, reads: tuple[str, ...] = (), recursive: str = ""):
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = using(reads, sql, recursive)
        return fn

    return keep


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floating columns rounded, and without a negative zero, for comparison."""
    return df.select(
        *[
            (F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(f"`{c}`")
            for c, t in df.dtypes
        ]
    )


def r(expression: str, name: str, digits: int = 6) -> str:
    """The same rounding in SQL."""
    return f"round(({expression})::double, {digits}) + 0.0::double AS {name}"
