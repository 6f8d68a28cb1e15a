"""Named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.plans.testviews import SQL_VIEWS, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _with_views(sql: str) -> str:
    """Put the definitions of the domain views that ``sql`` mentions in front of it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in SQL_VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    text = sql.strip()
    parts = [f"{name} AS MATERIALIZED ({SQL_VIEWS[name].strip()})" for name in needed]
    if not parts:
        return text
    for head in ("WITH RECURSIVE ", "WITH "):
        if text.startswith(head):
            return head + ",\n".join(parts) + ",\n" + text[len(head):]
    return "WITH " + ",\n".join(parts) + "\n" + text


def query(name: str, sql: str | None = None):
    """Register ``fn(views) -> DataFrame`` under ``name``."""

    def register(fn: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql:
            ORACLES[name] = _with_views(sql)
        return fn

    return register


# Added before rounding on both sides so that exact ties fall the same way in both engines.
_TIE = 1.3e-9


def r6(expr: str, digits: int = 6) -> str:
    """SQL text: ``expr`` rounded to ``digits``, negative zero turned into zero."""
    value = f"(CAST({expr} AS DOUBLE) + {_TIE:.2e}::DOUBLE)"
    return (f"CASE WHEN abs({value}) < {0.5 * 10 ** -digits:.9f} THEN 0.0::DOUBLE "
            f"ELSE round({value}, {digits}) END")


def rd(col: Column | str, digits: int = 6) -> Column:
    """Spark side of ``r6``."""
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col.cast("double") + F.lit(_TIE), digits)
