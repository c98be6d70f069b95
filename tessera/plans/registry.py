"""Queries and the SQL that gives the same rows, registered side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def r4(c: Column | str, name: str | None = None) -> Column:
    """Rounded to four places, as both engines round alike."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 4).alias(name or c)
