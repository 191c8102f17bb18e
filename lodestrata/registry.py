"""Named queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, directory) -> DataFrame under its name, with its SQL if there is one."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def sql_id(c: str) -> str:
    """An id in SQL, as lodestrata.session.norm_id."""
    return f"nullif(lower(trim({c}, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))), '')"
