"""Registration of queries with the SQL that says what they return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, folder) under its name; without SQL it is held against fixtures only."""

    def keep(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return keep


def seconds(column: str = "ts"):
    """A zoneless timestamp as seconds since 1970."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})") / 1e6


def sql_map(values: dict, key: str, default) -> str:
    """A constant table as a CASE expression."""
    quote = lambda x: f"'{x}'" if isinstance(x, str) else str(x)
    return f"CASE {key} " + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in values.items()) + f" ELSE {quote(default)} END"
