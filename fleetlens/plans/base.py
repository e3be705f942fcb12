"""Query registry primitives: one Spark plan per operator, plus its DuckDB oracle.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name] -> SQL``.
Outputs are canonical for comparison: doubles rounded to 6 digits, dates as
ISO strings; the SQL side rounds and casts the same way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DIGITS = 6


def half_away_round(c, digits: int = DIGITS):
    """round(x * 10^d) / 10^d with ties away from zero, on the binary double
    (the oracle engine's ROUND).  ``F.round`` rounds the shortest decimal
    string half-up instead, which disagrees on exact decimal ties such as
    averages of two-decimal values over 2^k rows."""
    m = F.lit(float(10 ** digits))
    y = c.cast("double") * m
    r = F.when(y >= 0, F.floor(y + F.lit(0.5))).otherwise(-F.floor(-y + F.lit(0.5)))
    return F.when(c.isNull() | F.isnan(c) | (F.abs(y) > F.lit(9.0e18)), c.cast("double")).otherwise(
        r.cast("double") / m)


def canon(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round doubles/floats, render dates and timestamps as text."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = half_away_round(c, digits)
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return canon(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r(expr: str, digits: int = DIGITS) -> str:
    """SQL rounding helper for oracle text."""
    return f"ROUND({expr}, {digits})"
