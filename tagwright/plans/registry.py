"""Registry of named queries and their DuckDB oracle SQL.

Every query reads whole driver tables (or relations Spark derives from them);
every computed column is aliased identically on both sides, and floating
values are rounded to 6 places on both sides so that the order-free value hash
does not depend on the summation order of either engine.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}

from .. import defaults as _D

SEED = _D.SEED
DIGITS = 6


def register(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` (with its oracle SQL).
    The registered callable first makes the package importable on the
    executors' Python workers."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from ..session import ship_package

            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def r6(c):
    """Round to 6 places; ``+ 0.0`` turns a rounded ``-0.0`` into ``0.0``."""
    return F.round(c.cast("double") if not isinstance(c, str) else F.col(c).cast("double"), DIGITS) + F.lit(0.0)


def s6(expr: str) -> str:
    return f"(round(CAST({expr} AS DOUBLE), {DIGITS}) + 0.0)"
