"""Registry of named, checkable queries.

Each entry is a builder ``(spark, sf_dir) -> DataFrame`` over the driver tables
and, when the result is expressible in SQL, an equivalent DuckDB query used as
an oracle.  Builders run over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from ..session import ship_package
            ship_package(spark)          # executors import feedrank for mapInPandas stages
            return fn(spark, sf_dir)

        run.__name__ = run.__qualname__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco
