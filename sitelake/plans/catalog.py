"""Registry of named queries and their oracle statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sitelake.plans.inputs import load, oracle

Query = Callable[[SparkSession, str], DataFrame]
Source = Callable[[str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Callable[[Source], DataFrame]], Query]:
    """Register ``fn(source)``, where ``source(name)`` loads a table or a derived input."""

    def register(fn: Callable[[Source], DataFrame]) -> Query:
        key = name or fn.__name__

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(lambda table: load(spark, folder, table))

        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = oracle(sql)
        return run

    return register
