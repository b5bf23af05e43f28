"""Query keys with their Spark callable and, where SQL can say the same, the check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspur.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECK_SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register ``plan(tables) -> DataFrame`` under ``key``."""

    def register(plan: Callable[[Tables], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = lambda spark, folder: plan(Tables(spark, folder))
        if sql is not None:
            CHECK_SQL[key] = sql
        return plan

    return register
