"""Query registry: name -> Spark callable, and the check SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c: str | Column, alias: str | None = None) -> Column:
    """A double rounded for comparison; + 0 turns -0.0 into 0.0."""
    name = alias or c
    c = F.col(c) if isinstance(c, str) else c
    return (F.round(c.cast("double"), 6) + F.lit(0.0)).alias(name)


def s6(expr: str, alias: str) -> str:
    return f"round(({expr})::DOUBLE, 6) + 0.0::DOUBLE AS {alias}"
