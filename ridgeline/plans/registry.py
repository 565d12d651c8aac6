"""Where plans register themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def r6(column, name: str | None = None):
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, 6).alias(name or column)


def r6_binary(c: Column) -> Column:
    """c to six digits as DuckDB rounds a double: the scaled binary value, so 0.0640625, a little less there, goes down."""
    return F.round(c * 1e6) / 1e6


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")
