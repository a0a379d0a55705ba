"""Registry of the runnable queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; ``sql`` is the equivalent DuckDB statement."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c: str | Column, digits: int) -> Column:
    """A double to so many digits as SQL rounds it: the product with the power of ten, half away from zero.

    Spark's own ``round`` settles halves on the shortest decimal of the number: 41 / 640 is 0.064063 there and 0.064062 in SQL.
    """
    power = float(10 ** digits)
    return F.round((F.col(c) if isinstance(c, str) else c) * power) / power


def r6(c: str | Column) -> Column:
    return rounded(c, 6)


def r4(c: str | Column) -> Column:
    return rounded(c, 4)
