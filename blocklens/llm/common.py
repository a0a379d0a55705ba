"""What the training-data operators share: white space, words, row packing and table access."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: white space of the word rules, as a regular expression class and as the characters themselves
SPACE = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; ``sql`` is the equivalent DuckDB statement."""
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text, null counted as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """Words of a text as an array; empty for a text without any."""
    bare = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACE}]+"))


def packed(df: DataFrame, name: str = "row_") -> DataFrame:
    """All columns of ``df`` inside one struct, so that no working name can clash with them."""
    return df.select(F.struct(*[df[c] for c in df.columns]).alias(name))


def unpacked(df: DataFrame, columns: list[str], name: str = "row_", without: tuple[str, ...] = ()) -> list[Column]:
    """The packed columns again, but for those that an operator's own result replaces."""
    return [F.col(f"{name}.`{c}`").alias(c) for c in columns if c not in without]


#: rows of a table of a few numbers per group that may be broadcast: some megabytes
SMALL_ROWS = 50_000


def small_side(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df``, a materialised table of narrow rows, broadcast if a count finds it small enough; otherwise the join is left to Spark."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: narrow rows of a partition, and the partitions a table is left at least
PART_ROWS, LEAST_PARTS = 1 << 17, 8


def in_few(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which has ``rows`` narrow rows at most, in no more partitions than they need; every partition costs files in each shuffle behind it."""
    return df.coalesce(max(LEAST_PARTS, -(-rows // PART_ROWS)))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
