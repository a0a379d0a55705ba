"""Connected components of a link table, by alternating large and small stars; nothing is collected."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blocklens.llm.common import in_few
from blocklens.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: longs) to (node, root), the root being the smallest node reached; nodes without links are not in it.

    Every round links a node's larger neighbours, then its smaller ones, to the smallest of them; the number of links never
    grows and rounds are logarithmic in the number of nodes. A hub's links are aggregated before they move. What a round sends and writes
    lies in as many files as its links need, not in as many as the session has shuffle partitions.
    """
    edges = cut_lineage(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(edges)
    while state[0]:
        few = partial(in_few, rows=2 * state[0])
        edges = few(edges)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = few(few(both.filter("v > u").join(low, "u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = few(large.join(least, "u").filter("v > m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            few(least).select("u", F.col("m").alias("v"))).distinct()
        edges = cut_lineage(few(small))
        before, state = state, _state(edges)
        if before == state:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    """Count and order-free checksum of the links."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
