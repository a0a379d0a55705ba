"""Exact deduplication with a heavy-hitter split.

Every text becomes the SHA-256 of its normalised form, and the narrow (doc_id, digest) rows are written once. Misra-Gries counters
find the digests that may hold more than a share 2 / (k + 1) of all rows: each task keeps k counters, the merged counters are cut
to k again. An exact count verifies those candidates; their winners, k rows and a few of equal prefix at most, are broadcast and their
copies are settled without moving. All other groups hold less than that share and are shuffled by digest.

Defined results: a null text is empty; of equal texts the smallest doc_id stays, null ids last; among rows that repeat that doc_id one
stays; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blocklens.llm.common import SPACE, query, table, text_of
from blocklens.session import cut_lineage

COUNTERS = 1024


def digest_of(text: str = "text"):
    return F.unhex(F.sha2(F.regexp_replace(text_of(text), f"[{SPACE}]+", " "), 256))


def reduce_counters(keys: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Misra-Gries cut: sum equal keys, then subtract the (k + 1)-th largest count from all."""
    keys, at = np.unique(keys, return_inverse=True)
    counts = np.bincount(at, weights=counts, minlength=len(keys)).astype(np.int64)
    if len(keys) > k:
        counts = counts - np.partition(counts, len(counts) - k - 1)[len(counts) - k - 1]
        keys, counts = keys[counts > 0], counts[counts > 0]
    return keys, counts


def _counters(k: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            if batch.num_rows:
                more = np.asarray(batch.column(0))
                keys, counts = reduce_counters(np.concatenate([keys, more]), np.concatenate([counts, np.ones(len(more), np.int64)]), k)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["prefix", "seen"])
    return count


def heavy_candidates(digests: DataFrame, k: int = COUNTERS) -> DataFrame:
    """Prefixes of all digests that hold over 2 / (k + 1) of the rows, and some others; k rows at most."""
    prefix = F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long").alias("prefix")
    each = digests.select(prefix).mapInArrow(_counters(k), "prefix long, seen long")
    return each.groupBy("prefix").agg(F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "prefix").limit(k).select("prefix")


def assign(docs: DataFrame, k: int = COUNTERS) -> DataFrame:
    """One row per document: doc_id, digest, keep_id, group_size, kept."""
    digests = cut_lineage(docs.select("doc_id", digest_of().alias("digest")))
    prefix = F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long")
    candidates = cut_lineage(heavy_candidates(digests, k))
    # at most k prefixes: a bounded broadcast
    winners = cut_lineage(digests.withColumn("prefix", prefix).join(F.broadcast(candidates), "prefix", "left_semi")
                          .groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
                          .filter("group_size > 1"))
    heavy = digests.join(F.broadcast(winners), "digest")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    first = Window.partitionBy("digest").orderBy(F.lit(1))
    columns = ["doc_id", "digest", "keep_id", "group_size", "kept"]
    settled = heavy.filter(~stays).withColumn("kept", F.lit(False)).select(*columns).unionByName(
        heavy.filter(stays).withColumn("kept", F.row_number().over(first) == 1).select(*columns))
    group = Window.partitionBy("digest")
    rest = digests.join(F.broadcast(winners.select("digest")), "digest", "left_anti").select(
        "doc_id", "digest", F.min("doc_id").over(group).alias("keep_id"), F.count("*").over(group).alias("group_size"),
        (F.row_number().over(group.orderBy(F.col("doc_id").asc_nulls_last())) == 1).alias("kept"))
    return settled.unionByName(rest)


def drop_copies(docs: DataFrame, k: int = COUNTERS) -> DataFrame:
    """The documents that stay, with all their columns."""
    kept = assign(docs, k).filter("kept").select(F.col("doc_id").alias("doc_id_k"), F.col("digest").alias("digest_k"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row_"), F.col("doc_id").alias("id_"), digest_of().alias("digest_"))
    met = rows.join(kept, F.col("id_").eqNullSafe(F.col("doc_id_k")) & (F.col("digest_") == F.col("digest_k")), "left_semi")
    return met.dropDuplicates(["id_", "digest_"]).select(*[F.col(f"row_.`{c}`").alias(c) for c in docs.columns])


SQL = """WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)"""


@query("op7_exact_dedup", SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assign(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
