"""Acquisition plans, manifests and integrity (ACQ-1, 3..8, JN-12, SRC-2)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blocklens.operators import filters, ranges

PLACEHOLDER = b"UNREADABLE_BLOCK"


def profile_bounds(plan: DataFrame) -> DataFrame:
    """SRC-2: whole medium, or the wanted range with its end clamped to the last block."""
    whole = F.col("kind") == "Physical"
    last = F.col("total_blocks") - 1
    return (plan.withColumn("start_lba", F.when(whole, F.lit(0).cast("bigint")).otherwise(F.col("want_start")))
            .withColumn("end_lba", F.when(whole, last).otherwise(F.least("want_end", last))))


def chunk_plan(images: DataFrame, keys: Sequence[str], size: int = 128) -> DataFrame:
    """ACQ-1: consecutive chunks over ``start_lba..end_lba`` (default the whole image)."""
    cols = images.columns
    lo = F.col("start_lba") if "start_lba" in cols else F.lit(0).cast("bigint")
    hi = F.col("end_lba") if "end_lba" in cols else F.col("total_blocks") - 1
    base = images.select(*keys, lo.alias("_lo"), hi.alias("_hi")).where("_hi >= _lo")
    return (base.select(*keys, "_lo", "_hi", F.posexplode(F.sequence("_lo", "_hi", F.lit(size).cast("bigint")))
                        .alias("chunk_no", "start_lba"))
            .withColumn("chunk_no", F.col("chunk_no").cast("bigint"))
            .withColumn("block_count", F.least(F.lit(size).cast("bigint"), F.col("_hi") - F.col("start_lba") + 1))
            .drop("_lo", "_hi"))


def fill_placeholder(sectors: DataFrame, bad_ranges: DataFrame, keys: Sequence[str], pattern: bytes = PLACEHOLDER,
                     block_size: int = 512) -> DataFrame:
    """ACQ-3: unreadable blocks hold the repeated pattern (zeros when the pattern is empty)."""
    fill = (pattern or b"\0") * (block_size // len(pattern or b"\0") + 1)
    hit = ranges.points_in_ranges(sectors.select(*keys, "lba"), bad_ranges.select(*keys, "start_lba", "block_count"),
                                  keys, "left_semi").distinct().withColumn("_bad", F.lit(True))
    return (sectors.join(hit, [*keys, "lba"], "left")
            .withColumn("payload", F.when(F.col("_bad"), F.lit(fill[:block_size])).otherwise(F.col("payload")))
            .drop("_bad"))


def dual_hash_report(images: DataFrame) -> DataFrame:
    """ACQ-4."""
    status = (F.when(F.col("verification_hash").isNull(), "MISSING")
              .when(F.lower("acquisition_hash") == F.lower("verification_hash"), "MATCH").otherwise("MISMATCH"))
    return images.withColumn("hash_status", status)


def chunk_manifest(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scalable digest of an image: one SHA-256 per chunk."""
    return chunks.select(*keys, "chunk_no", F.sha2("payload", 256).alias("chunk_hash"))


def manifest_diff(acquired: DataFrame, reread: DataFrame, keys: Sequence[str]) -> DataFrame:
    """JN-12: chunks that differ or exist on one side only."""
    on = [*keys, "chunk_no"]
    both = (acquired.select(*on, F.lower("chunk_hash").alias("acquired_hash"))
            .join(reread.select(*on, F.lower("chunk_hash").alias("reread_hash")), on, "full_outer"))
    status = (F.when(F.col("acquired_hash").isNull(), "missing_in_acquired")
              .when(F.col("reread_hash").isNull(), "missing_in_reread").otherwise("mismatch"))
    return both.where(~F.col("acquired_hash").eqNullSafe(F.col("reread_hash"))).withColumn("status", status)


def image_digest(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """ACQ-5: SHA-256 of each whole image.

    The digest of one image is a sequential fold by definition. Rows are range-sorted by
    (image, chunk) and stream through ``mapInPandas``, so memory stays at one Arrow batch
    however long the image is; images run in parallel. Use ``chunk_manifest`` where a
    splittable digest will do.
    """
    keys = list(keys)
    typed = {f.name: f.dataType.simpleString() for f in chunks.schema.fields}
    schema = ", ".join(f"{k} {typed[k]}" for k in keys) + ", bytes bigint, image_hash string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, digest, size = None, None, 0
        for pdf in batches:
            done = []
            for row in pdf.itertuples(index=False):
                key = tuple(row[:-1])
                if key != current:
                    if current is not None:
                        done.append((*current, size, digest.hexdigest()))
                    current, digest, size = key, hashlib.sha256(), 0
                digest.update(row[-1])
                size += len(row[-1])
            if done:
                yield pd.DataFrame(done, columns=[*keys, "bytes", "image_hash"])
        if current is not None:
            yield pd.DataFrame([(*current, size, digest.hexdigest())], columns=[*keys, "bytes", "image_hash"])

    return (chunks.select(*keys, "chunk_no", "payload").repartition(*keys)
            .sortWithinPartitions(*keys, "chunk_no").select(*keys, "payload").mapInPandas(run, schema))


def percent_done(current: Column, total: Column) -> Column:
    share = current * 100.0 / total
    return F.when(total == 0, 0.0).when(share > 100.0, 100.0).otherwise(share)


def progress(operations: DataFrame) -> DataFrame:
    """ACQ-6: percent from the stored checkpoint; 0 for an empty total, null without one."""
    got = filters.with_checkpoint(operations)
    c = F.col("checkpoint")
    return got.withColumn("percent", percent_done(c["current_lba"], c["total_blocks"]))


def preflight(plan: DataFrame, volumes: DataFrame, block_size: int = 512) -> DataFrame:
    """ACQ-7: is there room on the target volume?"""
    joined = plan.join(volumes, "volume_id", "left")
    need = F.col("blocks") * F.lit(block_size).cast("bigint")
    return (joined.withColumn("required_bytes", need)
            .withColumn("accepted", F.coalesce(F.col("available_bytes") >= need, F.lit(False))))


def resume_check(checkpoints: DataFrame, devices: DataFrame) -> DataFrame:
    """ACQ-8: a resumed source must still have the stored fingerprint."""
    return (checkpoints.join(devices, "device_id", "left")
            .withColumn("may_resume", F.coalesce(
                F.lower("source_fingerprint") == F.lower("current_fingerprint"), F.lit(False))))
