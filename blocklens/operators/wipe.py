"""Wipe verification over a post-wipe sector table (SAN-1..5) and hidden areas (HLT-2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blocklens.functions import rules
from blocklens.operators import byte_stats, slices
from blocklens.session import cut_lineage


def deterministic_check(sectors: DataFrame, wanted: DataFrame, totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SAN-1: listed blocks inside the medium must be uniform; an unreadable one is a mismatch.

    ``sectors`` holds readable blocks only, ``totals`` gives ``total_blocks``.
    """
    listed = wanted.select(*keys, "lba").distinct().join(totals, list(keys)).where(
        (F.col("lba") >= 0) & (F.col("lba") < F.col("total_blocks")))
    tested = sectors.select(*keys, "lba", byte_stats.is_uniform().alias("uniform"))
    j = listed.join(tested, [*keys, "lba"], "left")
    ok = F.coalesce("uniform", F.lit(False))
    got = j.groupBy(*keys).agg(F.count_if(ok).alias("matches"), F.count_if(~ok).alias("mismatches"))
    out = totals.select(*keys).join(got, list(keys), "left").na.fill(0, ["matches", "mismatches"])
    return out.withColumn("passed", (F.col("matches") >= 1) & (F.col("mismatches") == 0))


def statistical_check(sectors: DataFrame, totals: DataFrame, keys: Sequence[str], confidence: float = 0.95,
                      defect_rate: float = 0.01, seed: int = 7) -> DataFrame:
    """SAN-3: the n blocks with the smallest seeded hash; all must be uniform.

    n is at most 50 000 per medium. The hash is uniform, so the n smallest lie below
    ``(n + 8 sqrt(n) + 40) / N`` of its range but for a chance far under 1e-12; that filter
    runs in the scan and only its survivors, about n per medium, are tested, moved and ranked.
    A medium of which it keeps fewer than n (unlucky hashes, or absent blocks) is ranked whole,
    so the sample is the n smallest of what can be read in every case. The media are a short
    table next to their blocks: counted, then broadcast, so that no medium's blocks meet in a task.
    """
    keys = list(keys)
    need = cut_lineage(totals.withColumn("sample_size", rules.required_sample_size(F.col("total_blocks"), confidence, defect_rate)))
    n = F.col("sample_size")
    limit = (n + 8 * F.sqrt(n) + 40) / F.col("total_blocks") * 2.0 ** 64 - 2.0 ** 63
    h = F.xxhash64(*keys, F.col("lba"), F.lit(seed))
    tested = [*keys, "lba", "sample_size", "_h", byte_stats.is_uniform().alias("_uniform")]
    hashed = sectors.select(*keys, "lba", "payload", h.alias("_h"))
    near = cut_lineage(hashed.join(slices.few(need.select(*keys, "sample_size", limit.alias("_limit"))), keys)
                       .where(F.col("_h") <= F.col("_limit")).select(*tested))
    held = near.groupBy(*keys).agg(F.count(F.lit(1)).alias("_held"))
    short = cut_lineage(need.join(held, keys, "left").where(F.coalesce("_held", F.lit(0)) < n).select(*keys, "sample_size"))
    if not short.isEmpty():
        whole = hashed.join(slices.few(short), keys).select(*tested)
        near = near.join(slices.few(short.select(*keys)), keys, "left_anti").unionByName(whole)
    order = Window.partitionBy(*keys).orderBy("_h", "lba")
    picked = near.withColumn("_r", F.row_number().over(order)).where("_r <= sample_size")
    found = picked.groupBy(*keys).agg(F.count(F.lit(1)).alias("sampled"), F.count_if(~F.col("_uniform")).alias("non_conforming"))
    out = need.join(found, keys, "left").na.fill(0, ["sampled", "non_conforming"])
    # blocks of the sample that could not be read count as non-conforming
    return (out.withColumn("non_conforming", F.col("non_conforming") + F.col("sample_size") - F.col("sampled"))
            .withColumn("passed", (F.col("sample_size") > 0) & (F.col("non_conforming") == 0)))


def recovery_check(artifacts: DataFrame, totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SAN-4: a medium passes when carving (tiers 2 and 3, radius 64) found nothing on it."""
    found = artifacts.groupBy(*keys).agg(F.count(F.lit(1)).alias("recovered"))
    return (totals.select(*keys).join(found, list(keys), "left").na.fill(0, ["recovered"])
            .withColumn("passed", F.col("recovered") == 0))


def overall_assurance(layers: DataFrame) -> DataFrame:
    """SAN-5: one row per device with ``l1..l5`` booleans, ``media_type`` and ``method``."""
    c = F.col
    return layers.withColumn("assurance", rules.overall_assurance(
        c("l1"), c("l2"), c("l3"), c("l4"), c("l5"), c("media_type"), c("method")))


def hidden_area(inventory: DataFrame) -> DataFrame:
    """HLT-2: devices with a hidden area, and its size in sectors."""
    hidden = F.greatest(F.col("native_max_lba") - F.col("user_max_lba"), F.lit(0))
    return (inventory.where(F.col("hpa_detected") | F.col("dco_detected"))
            .withColumn("hidden_sectors", hidden.cast("bigint")))
