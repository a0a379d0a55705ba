"""Range joins and islands over block numbers (JN-2, JN-3, JN-4, ACQ-2, FSC-2, RPT-11).

An extent is ``[start_lba, start_lba + block_count)``. Spark would run an inequality join
as a nested loop, so every range join here is an equi-join on ``(keys, lba div WIDTH)``
with the inequality as a residual condition. An extent yields one row per bucket it
touches: at most one extra row per ``WIDTH`` blocks of media.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blocklens.operators import slices

WIDTH = 4096
ISLAND_SLICE = 1 << 16


def _bucketed(extents: DataFrame, start: str, count: str, width: int, name: str) -> DataFrame:
    first = slices.idiv(F.col(start), width)
    last = slices.idiv(F.col(start) + F.col(count) - 1, width)
    return (extents.where(F.col(count) > 0)
            .withColumn(name, F.explode(F.sequence(first, last))))


def points_in_ranges(points: DataFrame, extents: DataFrame, keys: Sequence[str], how: str,
                     lba: str = "lba", start: str = "start_lba", count: str = "block_count",
                     width: int = WIDTH) -> DataFrame:
    """JN-2 (left_anti) and JN-4 (left_semi): membership of a block in any extent.

    ``how`` may also be inner or left, then the extent's other columns come along.
    """
    right = _bucketed(extents, start, count, width, "_b")
    ren = {k: f"_r_{k}" for k in keys}
    right = right.withColumnsRenamed({**ren, start: "_s", count: "_c"})
    left = points.withColumn("_pb", slices.idiv(F.col(lba), width))
    cond = F.col("_pb") == F.col("_b")
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_r_{k}"))
    cond = cond & (F.col(lba) >= F.col("_s")) & (F.col(lba) < F.col("_s") + F.col("_c"))
    out = left.join(right, cond, how).drop("_pb")
    if how in ("left_semi", "left_anti"):
        return out
    return out.drop("_b", *ren.values()).withColumnsRenamed({"_s": f"hit_{start}", "_c": f"hit_{count}"})


def overlap_pairs(a: DataFrame, b: DataFrame, keys: Sequence[str], a_range=("a_start", "a_count"),
                  b_range=("b_start", "b_count"), width: int = WIDTH) -> DataFrame:
    """JN-3 inner: each overlapping pair once, in the bucket where the later one starts."""
    left = _bucketed(a, *a_range, width, "_ab")
    right = _bucketed(b, *b_range, width, "_bb").withColumnsRenamed({k: f"_r_{k}" for k in keys})
    a_s, a_c = (F.col(c) for c in a_range)
    b_s, b_c = (F.col(c) for c in b_range)
    cond = (F.col("_ab") == F.col("_bb"))
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_r_{k}"))
    cond = (cond & (a_s < b_s + b_c) & (a_s + a_c > b_s)
            & (slices.idiv(F.greatest(a_s, b_s), width) == F.col("_ab")))
    return left.join(right, cond).drop("_ab", "_bb", *[f"_r_{k}" for k in keys])


def overlap_filter(a: DataFrame, b: DataFrame, keys: Sequence[str], row_id: Sequence[str],
                   keep_overlapping: bool, a_range=("start_lba", "block_count"),
                   b_range=("start_lba", "block_count"), width: int = WIDTH) -> DataFrame:
    """JN-3 semi / anti: rows of ``a`` that do (not) overlap any extent of ``b``."""
    left = _bucketed(a.select(*dict.fromkeys([*keys, *row_id, *a_range])), *a_range, width, "_ab")
    ren = {k: f"_r_{k}" for k in keys}
    right = (_bucketed(b.select(*keys, *b_range), *b_range, width, "_bb")
             .withColumnsRenamed({**ren, b_range[0]: "_bs", b_range[1]: "_bc"}))
    a_s, a_c = (F.col(c) for c in a_range)
    cond = F.col("_ab") == F.col("_bb")
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_r_{k}"))
    cond = cond & (a_s < F.col("_bs") + F.col("_bc")) & (a_s + a_c > F.col("_bs"))
    ids = list(dict.fromkeys([*keys, *row_id]))
    hits = left.join(right, cond, "left_semi").select(*ids).distinct()
    return a.join(hits, ids, "left_semi" if keep_overlapping else "left_anti")


def islands(rows: DataFrame, keys: Sequence[str], start: str = "lba", count: Column | None = None,
            extra: Sequence[Column] = ()) -> DataFrame:
    """Merge records that touch end to start into ranges (each tested against the one before)."""
    n = F.lit(1).cast("bigint") if count is None else count
    keys = list(keys)
    cut_rows = (rows.withColumn("_n", n).withColumn("_end", F.col(start) + F.col("_n"))
                .withColumn("_cut", slices.by_width(start, ISLAND_SLICE)))
    inside = Window.partitionBy(*keys, "_cut").orderBy(start)
    marked = cut_rows.withColumn("_pe", F.lag("_end").over(inside)).withColumn(
        "_new", (F.col("_pe").isNotNull() & (F.col("_pe") != F.col(start))).cast("bigint"))
    inner = marked.withColumn("_in", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # one row per slice: does its first record continue the last range of the slice before?
    over = Window.partitionBy(*keys).orderBy("_cut")
    heads = (inner.groupBy(*keys, "_cut").agg(F.min(start).alias("_s"), F.max_by("_end", start).alias("_e"), F.max("_in").alias("_t"))
             .withColumn("_opens", (~F.col("_s").eqNullSafe(F.lag("_e").over(over))).cast("bigint"))
             .withColumn("_off", F.col("_opens") + F.coalesce(F.sum(F.col("_opens") + F.col("_t")).over(
                 over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
             .select(*keys, "_cut", "_off"))
    numbered = inner.join(heads, [*keys, "_cut"]).withColumn("_island", F.col("_off") + F.col("_in"))
    return (numbered.groupBy(*keys, "_island")
            .agg(F.min(start).alias("start_lba"), F.sum("_n").alias("block_count"), *extra)
            .drop("_island"))


def merge_bad_ranges(bad_blocks: DataFrame, keys: Sequence[str], block_size: int = 512) -> DataFrame:
    """ACQ-2: unreadable blocks to ranges with the first error text and byte totals."""
    return islands(bad_blocks, keys, "lba", None,
                   [F.min_by("error", "lba").alias("error")]
                   ).withColumn("bytes", F.col("block_count") * F.lit(block_size).cast("bigint"))


def extents_from_clusters(chain: DataFrame, keys: Sequence[str], sectors_per_cluster: int = 1,
                          first_lba: int = 0) -> DataFrame:
    """FSC-2: consecutive cluster numbers, in chain order, merged to ``(start_lba, blocks)``."""
    cut = slices.by_width("pos", ISLAND_SLICE)
    prev = slices.previous_row(chain, keys, ["pos"], cut, {"_pc": "cluster"})
    flagged = prev.withColumn(
        "_new", F.when((F.col("_pc") + 1).eqNullSafe(F.col("cluster")), 0).otherwise(1).cast("bigint"))
    numbered = slices.running_total(flagged, keys, ["pos"], cut, F.col("_new"), "extent_no")
    spc = F.lit(sectors_per_cluster).cast("bigint")
    return (numbered.groupBy(*keys, "extent_no")
            .agg((F.lit(first_lba) + F.min("cluster") * spc).alias("start_lba"),
                 (F.count(F.lit(1)) * spc).alias("block_count")))


# RPT-11 paints by priority: unallocated 0, allocated 1, sanitized 2, artifact 3, bad sector 4
MAP_STATUS = ["unallocated", "allocated", "sanitized", "artifact", "bad_sector"]


def storage_map(totals: DataFrame, extents: DataFrame, keys: Sequence[str], n: int = 128) -> DataFrame:
    """RPT-11: ``n`` equal segments per image, each with its strongest overlapping status.

    An extent yields one row per segment it covers (at most ``n``), so the join is an
    equi-join on (keys, segment). ``extents`` carries ``kind``; blocks past the last
    segment (remainder of the division) belong to no segment.
    """
    per = F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("total_blocks") / n).cast("bigint"))
    grid = (totals.withColumn("_per", per)
            .withColumn("segment", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
            .withColumn("seg_start", F.col("segment") * F.col("_per"))
            .withColumn("seg_end", (F.col("segment") + 1) * F.col("_per") - 1))
    rank = F.create_map(*[x for i, s in enumerate(MAP_STATUS) for x in (F.lit(s), F.lit(i))])
    touched = (extents.where(F.col("block_count") > 0)
               .join(totals.withColumn("_per", per).select(*keys, "_per"), list(keys))
               .withColumn("_a", F.floor(F.col("start_lba") / F.col("_per")))
               .withColumn("_z", F.floor((F.col("start_lba") + F.col("block_count") - 1) / F.col("_per")))
               .where(F.col("_a") < n)
               .withColumn("segment", F.explode(F.sequence(
                   F.col("_a").cast("int"), F.least(F.col("_z"), F.lit(n - 1)).cast("int"))))
               .groupBy(*keys, "segment").agg(F.max(rank[F.col("kind")]).alias("_rank")))
    names = F.array(*[F.lit(s) for s in MAP_STATUS])
    return (grid.join(touched, [*keys, "segment"], "left")
            .withColumn("status", F.element_at(names, F.coalesce("_rank", F.lit(0)) + 1))
            .select(*keys, "segment", "seg_start", "seg_end", "status"))
