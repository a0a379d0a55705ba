"""Joins and iterations over decoded filesystem metadata (FSC-1, 3..9, JN-13, 15, 16)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blocklens.operators import ranges, slices
from blocklens.session import cut_lineage

# fixed values: change-journal reason bits
REASON_CREATE, REASON_DELETE = 0x00000100, 0x00000200
REASON_RENAME = 0x00001000 | 0x00002000
CONFIDENCE_ORDER = ["Low", "Reconstructed", "Partial", "Confirmed"]


def build_paths(dir_entries: DataFrame, roots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """FSC-1: path and depth of every entry reachable from its root, in about log2(depth) rounds of pointer doubling.

    ``dir_entries``: dir_id, entry_id, name, is_dir, unlinked. ``roots``: dir_id. A directory is entered once, through its shortest and
    then its first path, so cycles stop; an unlinked one is listed but not entered.

    A directory with one link has one way up; these ways are doubled, first as numbers, so that cycles are found and left out, then with their
    names. Roots and directories with several links are anchors, where a way ends; only anchors are compared with each other, in rounds
    that follow the longest row of such directories. The entries themselves are joined once.
    """
    keys = list(keys)
    tops = roots.select(*keys, F.col("dir_id").alias("_dir")).distinct()
    enter = cut_lineage(dir_entries.where("is_dir AND NOT unlinked").select(*keys, F.col("entry_id").alias("_dir"), F.col("dir_id").alias("_up"), "name").distinct()
                        .join(tops, [*keys, "_dir"], "left_anti"))
    many = enter.groupBy(*keys, "_dir").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys, "_dir")
    many = cut_lineage(many)
    anchors = cut_lineage(tops.unionByName(many))
    marks = slices.few(anchors).select(*keys, F.col("_dir").alias("_up"), F.lit(True).alias("_end"))
    single = cut_lineage(enter.join(slices.few(many), [*keys, "_dir"], "left_anti").join(marks, [*keys, "_up"], "left").select(
        *keys, "_dir", "_up", F.concat(F.lit("/"), "name").alias("_piece"), F.lit(1).alias("_d"), F.coalesce("_end", F.lit(False)).alias("_end")))
    ends = _doubled(single.drop("_piece", "_d"), keys, single.count())
    ways = _doubled(single.join(ends.select(*keys, "_dir"), [*keys, "_dir"], "left_semi"), keys)
    # what an anchor's way up passes before the next anchor
    over = enter.join(slices.few(many), [*keys, "_dir"], "left_semi").select(*keys, "_dir", F.col("_up").alias("_via"), "name")
    known = ways.select(*keys, F.col("_dir").alias("_via"), "_up", "_piece", "_d").unionByName(
        anchors.select(*keys, F.col("_dir").alias("_via"), F.col("_dir").alias("_up"), F.lit("").alias("_piece"), F.lit(0).alias("_d")))
    steps = cut_lineage(over.join(known, [*keys, "_via"]).select(*keys, "_dir", "_up", F.concat("_piece", F.lit("/"), "name").alias("_piece"), (F.col("_d") + 1).alias("_d")))
    best = cut_lineage(tops.withColumn("_best", F.struct(F.lit(0).alias("depth"), F.lit("").alias("path"))))
    while True:
        more = steps.join(best.select(*keys, F.col("_dir").alias("_up"), "_best"), [*keys, "_up"]).select(*keys, "_dir", F.struct(
            (F.col("_best.depth") + F.col("_d")).alias("depth"), F.concat("_best.path", "_piece").alias("path")).alias("_best"))
        now = cut_lineage(best.unionByName(more).groupBy(*keys, "_dir").agg(F.min("_best").alias("_best")))
        if now.join(best, [*keys, "_dir", "_best"], "left_anti").isEmpty():
            break
        best = now
    at = best.select(*keys, F.col("_dir").alias("_up"), "_best")
    below = ways.join(at, [*keys, "_up"]).select(*keys, F.col("_dir").alias("dir_id"), F.concat("_best.path", "_piece").alias("_path"), (F.col("_best.depth") + F.col("_d")).alias("_d"))
    dirs = below.unionByName(best.select(*keys, F.col("_dir").alias("dir_id"), F.col("_best.path").alias("_path"), F.col("_best.depth").alias("_d")))
    return dir_entries.join(dirs, [*keys, "dir_id"]).select(*keys, "entry_id", "name", "is_dir", "unlinked", F.concat("_path", F.lit("/"), "name").alias("path"), (F.col("_d") + 1).alias("depth"))


def _doubled(ways: DataFrame, keys: Sequence[str], longest: int | None = None) -> DataFrame:
    """``ways`` (keys, _dir, _up, _end, and _piece, _d if there) followed until they end; what still goes on after ``longest`` steps is a cycle."""
    done, now, steps = ways.where("_end"), ways, 1
    named = "_piece" in ways.columns
    while True:
        open_ = now.where("NOT _end")
        if open_.isEmpty() or (longest is not None and steps > longest):
            return done
        ahead = now.select(*keys, F.col("_dir").alias("_up"), F.col("_up").alias("_far"), F.col("_end").alias("_stop"),
                           *([F.col("_piece").alias("_before"), F.col("_d").alias("_more")] if named else []))
        # ways that end are met by others in every round, so they stay in the table
        met = open_.drop("_end").join(ahead, [*keys, "_up"]).select(*keys, "_dir", F.col("_far").alias("_up"), F.col("_stop").alias("_end"),
                                                                     *([F.concat("_before", "_piece").alias("_piece"), (F.col("_d") + F.col("_more")).alias("_d")] if named else []))
        met = cut_lineage(met)
        done = done.unionByName(met.where("_end").select(*done.columns))
        now, steps = cut_lineage(now.where("_end").unionByName(met.select(*now.columns))), steps * 2


def follow_chain(table: DataFrame, starts: DataFrame, total: Column | int, keys: Sequence[str], first: int = 2) -> DataFrame:
    """FSC-3: ordered clusters of each start by pointer doubling, about log2(longest chain) joins.

    ``table``: cluster, next (null or 0 ends a chain); ``starts``: file_id, start. Gives
    file_id, pos, cluster, looped, out_of_range. A start below ``first`` has no chain; the
    start itself is always part of it. ``total`` bounds valid numbers to ``first + total``.
    """
    keys = list(keys)
    top = F.lit(total) if isinstance(total, int) else total
    links = table.where(F.col("next").isNotNull() & (F.col("next") != 0)).withColumn(
        "_valid", (F.col("next") >= first) & (F.col("next") < top + first))
    wild = links.where("NOT _valid").select(*keys, "cluster").distinct().withColumn("out_of_range", F.lit(True))
    jump = cut_lineage(links.where("_valid").select(*keys, "cluster", F.col("next").alias("_to")))
    rows = cut_lineage(starts.where(F.col("start") >= first).select(
        *keys, "file_id", F.lit(0).cast("bigint").alias("pos"), F.col("start").alias("cluster"), F.lit(False).alias("looped")))
    step = 1
    while True:
        more = (rows.where("NOT looped").join(jump, [*keys, "cluster"])
                .select(*keys, "file_id", (F.col("pos") + step).alias("pos"), F.col("_to").alias("cluster"), "looped"))
        both = cut_lineage(rows.unionByName(more).groupBy(*keys, "file_id", "cluster")
                           .agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("_n"), F.bool_or("looped").alias("looped")))
        loops = both.where("_n > 1").select(*keys, "file_id").distinct().withColumn("_loop", F.lit(True))
        grown = cut_lineage(both.join(loops, [*keys, "file_id"], "left").select(
            *keys, "file_id", "pos", "cluster", (F.col("looped") | F.coalesce("_loop", F.lit(False))).alias("looped")))
        if more.isEmpty():
            return grown.join(wild, [*keys, "cluster"], "left").withColumn(
                "out_of_range", F.coalesce("out_of_range", F.lit(False)))
        rows, step = grown, step * 2
        nxt = jump.select(*keys, F.col("cluster").alias("_to"), F.col("_to").alias("_far"))
        jump = cut_lineage(jump.join(nxt, [*keys, "_to"]).select(*keys, "cluster", F.col("_far").alias("_to")))


def deleted_extents(entries: DataFrame, fat: DataFrame, volumes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """FSC-4: clusters of deleted entries and their confidence.

    The chain is used while the table still links the start cluster; a zeroed start falls
    back to the contiguous run the size calls for, cut at the end of the volume.
    ``volumes``: cluster_bytes, total_clusters. ``fat``: cluster, next (0 means free).
    """
    keys = list(keys)
    e = entries.where("start_cluster >= 2").join(volumes, keys)
    head = fat.select(*keys, F.col("cluster").alias("start_cluster"), (F.col("next") != 0).alias("_linked"))
    e = e.join(head, [*keys, "start_cluster"], "left").withColumn("_linked", F.coalesce("_linked", F.lit(False)))
    linked = e.where("_linked").select(*keys, F.col("entry_id").alias("file_id"), F.col("start_cluster").alias("start"))
    chains = follow_chain(fat.join(volumes, keys), linked, F.col("total_clusters"), keys).select(
        *keys, F.col("file_id").alias("entry_id"), "pos", "cluster")
    need = F.greatest(F.ceil(F.col("size") / F.col("cluster_bytes")), F.lit(1))
    last = F.least(F.col("start_cluster") + need - 1, F.col("total_clusters") + 1)
    runs = (e.where("NOT _linked").where(last >= F.col("start_cluster"))
            .select(*keys, "entry_id", "start_cluster", last.alias("_last"))
            # in pieces, so that no row holds all clusters of a large file
            .withColumn("_from", F.explode(F.sequence("start_cluster", "_last", F.lit(4096).cast("bigint"))))
            .withColumn("cluster", F.explode(F.sequence("_from", F.least(F.col("_from") + 4095, F.col("_last")))))
            .select(*keys, "entry_id", (F.col("cluster") - F.col("start_cluster")).alias("pos"), "cluster"))
    every = chains.unionByName(runs)
    free = fat.where("next = 0").select(*keys, "cluster").withColumn("_free", F.lit(True))
    return every.join(free, [*keys, "cluster"], "left").withColumn("is_free", F.coalesce("_free", F.lit(False))).drop("_free")


def deleted_confidence(clusters: DataFrame, keys: Sequence[str], entries: DataFrame | None = None) -> DataFrame:
    """Clusters and confidence per entry; with ``entries`` also of those without a cluster.

    An entry without clusters (start below 2, or past the volume) is Confirmed if it is empty, else Low.
    """
    found = clusters.groupBy(*keys, "entry_id").agg(
        F.count(F.lit(1)).alias("clusters"),
        F.when(F.bool_and("is_free"), "Confirmed").otherwise("Partial").alias("confidence"))
    if entries is None:
        return found
    none = F.when(F.col("size") == 0, "Confirmed").otherwise("Low")
    return (entries.select(*keys, "entry_id", "size").join(found, [*keys, "entry_id"], "left")
            .select(*keys, "entry_id", F.coalesce("clusters", F.lit(0).cast("bigint")).alias("clusters"), F.coalesce("confidence", none).alias("confidence")))


def free_runs(bitmap: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Free clusters of an allocation bitmap as runs."""
    return ranges.islands(bitmap.where("is_free").select(*keys, F.col("cluster").alias("lba")), keys)


def entry_allocation(entries: DataFrame, bitmap: DataFrame, keys: Sequence[str], sectors_per_cluster: int = 1,
                     first_lba: int = 0) -> DataFrame:
    """JN-13: share of an entry's clusters that the bitmap calls free.

    Extents meet free runs in an overlap join, so nothing is exploded to clusters. Clusters
    outside the bitmap are not free.
    """
    keys = list(keys)
    x = (entries.select(*keys, "entry_id", F.posexplode("extents").alias("_no", "_x"))
         .withColumn("_s", F.floor(F.greatest(F.col("_x.start_lba") - first_lba, F.lit(0)) / sectors_per_cluster).cast("bigint"))
         .withColumn("_c", F.ceil(F.col("_x.block_count") / sectors_per_cluster).cast("bigint")).drop("_x"))
    runs = free_runs(bitmap, keys).select(*keys, F.col("start_lba").alias("_fs"), F.col("block_count").alias("_fc"))
    hit = ranges.overlap_pairs(x, runs, keys, ("_s", "_c"), ("_fs", "_fc"))
    inside = F.least(F.col("_s") + F.col("_c"), F.col("_fs") + F.col("_fc")) - F.greatest("_s", "_fs")
    free = hit.groupBy(*keys, "entry_id").agg(F.sum(inside).alias("free_clusters"))
    total = x.groupBy(*keys, "entry_id").agg(F.sum("_c").alias("clusters"))
    out = (entries.join(total, [*keys, "entry_id"], "left").join(free, [*keys, "entry_id"], "left")
           .na.fill(0, ["clusters", "free_clusters"]))
    return out.withColumn("allocation", F.when(F.col("clusters") == 0, "Low").when(F.col("free_clusters") == F.col("clusters"), "Confirmed")
                          .when(F.col("free_clusters") > 0, "Partial").otherwise("Low"))


def entry_confidence(entries: DataFrame) -> DataFrame:
    """FSC-5: reads ``kind``, ``size``, ``deleted``, ``has_bitmap`` and JN-13's ``allocation``."""
    conf = (F.when(F.col("kind") == "Resident", "Confirmed")
            .when(F.col("kind") == "Unresolved", F.when(F.coalesce("size", F.lit(0)) == 0, "Confirmed").otherwise("Low"))
            .when(~F.col("deleted"), "Confirmed").when(~F.col("has_bitmap"), "Partial").otherwise(F.col("allocation")))
    rank = F.array_position(F.array(*[F.lit(c) for c in CONFIDENCE_ORDER]), conf).cast("int") - 1
    return entries.withColumn("confidence", conf).withColumn("confidence_rank", rank)


def location_kind(extents: str | Column = "extents") -> Column:
    """FSC-6."""
    n = F.coalesce(F.size(extents), F.lit(0))
    return F.when(n <= 0, "Unresolved").when(n == 1, "Contiguous").otherwise("Fragmented")


def journal_flags(usn: DataFrame) -> DataFrame:
    """FSC-7 per event."""
    r = F.col("reason")
    return (usn.withColumn("is_deletion", r.bitwiseAND(REASON_DELETE) != 0)
            .withColumn("is_creation", r.bitwiseAND(REASON_CREATE) != 0)
            .withColumn("is_rename", r.bitwiseAND(REASON_RENAME) != 0))


def journal_latest(usn: DataFrame, keys: Sequence[str]) -> DataFrame:
    """FSC-7 roll-up: latest event per record, as a combinable aggregate."""
    flagged = journal_flags(usn)
    rest = [c for c in flagged.columns if c not in (*keys, "record_ref")]
    return (flagged.groupBy(*keys, "record_ref").agg(F.max_by(F.struct(*rest), "usn").alias("_l"),
                                                     F.count_if("is_deletion").alias("deletions"))
            .select(*keys, "record_ref", "deletions", "_l.*"))


def best_timestamps(entries: DataFrame) -> DataFrame:
    """FSC-8: standard-information times first, then file-name times; data size, then name size."""
    out = entries
    for c in ("created", "modified", "accessed"):
        out = out.withColumn(c, F.coalesce(f"std_{c}", f"name_{c}"))
    return out.withColumn("size", F.coalesce("data_size", "name_size"))


def orphan_inodes(inodes: DataFrame, visited: DataFrame, names: DataFrame, keys: Sequence[str]) -> DataFrame:
    """JN-15: unlinked inodes with content that no directory led to."""
    keys = list(keys)
    lost = inodes.where((F.col("inum") >= 11) & (F.col("deleted") | (F.col("links") == 0)) & ((F.col("size") > 0) | (F.col("blocks") > 0)))
    lost = lost.join(visited.select(*keys, "inum").distinct(), [*keys, "inum"], "left_anti")
    named = names.groupBy(*keys, "inum").agg(F.min(F.struct("path", "name")).alias("_n"))
    label = F.concat(F.lit("[ORPHAN_INODE_"), F.col("inum").cast("string"), F.lit("]"))
    return (lost.join(named, [*keys, "inum"], "left")
            .withColumn("name", F.coalesce("_n.name", label))
            .withColumn("path", F.coalesce("_n.path", F.concat(F.lit("/"), label))).drop("_n"))


def quick_format_survivors(found: DataFrame, known: DataFrame, bitmap: DataFrame, keys: Sequence[str]) -> DataFrame:
    """JN-16: records on free clusters whose name the live table lacks; first cluster wins per name."""
    keys = list(keys)
    free = bitmap.where("is_free").select(*keys, "cluster").distinct()
    rows = (found.join(free, [*keys, "cluster"], "left_semi")
            .join(known.select(*keys, "name").distinct(), [*keys, "name"], "left_anti"))
    rest = [c for c in rows.columns if c not in (*keys, "name")]
    return (rows.groupBy(*keys, "name").agg(F.min_by(F.struct(*rest), F.struct("cluster", "record")).alias("_f"))
            .select(*keys, "name", "_f.*").withColumn("deleted", F.lit(True)))


def dedupe_deleted_slack(slack: DataFrame, present: DataFrame, fat: DataFrame, keys: Sequence[str]) -> DataFrame:
    """FSC-9: deleted entries found in free directory clusters and not recovered before."""
    keys = list(keys)
    free = fat.where("next = 0").select(*keys, "cluster").distinct()
    rows = (slack.where(F.col("deleted") & (F.col("start_cluster") >= 2) & (F.col("size") > 0))
            .join(free, [*keys, "cluster"], "left_semi")
            .join(present.select(*keys, "name", "size").distinct(), [*keys, "name", "size"], "left_anti"))
    first = rows.groupBy(*keys, "name", "size").agg(
        F.min(F.struct("cluster", "slot", "start_cluster")).alias("_f")).select(*keys, "name", "size", "_f.*")
    return first.withColumn("path", F.concat(F.lit("/[DELETED_SLACK]/"), "name"))
