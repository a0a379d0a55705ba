"""Merkle manifest of a table by cogrouped subtree exchange.

Every row is a leaf; the leaves of a source form a tree of fan-out 16 in order of doc_id, the subroots form one more such tree. A superblock is
4,096 consecutive leaves of a source, a whole subtree of three levels. Superblocks are first reduced to one node each; the nodes above
them, one in 4,096, are reduced level by level. The siblings a superblock needs from there, a run of at most 15 nodes per level, are
joined as its outer nodes; leaves and outer nodes are then cogrouped by superblock, and one call per superblock finishes the local
levels again, joins each leaf's proof and folds it.

Leaves are numbered inside their source by a range partitioning: rows are numbered inside each partition, and the counts of the partitions
before are added, so a source with a third of all rows is spread like any other. Texts are hashed where they are read and do not move.

Defined results: a null field is written as ``-``; null is a source of its own, the first; a null doc_id comes after all others and is not
tampered with; rows of one doc_id are leaves of their own, in order of their hashes; rows equal in all fields are equal leaves beside each
other; an empty table gives an empty result; columns other than the five are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blocklens.llm.common import partitions, query, small_side, table
from blocklens.session import cut_lineage

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 16
#: levels of a superblock and its leaves
LEVELS = 3
BLOCK = FAN**LEVELS
TAMPERED = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(c: Column) -> Column:
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaves(docs: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """skey (a source's place: null first), doc_id, leaf and the leaf after tampering, null where nothing is tampered with."""
    parts = {c: field(docs[c]) for c in fields}
    digest = lambda p: F.sha2(F.concat(*[p[c] for c in fields]), 256)
    hit = F.crc32(docs["doc_id"].cast("string")) % TAMPERED == 0
    changed = digest({**parts, "text": field(F.translate(docs["text"], _UPPER, _LOWER))})
    skey = F.coalesce(F.concat(F.lit("1"), docs["source"]), F.lit("0"))
    return docs.select(skey.alias("skey"), docs["doc_id"].cast("long").alias("doc_id"), digest(parts).alias("leaf"), F.when(hit, changed).alias("forged"))


def _number(batches):
    """Rows of a sorted partition with the partition's number and their number among the partition's rows of the same key."""
    at, key, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        keys = batch.column(0).to_pylist()
        out = np.empty(len(keys), np.int64)
        for i, k in enumerate(keys):
            if k != key:
                key, seen = k, 0
            out[i], seen = seen, seen + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(keys), at, np.int64)), pa.array(out)], names=[*batch.schema.names, "part_", "in_part_"])


def numbered(rows: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """``rows`` with ``pos``, from 0 inside each ``key`` along ``order``; hot keys are spread over partitions. ``key`` is the first column."""
    n = partitions(rows.sparkSession)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    placed = rows.repartitionByRange(n, key, *order).sortWithinPartitions(key, *order).mapInArrow(_number, f"{kinds}, part_ long, in_part_ long")
    placed = cut_lineage(placed)
    before = Window.partitionBy(key).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    # one row per key and partition it reaches: at most the keys and the partitions together
    starts = placed.groupBy(key, "part_").agg(F.count("*").alias("n_")).select(key, "part_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("before_"))
    return placed.join(small_side(cut_lineage(starts)), [key, "part_"]).withColumn("pos", F.col("before_") + F.col("in_part_")).drop("part_", "in_part_", "before_")


def parent(digests: Sequence[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def run_of(nodes: DataFrame) -> DataFrame:
    """Nodes (skey, pos, node) by runs of ``FAN``: skey, run (the parent's pos) and the run's digests in order."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "node")))
    return nodes.groupBy("skey", F.floor(F.col("pos") / FAN).alias("run")).agg(F.transform(ordered, lambda x: x["node"]).alias("run_nodes"))


def reduce_up(nodes: DataFrame, sizes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Roots (skey, node) of every key's ``nodes`` and the runs of each level below; ``sizes`` (skey, n) counts the nodes of a key.

    A key stops where one node is left; a level's table is a sixteenth of the one below.
    """
    levels, roots, now = [], [], cut_lineage(nodes.join(sizes, "skey"))
    while True:
        roots.append(now.filter("n = 1").select("skey", "node"))
        more = now.filter("n > 1")
        if more.isEmpty():
            break
        runs = cut_lineage(run_of(more).join(more.select("skey", "n").distinct(), "skey"))
        levels.append(runs.select("skey", "run", "run_nodes"))
        now = cut_lineage(runs.select("skey", F.col("run").alias("pos"), F.sha2(F.array_join("run_nodes", ""), 256).alias("node"), F.ceil(F.col("n") / FAN).alias("n")))
    out = roots[0]
    for r in roots[1:]:
        out = out.unionByName(r)
    return cut_lineage(out), levels


def outer_runs(places: DataFrame, levels: list[DataFrame], first: int) -> DataFrame:
    """For every row of ``places`` (skey, block, pos) the runs above it: skey, block, level (from ``first``), place in the run, run_nodes."""
    found = places.select("skey", "block", F.lit(0).alias("level"), F.lit(0).alias("place"), F.array().cast("array<string>").alias("run_nodes")).limit(0)
    at = places
    for k, runs in enumerate(levels):
        met = cut_lineage(at.withColumn("run", F.floor(F.col("pos") / FAN)).join(runs, ["skey", "run"]))
        found = found.unionByName(met.select("skey", "block", F.lit(first + k).alias("level"), (F.col("pos") % FAN).cast("int").alias("place"), "run_nodes"))
        at = met.select("skey", "block", F.col("run").alias("pos"))
    return found


def height(n: int) -> int:
    """Levels above the leaves of a tree over ``n`` leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def local_levels(digests: list[str], n: int) -> list[list[str]]:
    """Levels of one superblock of a tree over ``n`` leaves, leaves first, its one node last."""
    levels = [digests]
    for _ in range(min(height(n), LEVELS)):
        now = levels[-1]
        levels.append([parent(now[i:i + FAN]) for i in range(0, len(now), FAN)])
    return levels


def _block_node(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("pos")
    top = local_levels(rows["leaf"].tolist(), int(rows["n"].iloc[0]))[-1]
    return pd.DataFrame({"skey": [key[0]], "pos": [key[1]], "node": top})


def _finish(key: tuple, rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """Local levels, proof and fold of every leaf of a superblock."""
    rows, outer = rows.sort_values("pos"), outer.sort_values("level")
    leaf, forged = rows["leaf"].tolist(), rows["forged"].tolist()
    levels = local_levels(leaf, int(rows["n"].iloc[0]))
    above = [(p, list(r)) for p, r in zip(outer["place"], outer["run_nodes"])]
    shared = "".join("".join(r[:p] + r[p + 1:]) for p, r in above)
    proofs, folded = [], []
    for i, own in enumerate(leaf):
        now, at, proof = forged[i] or own, i, []
        for level in levels[:-1]:
            start = at - at % FAN
            run = level[start:start + FAN]
            proof += run[:at - start] + run[at - start + 1:]
            run[at - start] = now
            now, at = parent(run), at // FAN
        for p, r in above:
            now = parent([*r[:p], now, *r[p + 1:]])
        proofs.append(hashlib.sha256(("".join(proof) + shared).encode()).hexdigest())
        folded.append(now)
    return pd.DataFrame({"skey": rows["skey"], "doc_id": rows["doc_id"], "leaf": leaf, "proof_sha256": proofs, "folded_root": folded})


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row per row of ``docs``."""
    found = numbered(cut_lineage(leaves(docs)), "skey", [F.col("doc_id").asc_nulls_last(), F.col("leaf")])
    found = cut_lineage(found.withColumn("block", F.floor(F.col("pos") / BLOCK)))
    counts = cut_lineage(found.groupBy("skey").agg(F.count("*").alias("n")))
    keyed = found.join(small_side(counts), "skey").groupBy("skey", "block")
    blocks = cut_lineage(keyed.applyInPandas(_block_node, "skey string, pos long, node string"))
    subroots, inner = reduce_up(blocks, counts.select("skey", F.ceil(F.col("n") / BLOCK).alias("n")))
    # the subroots, in order of their sources, are the lowest level of one more tree, under one key
    tops = cut_lineage(numbered(subroots.select(F.lit("").alias("all_"), F.col("skey").alias("source_key"), "node"), "all_", [F.col("source_key")]))
    lowest = tops.select(F.col("all_").alias("skey"), "pos", "node", F.col("source_key").alias("block"))
    roots, upper = reduce_up(lowest.drop("block"), tops.groupBy(F.col("all_").alias("skey")).agg(F.count("*").alias("n")))
    places = blocks.select("skey", F.col("pos").alias("block"), "pos")
    outer = outer_runs(places, inner, 0)
    over = outer_runs(lowest, upper, len(inner)).select(F.col("block").alias("skey"), "level", "place", "run_nodes")
    outer = outer.unionByName(places.select("skey", "block").join(over, "skey").select(*outer.columns))
    done = keyed.cogroup(outer.groupBy("skey", "block")).applyInPandas(_finish, "skey string, doc_id long, leaf string, proof_sha256 string, folded_root string")
    top = roots.first()  # one digest, or none of an empty table
    root = F.lit(top["node"] if top else None).cast("string")
    subroots = subroots.select("skey", F.col("node").alias("subroot"))
    return done.join(small_side(subroots), "skey").select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def _sql_field(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"


_LEAF = "sha256(" + " || ".join(_sql_field(c) for c in FIELDS) + ")"
_FORGED = "sha256(" + " || ".join(_sql_field(c) for c in FIELDS[:-1]) + f" || {_sql_field(f"translate(text, '{_UPPER}', '{_LOWER}')")})"
# CRC-32 over the digits of an id: a fold of bytes, each a fold of eight bit steps
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: unicode(x)::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT)"""
SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, source, {_LEAF} AS leaf, CASE WHEN {_CRC} % 5 = 0 THEN {_FORGED} ELSE {_LEAF} END AS val FROM documents),
base AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS LAST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
lv AS (SELECT source, 0 AS level, pos, leaf AS node, n FROM base
    UNION ALL SELECT source, level + 1, pos // 16, sha256(string_agg(node, '' ORDER BY pos)), (n + 15) // 16 FROM lv WHERE n > 1 GROUP BY source, level, pos // 16, n),
sub AS (SELECT source, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM lv WHERE n = 1),
up AS (SELECT 0 AS level, pos, subroot AS node, n FROM sub
    UNION ALL SELECT level + 1, pos // 16, sha256(string_agg(node, '' ORDER BY pos)), (n + 15) // 16 FROM up WHERE n > 1 GROUP BY level, pos // 16, n),
fold AS (SELECT source, pos AS own, 0 AS level, pos, n, val FROM base
    UNION ALL SELECT f.source, own, f.level + 1, f.pos // 16, (f.n + 15) // 16, sha256(string_agg(CASE WHEN l.pos = f.pos THEN f.val ELSE l.node END, '' ORDER BY l.pos))
    FROM fold f JOIN lv l ON l.source IS NOT DISTINCT FROM f.source AND l.level = f.level AND l.pos // 16 = f.pos // 16 WHERE f.n > 1 GROUP BY f.source, own, f.level, f.pos, f.n),
fold2 AS (SELECT f.source, own, 0 AS level, s.pos, s.n, val FROM fold f JOIN sub s ON s.source IS NOT DISTINCT FROM f.source WHERE f.n = 1
    UNION ALL SELECT f.source, own, f.level + 1, f.pos // 16, (f.n + 15) // 16, sha256(string_agg(CASE WHEN u.pos = f.pos THEN f.val ELSE u.node END, '' ORDER BY u.pos))
    FROM fold2 f JOIN up u ON u.level = f.level AND u.pos // 16 = f.pos // 16 WHERE f.n > 1 GROUP BY f.source, own, f.level, f.pos, f.n),
sib AS (SELECT f.source, own, f.level, l.pos, l.node FROM fold f JOIN lv l ON l.source IS NOT DISTINCT FROM f.source AND l.level = f.level AND l.pos // 16 = f.pos // 16 AND l.pos <> f.pos WHERE f.n > 1
    UNION ALL SELECT f.source, own, 1000 + f.level, u.pos, u.node FROM fold2 f JOIN up u ON u.level = f.level AND u.pos // 16 = f.pos // 16 AND u.pos <> f.pos WHERE f.n > 1),
proof AS (SELECT source, own, sha256(string_agg(node, '' ORDER BY level, pos)) AS proof_sha256 FROM sib GROUP BY source, own)
SELECT b.doc_id, b.leaf, s.subroot, (SELECT node FROM up WHERE n = 1) AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.val AS folded_root,
    f.val = (SELECT node FROM up WHERE n = 1) AS verified
FROM base b JOIN sub s ON s.source IS NOT DISTINCT FROM b.source JOIN fold2 f ON f.source IS NOT DISTINCT FROM b.source AND f.own = b.pos AND f.n = 1
LEFT JOIN proof p ON p.source IS NOT DISTINCT FROM b.source AND p.own = b.pos"""


@query("op11_merkle_manifest", SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents").select(*FIELDS))
