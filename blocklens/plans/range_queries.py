"""Range joins, islands, placeholders and the storage map."""

from __future__ import annotations

from pyspark.sql import functions as F

from blocklens.operators import acquire, ranges
from blocklens.plans import domain as d
from blocklens.plans.catalog import query, table

IMG = ["image_id"]


@query("jn02_exclude_allocated", f"""WITH {d.BLOCKS}, {d.EXTENTS}
SELECT image_id, lba, hits FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM extents e WHERE e.image_id=b.image_id
 AND b.lba>=e.start_lba AND b.lba<e.start_lba+e.block_count)""")
def exclude_allocated(spark, sf):
    return ranges.points_in_ranges(d.blocks(spark, sf), d.extents(spark, sf), IMG, "left_anti")


@query("jn03_overlap_pairs", f"""WITH {d.SPANS}, {d.EXTENTS}
SELECT s.image_id, s.start_lba AS a_start, s.block_count AS a_count, e.start_lba AS b_start, e.block_count AS b_count
FROM spans s JOIN extents e ON s.image_id=e.image_id AND s.start_lba < e.start_lba+e.block_count AND s.start_lba+s.block_count > e.start_lba""")
def overlap_pairs(spark, sf):
    a = d.spans(spark, sf).withColumnsRenamed({"start_lba": "a_start", "block_count": "a_count"}).drop("kind_no")
    b = d.extents(spark, sf).withColumnsRenamed({"start_lba": "b_start", "block_count": "b_count"})
    return ranges.overlap_pairs(a, b, IMG)


@query("jn03_overlap_anti", f"""WITH {d.SPANS}, {d.EXTENTS}
SELECT * FROM spans s WHERE NOT EXISTS (SELECT 1 FROM extents e WHERE s.image_id=e.image_id
 AND s.start_lba < e.start_lba+e.block_count AND s.start_lba+s.block_count > e.start_lba)""")
def overlap_anti(spark, sf):
    return ranges.overlap_filter(d.spans(spark, sf), d.extents(spark, sf), IMG, ["start_lba", "block_count"], False)


MERGED = d.BAD + """, isl AS (SELECT *, lba - row_number() OVER (PARTITION BY image_id ORDER BY lba) AS g FROM bad),
 merged AS (SELECT image_id, min(lba) AS start_lba, count(*) AS block_count, arg_min(error, lba) AS error, count(*) * 512 AS bytes
 FROM isl GROUP BY image_id, g)"""


@query("acq2_merge_bad_ranges", f"WITH {MERGED} SELECT * FROM merged")
def merge_bad_ranges(spark, sf):
    return ranges.merge_bad_ranges(d.bad_blocks(spark, sf), IMG)


@query("jn04_is_lba_bad", f"""WITH {MERGED}, t AS (SELECT DISTINCT o_custkey % 16 AS image_id, o_orderkey AS lba FROM orders)
SELECT t.image_id, t.lba FROM t WHERE EXISTS (SELECT 1 FROM merged m WHERE m.image_id=t.image_id
 AND t.lba>=m.start_lba AND t.lba<m.start_lba+m.block_count)""")
def is_lba_bad(spark, sf):
    t = table(spark, sf, "orders").select((F.col("o_custkey") % 16).alias("image_id"), F.col("o_orderkey").alias("lba")).distinct()
    return ranges.points_in_ranges(t, ranges.merge_bad_ranges(d.bad_blocks(spark, sf), IMG), IMG, "left_semi")


@query("acq1_chunk_plan", """SELECT o_orderkey AS image_id, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY s) - 1 AS BIGINT) AS chunk_no,
 s AS start_lba, least(65536, CAST(floor(o_totalprice) AS BIGINT) - s) AS block_count
FROM orders, LATERAL (SELECT unnest(range(0, CAST(floor(o_totalprice) AS BIGINT), 65536)) AS s)""")
def chunk_plan(spark, sf):
    img = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("image_id"), F.floor("o_totalprice").cast("bigint").alias("total_blocks"))
    return acquire.chunk_plan(img, IMG, 65536).select("image_id", "chunk_no", "start_lba", "block_count")


@query("src2_profile_bounds", """WITH p AS (SELECT o_orderkey AS image_id, CAST(floor(o_totalprice) AS BIGINT) AS total_blocks,
 CASE o_orderkey % 3 WHEN 0 THEN 'Physical' WHEN 1 THEN 'Partial' ELSE 'Logical' END AS kind, o_custkey AS a, o_custkey * 200 AS z FROM orders)
SELECT image_id, kind, CASE WHEN kind='Physical' THEN 0 ELSE a END AS start_lba,
 CASE WHEN kind='Physical' THEN total_blocks-1 ELSE least(z, total_blocks-1) END AS end_lba FROM p""")
def profile_bounds(spark, sf):
    kind = F.when(F.col("o_orderkey") % 3 == 0, "Physical").when(F.col("o_orderkey") % 3 == 1, "Partial").otherwise("Logical")
    p = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("image_id"), F.floor("o_totalprice").cast("bigint").alias("total_blocks"),
        kind.alias("kind"), F.col("o_custkey").alias("want_start"), (F.col("o_custkey") * 200).alias("want_end"))
    return acquire.profile_bounds(p).select("image_id", "kind", "start_lba", "end_lba")


@query("acq3_fill_placeholder", f"""WITH {MERGED}, s AS (SELECT event_id % 16 AS image_id, event_id AS lba, event_type AS txt FROM events)
SELECT s.image_id, s.lba, hex(CASE WHEN EXISTS (SELECT 1 FROM bad b WHERE b.image_id=s.image_id AND b.lba=s.lba)
 THEN encode(repeat('UNREADABLE_BLOCK', 32)) ELSE encode(txt) END) AS payload_hex FROM s""")
def fill_placeholder(spark, sf):
    s = table(spark, sf, "events").select(
        (F.col("event_id") % 16).alias("image_id"), F.col("event_id").alias("lba"), F.encode("event_type", "UTF-8").alias("payload"))
    bad = ranges.merge_bad_ranges(d.bad_blocks(spark, sf), IMG)
    return acquire.fill_placeholder(s, bad, IMG).select("image_id", "lba", F.hex("payload").alias("payload_hex"))


@query("rpt11_storage_map", f"""WITH {d.SPANS}, tot AS (SELECT image_id, max(start_lba+block_count) AS total FROM spans GROUP BY ALL),
 g AS (SELECT image_id, CAST(i AS INT) AS segment, i*greatest(1,total//128) AS seg_start, (i+1)*greatest(1,total//128)-1 AS seg_end
  FROM tot, range(128) r(i))
SELECT g.*, CASE coalesce(m.r,0) WHEN 4 THEN 'bad_sector' WHEN 3 THEN 'artifact' WHEN 1 THEN 'allocated' ELSE 'unallocated' END AS status
FROM g LEFT JOIN (SELECT g.image_id, g.segment, max(CASE kind_no WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 4 END) AS r FROM g JOIN spans s
 ON s.image_id=g.image_id AND s.start_lba<=g.seg_end AND s.start_lba+s.block_count-1>=g.seg_start GROUP BY ALL) m
 ON m.image_id=g.image_id AND m.segment=g.segment""")
def storage_map(spark, sf):
    s = d.spans(spark, sf)
    kind = F.when(F.col("kind_no") == 0, "allocated").when(F.col("kind_no") == 1, "artifact").otherwise("bad_sector")
    totals = s.groupBy("image_id").agg(F.max(F.col("start_lba") + F.col("block_count")).alias("total_blocks"))
    return ranges.storage_map(totals, s.withColumn("kind", kind), IMG)


@query("fsc2_extents_from_clusters", """WITH c AS (SELECT l_suppkey AS file_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY o) - 1 AS pos, o AS cluster
 FROM (SELECT DISTINCT l_suppkey, l_orderkey // 8 AS o FROM lineitem))
SELECT file_id, min(cluster)*8 + 64 AS start_lba, count(*)*8 AS block_count FROM (SELECT *, cluster - pos AS g FROM c) GROUP BY file_id, g""")
def extents_from_clusters(spark, sf):
    from blocklens.operators import slices
    c = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("file_id"), F.floor(F.col("l_orderkey") / 8).cast("bigint").alias("cluster")).distinct()
    chain = slices.row_numbers(c, ["file_id"], ["cluster"], slices.by_width("cluster", 1 << 16), "pos")
    return ranges.extents_from_clusters(chain, ["file_id"], 8, 64).drop("extent_no")
