"""Filesystem metadata queries: trees, chains, bitmaps and journals from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from blocklens.operators import fsmeta
from blocklens.plans.catalog import query, table

VOL = ["volume"]


def tree(spark, sf):
    """region > nation > customer > orders; every seventh customer directory is unlinked."""
    r = table(spark, sf, "region").selectExpr("'/' AS dir_id", "concat('r', r_regionkey) AS entry_id", "r_name AS name", "true AS is_dir", "false AS unlinked")
    n = table(spark, sf, "nation").selectExpr("concat('r', n_regionkey) AS dir_id", "concat('n', n_nationkey) AS entry_id", "n_name AS name", "true AS is_dir", "false AS unlinked")
    c = table(spark, sf, "customer").selectExpr("concat('n', c_nationkey) AS dir_id", "concat('c', c_custkey) AS entry_id", "c_name AS name", "true AS is_dir", "c_custkey % 7 = 0 AS unlinked")
    o = table(spark, sf, "orders").selectExpr("concat('c', o_custkey) AS dir_id", "concat('o', o_orderkey) AS entry_id", "concat('order', o_orderkey) AS name", "false AS is_dir", "false AS unlinked")
    return r.unionByName(n).unionByName(c).unionByName(o).withColumn("volume", F.lit(1))


@query("fsc1_build_paths", """WITH r AS (SELECT r_regionkey AS k, '/' || r_name AS p FROM region), n AS (SELECT n_nationkey AS k, p || '/' || n_name AS p FROM nation JOIN r ON r.k = n_regionkey),
 c AS (SELECT c_custkey AS k, p || '/' || c_name AS p FROM customer JOIN n ON n.k = c_nationkey)
SELECT 'r' || k AS entry_id, p AS path, CAST(1 AS INT) AS depth FROM r UNION ALL SELECT 'n' || k, p, 2 FROM n UNION ALL SELECT 'c' || k, p, 3 FROM c
UNION ALL SELECT 'o' || o_orderkey, p || '/order' || o_orderkey, 4 FROM orders JOIN c ON c.k = o_custkey WHERE o_custkey % 7 <> 0""")
def build_paths(spark, sf):
    t = tree(spark, sf)
    roots = t.select("volume").distinct().withColumn("dir_id", F.lit("/"))
    return fsmeta.build_paths(t, roots, VOL).select("entry_id", "path", "depth")


def fat(spark, sf):
    """Two clusters per order: chains mostly step by 8, some loop back, some run off the volume."""
    nxt = F.expr("""CASE WHEN o_custkey % 97 = 0 AND o_orderkey > 40 THEN o_orderkey - 16 WHEN o_custkey % 89 = 0 THEN 99000000000
        WHEN o_custkey % 4 = 0 THEN NULL WHEN o_custkey % 11 = 0 THEN 0 ELSE o_orderkey + 8 END""")
    return table(spark, sf, "orders").select(F.lit(1).alias("volume"), F.col("o_orderkey").alias("cluster"), nxt.alias("next"))


FAT = """fat AS (SELECT o_orderkey AS cluster, CASE WHEN o_custkey % 97 = 0 AND o_orderkey > 40 THEN o_orderkey - 16 WHEN o_custkey % 89 = 0 THEN 99000000000
 WHEN o_custkey % 4 = 0 THEN NULL WHEN o_custkey % 11 = 0 THEN 0 ELSE o_orderkey + 8 END AS nxt FROM orders)"""


@query("fsc3_follow_chain", f"""WITH RECURSIVE {FAT}, w(file_id, pos, cluster, seen, again) AS (SELECT s_suppkey, 0, s_suppkey * 100 + 2, [s_suppkey * 100 + 2], false FROM supplier
 UNION ALL SELECT w.file_id, w.pos + 1, f.nxt, list_append(w.seen, f.nxt), list_contains(w.seen, f.nxt) FROM w JOIN fat f ON f.cluster = w.cluster
 WHERE NOT w.again AND f.nxt IS NOT NULL AND f.nxt <> 0 AND f.nxt < 50000000000)
SELECT w.file_id, CAST(w.pos AS BIGINT) AS pos, w.cluster, bool_or(w.again) OVER (PARTITION BY w.file_id) AS looped, coalesce(f.nxt > 50000000000, false) AS out_of_range
FROM w LEFT JOIN fat f ON f.cluster = w.cluster QUALIFY NOT w.again""")
def follow_chain(spark, sf):
    starts = table(spark, sf, "supplier").select(F.lit(1).alias("volume"), F.col("s_suppkey").alias("file_id"), (F.col("s_suppkey") * 100 + 2).alias("start"))
    return fsmeta.follow_chain(fat(spark, sf), starts, 50_000_000_000, VOL).select("file_id", "pos", "cluster", "looped", "out_of_range")


@query("fsc4_deleted_extents", f"""WITH RECURSIVE {FAT}, en AS (SELECT s_suppkey AS entry_id, CASE s_suppkey % 10 WHEN 3 THEN 0 WHEN 5 THEN 1 WHEN 7 THEN 60000000000 ELSE s_suppkey * 100 + 2 END AS start,
  CASE WHEN s_suppkey % 20 IN (3, 5) THEN 0 ELSE CAST(floor(s_acctbal + 2000) AS BIGINT) END AS size FROM supplier),
 e AS (SELECT * FROM en WHERE start >= 2 AND start < 60000000000),
 l AS (SELECT e.*, coalesce(f.nxt <> 0, false) AS linked FROM e LEFT JOIN fat f ON f.cluster = e.start),
 w(entry_id, cluster, seen) AS (SELECT entry_id, start, [start] FROM l WHERE linked UNION ALL
  SELECT w.entry_id, f.nxt, list_append(w.seen, f.nxt) FROM w JOIN fat f ON f.cluster = w.cluster WHERE f.nxt <> 0 AND f.nxt < 50000000000 AND NOT list_contains(w.seen, f.nxt)),
 a AS (SELECT entry_id, cluster FROM w UNION ALL SELECT entry_id, unnest(range(start, start + greatest((size + 511) // 512, 1))) FROM l WHERE NOT linked)
SELECT a.entry_id, count(*) AS clusters, CASE WHEN bool_and(coalesce(f.nxt = 0, false)) THEN 'Confirmed' ELSE 'Partial' END AS confidence
FROM a LEFT JOIN fat f ON f.cluster = a.cluster GROUP BY a.entry_id
UNION ALL SELECT entry_id, 0, CASE WHEN size = 0 THEN 'Confirmed' ELSE 'Low' END FROM en WHERE start < 2 OR start >= 60000000000""")
def deleted_extents(spark, sf):
    """Entries that start inside the volume, below cluster 2 and past the end; some are empty."""
    k = F.col("s_suppkey")
    start = F.when(k % 10 == 3, 0).when(k % 10 == 5, 1).when(k % 10 == 7, 60_000_000_000).otherwise(k * 100 + 2)
    size = F.when((k % 20).isin(3, 5), 0).otherwise(F.floor(F.col("s_acctbal") + 2000))
    e = table(spark, sf, "supplier").select(F.lit(1).alias("volume"), k.alias("entry_id"), start.cast("bigint").alias("start_cluster"), size.cast("bigint").alias("size"))
    vols = e.select("volume").distinct().select("volume", F.lit(512).alias("cluster_bytes"), F.lit(50_000_000_000).alias("total_clusters"))
    return fsmeta.deleted_confidence(fsmeta.deleted_extents(e, fat(spark, sf), vols, VOL), VOL, e).select("entry_id", "clusters", "confidence")


def extent_entries(spark, sf):
    """Part files of one to three extents over order-key clusters (two blocks per cluster)."""
    one = F.struct((F.col("p_partkey") * 10).alias("start_lba"), (F.col("p_size").cast("bigint")).alias("block_count"))
    two = F.struct((F.col("p_partkey") * 4 + 1000).alias("start_lba"), F.lit(6).cast("bigint").alias("block_count"))
    none = F.array().cast("array<struct<start_lba:bigint,block_count:bigint>>")
    ext = F.when(F.col("p_partkey") % 9 == 0, none).when(F.col("p_partkey") % 2 == 0, F.array(one, two)).otherwise(F.array(one))
    return table(spark, sf, "part").select(F.lit(1).alias("volume"), F.col("p_partkey").alias("entry_id"), ext.alias("extents"),
                                           F.col("p_size").cast("bigint").alias("size"), (F.col("p_retailprice") > 1200).alias("deleted"))


def bitmap(spark, sf):
    return table(spark, sf, "orders").select(F.lit(1).alias("volume"), F.col("o_orderkey").alias("cluster"), (F.col("o_custkey") % 3 > 0).alias("is_free"))


ALLOC = """x AS (SELECT p_partkey AS entry_id, p_partkey * 10 // 2 AS s, (p_size + 1) // 2 AS c FROM part WHERE p_partkey % 9 <> 0
  UNION ALL SELECT p_partkey, (p_partkey * 4 + 1000) // 2, 3 FROM part WHERE p_partkey % 9 <> 0 AND p_partkey % 2 = 0),
 cl AS (SELECT entry_id, unnest(range(s, s + c)) AS cluster FROM x),
 al AS (SELECT entry_id, count(*) AS clusters, count(*) FILTER (o_custkey % 3 > 0) AS free_clusters FROM cl LEFT JOIN orders ON o_orderkey = cluster GROUP BY 1),
 alloc AS (SELECT p_partkey AS entry_id, p_size, p_retailprice, p_partkey % 9 AS m, p_partkey % 2 AS m2, coalesce(clusters, 0) AS clusters, coalesce(free_clusters, 0) AS free_clusters,
  CASE WHEN coalesce(clusters, 0) = 0 THEN 'Low' WHEN free_clusters = clusters THEN 'Confirmed' WHEN free_clusters > 0 THEN 'Partial' ELSE 'Low' END AS allocation
  FROM part LEFT JOIN al ON al.entry_id = p_partkey)"""


@query("jn13_entry_allocation", f"WITH {ALLOC} SELECT entry_id, clusters, free_clusters, allocation FROM alloc")
def entry_allocation(spark, sf):
    return fsmeta.entry_allocation(extent_entries(spark, sf), bitmap(spark, sf), VOL, 2).select("entry_id", "clusters", "free_clusters", "allocation")


@query("fsc5_entry_confidence", f"""WITH {ALLOC} SELECT entry_id, CASE WHEN m = 0 THEN CASE WHEN p_size = 0 THEN 'Confirmed' ELSE 'Low' END WHEN NOT p_retailprice > 1200 THEN 'Confirmed'
 WHEN entry_id % 5 = 0 THEN 'Partial' ELSE allocation END AS confidence FROM alloc""")
def entry_confidence(spark, sf):
    a = fsmeta.entry_allocation(extent_entries(spark, sf), bitmap(spark, sf), VOL, 2)
    a = a.withColumn("kind", fsmeta.location_kind()).withColumn("has_bitmap", F.col("entry_id") % 5 != 0)
    return fsmeta.entry_confidence(a).select("entry_id", "confidence")


@query("fsc6_location_kind", "SELECT p_partkey AS entry_id, CASE WHEN p_partkey % 9 = 0 THEN 'Unresolved' WHEN p_partkey % 2 = 0 THEN 'Fragmented' ELSE 'Contiguous' END AS kind FROM part")
def location_kind(spark, sf):
    return extent_entries(spark, sf).select("entry_id", fsmeta.location_kind().alias("kind"))


def journal(spark, sf):
    return journal_of(table(spark, sf, "events"))


def journal_of(events):
    reason = F.expr("""CASE event_type WHEN 'signup' THEN 256 WHEN 'purchase' THEN 512 + 256 WHEN 'error' THEN 4096 WHEN 'click' THEN 8192 ELSE 2 END""")
    return events.select((F.col("user_id") % 4).alias("volume"), F.col("event_id").alias("usn"), F.col("user_id").alias("record_ref"), "ts",
                         reason.alias("reason"), F.concat(F.lit("file"), "user_id").alias("filename"))


@query("fsc7_journal_deletions", """SELECT user_id % 4 AS volume, event_id AS usn, event_type = 'purchase' AS is_deletion, event_type IN ('signup', 'purchase') AS is_creation,
 event_type IN ('error', 'click') AS is_rename FROM events""")
def journal_flags(spark, sf):
    return fsmeta.journal_flags(journal(spark, sf)).select("volume", "usn", "is_deletion", "is_creation", "is_rename")


@query("fsc7_journal_latest", """SELECT user_id % 4 AS volume, user_id AS record_ref, max(event_id) AS usn, count(*) FILTER (event_type = 'purchase') AS deletions,
 arg_max(event_type, event_id) = 'purchase' AS is_deletion FROM events GROUP BY ALL""")
def journal_latest(spark, sf):
    return fsmeta.journal_latest(journal(spark, sf), VOL).select("volume", "record_ref", "usn", "deletions", "is_deletion")


@query("fsc8_best_timestamps", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, strftime(CASE WHEN l_partkey % 3 > 0 THEN l_shipdate ELSE o_orderdate END, '%Y-%m-%d') AS created,
 CASE WHEN l_partkey % 4 > 0 THEN CAST(l_quantity AS BIGINT) ELSE l_suppkey END AS size FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def best_timestamps(spark, sf):
    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    std = F.when(F.col("l_partkey") % 3 > 0, F.col("l_shipdate"))
    cols = {f"std_{c}": std for c in ("created", "modified", "accessed")} | {f"name_{c}": F.col("o_orderdate") for c in ("created", "modified", "accessed")}
    e = j.withColumns({**cols, "data_size": F.when(F.col("l_partkey") % 4 > 0, F.col("l_quantity").cast("bigint")), "name_size": F.col("l_suppkey")})
    return fsmeta.best_timestamps(e).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.date_format("created", "yyyy-MM-dd").alias("created"), "size")


@query("jn15_orphan_inodes", """WITH i AS (SELECT o_orderkey AS inum, CAST(floor(o_totalprice) AS BIGINT) % 5 AS size, o_custkey % 4 AS blocks, o_custkey % 3 AS links, o_orderstatus = 'F' AS deleted FROM orders),
 v AS (SELECT DISTINCT l_orderkey AS inum FROM lineitem WHERE l_quantity > 40), nm AS (SELECT l_orderkey AS inum, min('/d' || l_suppkey || '/f' || l_orderkey) AS path FROM lineitem WHERE l_discount > 0.05 GROUP BY 1)
SELECT i.inum, coalesce(nm.path, '/[ORPHAN_INODE_' || i.inum || ']') AS path FROM i LEFT JOIN nm USING (inum) WHERE i.inum >= 11 AND (deleted OR links = 0) AND (size > 0 OR blocks > 0)
 AND i.inum NOT IN (SELECT inum FROM v)""")
def orphans(spark, sf):
    i = table(spark, sf, "orders").selectExpr("1 AS volume", "o_orderkey AS inum", "CAST(floor(o_totalprice) AS BIGINT) % 5 AS size", "o_custkey % 4 AS blocks", "o_custkey % 3 AS links", "o_orderstatus = 'F' AS deleted")
    li = table(spark, sf, "lineitem")
    v = li.where("l_quantity > 40").selectExpr("1 AS volume", "l_orderkey AS inum")
    nm = li.where("l_discount > 0.05").selectExpr("1 AS volume", "l_orderkey AS inum", "concat('/d', l_suppkey, '/f', l_orderkey) AS path", "concat('f', l_orderkey) AS name")
    return fsmeta.orphan_inodes(i, v, nm, VOL).select("inum", "path")


@query("jn16_quick_format_survivors", """WITH f AS (SELECT l_orderkey AS cluster, l_linenumber AS record, 'doc' || (l_partkey % 500) AS name FROM lineitem),
 k AS (SELECT DISTINCT 'doc' || (c_custkey * 3 % 500) AS name FROM customer WHERE c_acctbal > 5000),
 s AS (SELECT * FROM f WHERE cluster IN (SELECT o_orderkey FROM orders WHERE o_custkey % 3 > 0) AND name NOT IN (SELECT name FROM k))
SELECT name, min(cluster) AS cluster, true AS deleted FROM s GROUP BY name""")
def survivors(spark, sf):
    f = table(spark, sf, "lineitem").selectExpr("1 AS volume", "l_orderkey AS cluster", "l_linenumber AS record", "concat('doc', l_partkey % 500) AS name")
    k = table(spark, sf, "customer").where("c_acctbal > 5000").selectExpr("1 AS volume", "concat('doc', c_custkey * 3 % 500) AS name")
    return fsmeta.quick_format_survivors(f, k, bitmap(spark, sf), VOL).select("name", "cluster", "deleted")


@query("fsc9_dedupe_deleted_slack", f"""WITH {FAT}, s AS (SELECT l_orderkey AS cluster, l_linenumber AS slot, 'f' || l_partkey AS name, CAST(l_quantity AS BIGINT) - 3 AS size, l_suppkey AS start_cluster, l_returnflag <> 'N' AS deleted FROM lineitem),
 p AS (SELECT DISTINCT 'f' || p_partkey AS name, CAST(p_size AS BIGINT) AS size FROM part)
SELECT name, size, min(cluster) AS cluster, '/[DELETED_SLACK]/' || name AS path FROM s WHERE deleted AND start_cluster >= 2 AND size > 0 AND cluster IN (SELECT cluster FROM fat WHERE nxt = 0)
 AND NOT EXISTS (SELECT 1 FROM p WHERE p.name = s.name AND p.size = s.size) GROUP BY name, size""")
def deleted_slack(spark, sf):
    s = table(spark, sf, "lineitem").selectExpr("1 AS volume", "l_orderkey AS cluster", "l_linenumber AS slot", "concat('f', l_partkey) AS name", "CAST(l_quantity AS BIGINT) - 3 AS size",
                                                "l_suppkey AS start_cluster", "l_returnflag <> 'N' AS deleted")
    p = table(spark, sf, "part").selectExpr("1 AS volume", "concat('f', p_partkey) AS name", "CAST(p_size AS BIGINT) AS size")
    return fsmeta.dedupe_deleted_slack(s, p, fat(spark, sf), VOL).select("name", "size", "cluster", "path")
