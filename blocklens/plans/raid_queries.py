"""Arrays laid out from embedding vectors: each vector is one 64-byte logical block."""

from __future__ import annotations

from pyspark.sql import functions as F

from blocklens.operators import raid
from blocklens.plans.catalog import query, table

PER_ARRAY = 120  # fills whole stripes for 5, 4 and 3 data disks with chunks of 2
N = 5


def geometry(spark, sf):
    a = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / PER_ARRAY).cast("bigint").alias("array_id")).distinct()
    return a.select("array_id", F.element_at(F.array(F.lit(0), F.lit(5), F.lit(6)), (F.col("array_id") % 3 + 1).cast("int")).alias("level"),
                    F.element_at(F.array(*[F.lit(x) for x in raid.LAYOUTS]), (F.floor(F.col("array_id") / 3) % 4 + 1).cast("int")).alias("layout"),
                    F.lit(2).alias("chunk"), F.lit(N).alias("n_members"), F.lit(4).cast("bigint").alias("data_offset"),
                    (F.lit(100) + F.col("array_id")).alias("capacity"))


def logical(spark, sf):
    """Vectors as blocks, the last array filled up with zero blocks to whole arrays."""
    h = F.expr("array_join(transform(embedding, e -> lpad(hex(CAST(floor((CAST(e AS DOUBLE) + 1) * 100) AS BIGINT)), 2, '0')), '')")
    v = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / PER_ARRAY).cast("bigint").alias("array_id"), (F.col("vec_id") % PER_ARRAY).alias("array_lba"),
                                              F.unhex(h).alias("payload"))
    grid = v.select("array_id").distinct().select("array_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(PER_ARRAY - 1).cast("bigint"))).alias("array_lba"))
    return grid.join(v, ["array_id", "array_lba"], "left").withColumn("payload", F.coalesce("payload", F.lit(bytes(64))))


def members(spark, sf):
    g = geometry(spark, sf)
    data = raid.map_lba(logical(spark, sf).join(g, "array_id")).select("array_id", "member_idx", F.col("member_lba").alias("lba"), "payload")
    return data.unionByName(raid.parity_blocks(data, g)), g


LOGICAL = f"""g AS (SELECT DISTINCT vec_id // {PER_ARRAY} AS array_id FROM embeddings),
 lg AS (SELECT g.array_id, r.i AS array_lba, coalesce((SELECT array_to_string([printf('%02X', CAST(floor((x::DOUBLE + 1) * 100) AS INT)) FOR x IN embedding], '') FROM embeddings e
  WHERE e.vec_id = g.array_id * {PER_ARRAY} + r.i), repeat('00', 64)) AS payload_hex, [0, 5, 6][g.array_id % 3 + 1] AS level FROM g, range({PER_ARRAY}) r(i))"""


@query("raid1_map_lba", """WITH x AS (SELECT o_orderkey AS array_lba, o_custkey AS k, [0,5,6][o_custkey % 3 + 1] AS level, o_custkey // 3 % 4 AS lay, 4 + o_custkey % 3 AS n, 8 AS chunk FROM orders),
 a AS (SELECT *, n - CASE level WHEN 0 THEN 0 WHEN 5 THEN 1 ELSE 2 END AS d FROM x), b AS (SELECT *, array_lba // chunk // d AS r, array_lba // chunk % d AS c FROM a),
 p AS (SELECT *, CASE WHEN lay >= 2 THEN r % n WHEN level = 6 THEN (2 * n - 2 - r % n) % n ELSE (n - 1 - r % n) % n END AS p FROM b), q AS (SELECT *, (p + 1) % n AS q FROM p),
 s AS (SELECT *, c + CASE WHEN c >= least(p, q) THEN 1 ELSE 0 END AS c1 FROM q)
SELECT array_lba, r AS stripe_row, CAST(c AS INT) AS data_col, CAST(CASE WHEN level = 0 THEN c WHEN lay % 2 = 0 THEN CASE level WHEN 5 THEN (p + 1 + c) % n ELSE (q + 1 + c) % n END
 WHEN level = 5 THEN CASE WHEN c < p THEN c ELSE c + 1 END ELSE (c1 + CASE WHEN c1 >= greatest(p, q) THEN 1 ELSE 0 END) % n END AS INT) AS member_idx, 16 + r * 8 + array_lba % 8 AS member_lba FROM s""")
def map_lba(spark, sf):
    lv = F.element_at(F.array(F.lit(0), F.lit(5), F.lit(6)), (F.col("o_custkey") % 3 + 1).cast("int"))
    lay = F.element_at(F.array(*[F.lit(x) for x in raid.LAYOUTS]), (F.floor(F.col("o_custkey") / 3) % 4 + 1).cast("int"))
    x = table(spark, sf, "orders").select(F.col("o_orderkey").alias("array_lba"), lv.alias("level"), lay.alias("layout"), (F.col("o_custkey") % 3 + 4).alias("n_members"),
                                          F.lit(8).alias("chunk"), F.lit(16).cast("bigint").alias("data_offset"))
    return raid.map_lba(x).select("array_lba", "stripe_row", "data_col", "member_idx", "member_lba")


@query("raid2_capacity", f"WITH {LOGICAL} SELECT array_id, (96 + array_id) // 2 * 2 * ({N} - [0, 1, 2][array_id % 3 + 1]) AS sectors FROM g")
def capacity(spark, sf):
    return geometry(spark, sf).select("array_id", raid.capacity().alias("sectors"))


@query("raid3_assemble", f"WITH {LOGICAL} SELECT array_id, array_lba, payload_hex FROM lg")
def assemble(spark, sf):
    m, g = members(spark, sf)
    return raid.assemble(m, g).select("array_id", "array_lba", F.hex("payload").alias("payload_hex"))


@query("raid4_xor_rebuild", f"WITH {LOGICAL} SELECT array_id, array_lba, payload_hex FROM lg WHERE level = 5")
def xor_rebuild(spark, sf):
    """One member of every array is gone; level 5 reads whole again."""
    m, g = members(spark, sf)
    g = g.where("level = 5")
    left = m.where(F.col("member_idx") != F.col("array_id") % N)
    got = raid.xor_rebuild(left, g).where("recoverable").select("array_id", "array_lba", "payload")
    return raid.assemble(left, g).unionByName(got).select("array_id", "array_lba", F.hex("payload").alias("payload_hex"))


@query("raid4_unrecoverable", f"""WITH {LOGICAL} SELECT array_id, (96 + array_id) // 2 * 2 * {N} - count(*) FILTER (WHERE array_lba // 2 % {N} <> array_id % {N}) AS lost
FROM lg WHERE level = 0 GROUP BY array_id""")
def unrecoverable(spark, sf):
    m, g = members(spark, sf)
    left = m.where(F.col("member_idx") != F.col("array_id") % N)
    return raid.xor_rebuild(left, g.where("level = 0")).where("NOT recoverable").groupBy("array_id").agg(F.count(F.lit(1)).alias("lost"))


@query("raid5_pq_rebuild", f"WITH {LOGICAL} SELECT array_id, array_lba, payload_hex FROM lg WHERE level = 6")
def pq_rebuild(spark, sf):
    """Two members of every array are gone; level 6 reads whole again."""
    m, g = members(spark, sf)
    g = g.where("level = 6")
    a = F.col("array_id")
    left = m.where((F.col("member_idx") != a % N) & (F.col("member_idx") != (a + 2) % N))
    got = raid.pq_rebuild(left, g).where("recoverable").select("array_id", "array_lba", "payload")
    return raid.assemble(left, g).unionByName(got).select("array_id", "array_lba", F.hex("payload").alias("payload_hex"))


@query("raid6_parity_scrub", f"WITH {LOGICAL} SELECT array_id, i + 4 AS lba, true AS p_differs, array_id % 3 = 2 AS q_differs FROM g, range(0, 48) r(i) WHERE array_id % 3 > 0 AND i % 7 = 3 AND i < [0, 30, 40][array_id % 3 + 1]")
def parity_scrub(spark, sf):
    """A byte of one data block is turned in every seventh stripe."""
    m, g = members(spark, sf)
    placed = raid._placed(m, g).select("array_id", "member_idx", "lba", "payload", "data_col", "data_offset")
    hit = (F.col("data_col") == 1) & ((F.col("lba") - F.col("data_offset")) % 7 == 3)
    bent = F.concat(F.unhex(F.lpad(F.hex(255 - F.conv(F.hex(F.substring("payload", 1, 1)), 16, 10).cast("bigint")), 2, "0")), F.substring("payload", 2, 63))
    m2 = placed.withColumn("payload", F.when(hit, bent).otherwise(F.col("payload"))).select("array_id", "member_idx", "lba", "payload")
    return raid.parity_scrub(m2, g).select("array_id", "lba", "p_differs", "q_differs")


@query("jn17_raid_member_order", """WITH s AS (SELECT o_custkey AS array_id, o_orderkey AS candidate, o_orderkey % 2 AS set_uuid, o_orderkey % 7 AS dev_number FROM orders),
 p AS (SELECT array_id, arg_min(set_uuid, candidate) AS set_uuid FROM s GROUP BY 1),
 m AS (SELECT s.array_id, s.dev_number AS slot, max(candidate) AS candidate FROM s JOIN p USING (array_id, set_uuid) WHERE s.dev_number < 5 GROUP BY ALL)
SELECT p.array_id, CAST(r.i AS INT) AS slot, m.candidate, m.candidate IS NULL AS missing FROM p CROSS JOIN range(5) r(i) LEFT JOIN m ON m.array_id = p.array_id AND m.slot = r.i""")
def member_order(spark, sf):
    s = table(spark, sf, "orders").selectExpr("o_custkey AS array_id", "o_orderkey AS candidate", "o_orderkey % 2 AS set_uuid", "CAST(o_orderkey % 7 AS INT) AS dev_number", "5 AS raid_disks")
    return raid.member_order(s).select("array_id", "slot", "candidate", "missing")
