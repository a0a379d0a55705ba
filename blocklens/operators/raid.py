"""Arrays as stripe tables (RAID-1..6, JN-17).

``members``: array_id, member_idx, lba, payload. ``geometry``: array_id, level (0, 5, 6),
layout, chunk, n_members, data_offset, capacity (sectors per member). Placement is integer
arithmetic on columns; only the byte work of a stripe (at most ``n_members`` blocks) runs
in an Arrow UDF.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blocklens.functions import gf256

G = ["level", "layout", "chunk", "n_members", "data_offset"]
LAYOUTS = ["left_symmetric", "left_asymmetric", "right_symmetric", "right_asymmetric"]


def data_disks() -> Column:
    return F.col("n_members") - F.when(F.col("level") == 6, 2).when(F.col("level") == 5, 1).otherwise(0)


def parity_index(row: Column) -> Column:
    """Member that holds P in a stripe row."""
    n = F.col("n_members")
    left = F.when(F.col("level") == 6, F.pmod(n - 2 - row % n, n)).otherwise(F.pmod(n - 1 - row % n, n))
    return F.when(F.col("layout").startswith("left"), left).otherwise(row % n).cast("int")


def map_lba(lbas: DataFrame) -> DataFrame:
    """RAID-1: rows carry geometry columns and ``array_lba``; adds stripe_row, data_col, member_idx, member_lba."""
    n, d = F.col("n_members"), data_disks()
    chunk_no = F.floor(F.col("array_lba") / F.col("chunk"))
    out = (lbas.withColumn("offset_in_chunk", F.col("array_lba") % F.col("chunk"))
           .withColumn("stripe_row", F.floor(chunk_no / d).cast("bigint"))
           .withColumn("data_col", (chunk_no % d).cast("int")))
    p = parity_index(F.col("stripe_row"))
    col = F.col("data_col")
    q = (p + 1) % n
    sym = F.when(F.col("level") == 5, (p + 1 + col) % n).otherwise((q + 1 + col) % n)
    lo, hi = F.least(p, q), F.greatest(p, q)
    step5 = F.when(col < p, col).otherwise(col + 1)
    step6 = col + F.when(col >= lo, 1).otherwise(0)
    step6 = (step6 + F.when(step6 >= hi, 1).otherwise(0)) % n
    asym = F.when(F.col("level") == 5, step5).otherwise(step6)
    member = F.when(F.col("level") == 0, col).when(F.col("layout").endswith("_symmetric"), sym).otherwise(asym)
    return (out.withColumn("member_idx", member.cast("int"))
            .withColumn("member_lba", F.col("data_offset") + F.col("stripe_row") * F.col("chunk") + F.col("offset_in_chunk")))


def capacity() -> Column:
    """RAID-2: addressable sectors."""
    usable = F.greatest(F.col("capacity") - F.col("data_offset"), F.lit(0))
    return (F.floor(usable / F.col("chunk")) * F.col("chunk") * data_disks()).cast("bigint")


def _placed(members: DataFrame, geometry: DataFrame) -> DataFrame:
    """Stripe row, role column of every member block; parity blocks have a null ``data_col``."""
    m = members.join(geometry.select("array_id", *G), "array_id").where("lba >= data_offset")
    m = m.withColumn("stripe_row", F.floor((F.col("lba") - F.col("data_offset")) / F.col("chunk")).cast("bigint"))
    p = parity_index(F.col("stripe_row"))
    n, i = F.col("n_members"), F.col("member_idx")
    q = (p + 1) % n
    is_p = (F.col("level") >= 5) & (i == p)
    is_q = (F.col("level") == 6) & (i == q)
    sym = F.when(F.col("level") == 5, F.pmod(i - p - 1, n)).otherwise(F.pmod(i - q - 1, n))
    asym = i - F.when(i > p, 1).otherwise(0) - F.when((F.col("level") == 6) & (i > q), 1).otherwise(0)
    col = F.when(F.col("level") == 0, i).when(F.col("layout").endswith("_symmetric"), sym).otherwise(asym)
    return m.withColumn("role", F.when(is_p, "P").when(is_q, "Q").otherwise("D")).withColumn(
        "data_col", F.when(~(is_p | is_q), col).cast("int"))


def assemble(members: DataFrame, geometry: DataFrame) -> DataFrame:
    """RAID-3: logical sectors of the data blocks at hand: the inverse mapping, without a join."""
    m = _placed(members, geometry).where("role = 'D'")
    off = (F.col("lba") - F.col("data_offset")) % F.col("chunk")
    lba = (F.col("stripe_row") * data_disks() + F.col("data_col")) * F.col("chunk") + off
    return m.select("array_id", lba.cast("bigint").alias("array_lba"), "payload")


def stripes(members: DataFrame, geometry: DataFrame) -> DataFrame:
    """One row per (array, member lba): data columns, P and Q at hand; at most n_members blocks."""
    m = _placed(members, geometry)
    d = F.when(F.col("role") == "D", F.struct("data_col", "payload"))
    return m.groupBy("array_id", "lba", "stripe_row", *G).agg(
        F.collect_list(d).alias("data"), F.max(F.when(F.col("role") == "P", F.col("payload"))).alias("p"),
        F.max(F.when(F.col("role") == "Q", F.col("payload"))).alias("q"))


def grid(geometry: DataFrame) -> DataFrame:
    """Every (array, member lba) that the geometry addresses, in runs of 4096 blocks."""
    usable = (F.floor(F.greatest(F.col("capacity") - F.col("data_offset"), F.lit(0)) / F.col("chunk")) * F.col("chunk")).cast("bigint")
    runs = (geometry.select("array_id", *G, usable.alias("_u")).where("_u > 0")
            .withColumn("_r", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_u") - 1) / 4096)))))
    at = F.explode(F.sequence(F.col("_r") * 4096, F.least((F.col("_r") + 1) * 4096, F.col("_u")) - 1))
    return (runs.withColumn("_at", at).withColumn("lba", F.col("_at") + F.col("data_offset"))
            .withColumn("stripe_row", F.floor(F.col("_at") / F.col("chunk")).cast("bigint")).drop("_u", "_r", "_at"))


def _columns(data) -> dict[int, np.ndarray]:
    pairs = [(x["data_col"], x["payload"]) if isinstance(x, dict) else (x[0], x[1]) for x in data]
    return {int(c): np.frombuffer(b, dtype=np.uint8) for c, b in pairs}


def _vector(b: bytes | None):
    return None if b is None else np.frombuffer(b, dtype=np.uint8)


def rebuild(members: DataFrame, geometry: DataFrame) -> DataFrame:
    """RAID-4 and RAID-5: absent data blocks of every stripe, or ``recoverable = false``.

    Level 5 and one gap: XOR. Level 6: by P, by Q, or two data blocks by P and Q.
    Level 0, or more gaps than parity: not recoverable. Stripes of which no member holds anything come from the
    geometry, so they are reported too.
    """
    held = stripes(members, geometry).select("array_id", "lba", "data", "p", "q")
    s = grid(geometry).join(held, ["array_id", "lba"], "left").withColumn("d", data_disks().cast("int"))
    s = s.withColumn("data", F.coalesce("data", F.array().cast("array<struct<data_col:int,payload:binary>>")))
    s = s.where(F.size("data") < F.col("d"))

    @F.pandas_udf("array<struct<data_col:int,payload:binary>>")
    def fill(width: pd.Series, data: pd.Series, p: pd.Series, q: pd.Series) -> pd.Series:
        out = []
        for d, rows, pb, qb in zip(width, data, p, q):
            have = _columns(rows)
            missing = [c for c in range(d) if c not in have]
            none_left = not have and pb is None and qb is None
            got = None if none_left else gf256.solve(have, missing, _vector(pb), _vector(qb))
            out.append([{"data_col": c, "payload": None if got is None else got[c].tobytes()} for c in missing])
        return pd.Series(out)

    f = s.withColumn("_x", F.explode(fill("d", "data", "p", "q"))).select(
        "array_id", "lba", "stripe_row", *G, "_x.*")
    off = (F.col("lba") - F.col("data_offset")) % F.col("chunk")
    f = f.withColumn("array_lba", (F.col("stripe_row") * data_disks() + F.col("data_col")) * F.col("chunk") + off)
    return map_lba(f).select("array_id", "member_idx", "lba", F.col("array_lba").cast("bigint").alias("array_lba"), "payload",
                             F.col("payload").isNotNull().alias("recoverable"))


def xor_rebuild(members: DataFrame, geometry: DataFrame) -> DataFrame:
    """RAID-4: levels 0 and 5."""
    return rebuild(members, geometry.where("level < 6"))


def pq_rebuild(members: DataFrame, geometry: DataFrame) -> DataFrame:
    """RAID-5: level 6."""
    return rebuild(members, geometry.where("level = 6"))


def _parities():
    @F.pandas_udf("struct<p:binary,q:binary>")
    def both(level: pd.Series, data: pd.Series) -> pd.DataFrame:
        cols = [_columns(x) for x in data]
        return pd.DataFrame({"p": [gf256.p_of(c).tobytes() if v >= 5 and c else None for v, c in zip(level, cols)],
                             "q": [gf256.q_of(c).tobytes() if v == 6 and c else None for v, c in zip(level, cols)]})
    return both


def parity_blocks(members: DataFrame, geometry: DataFrame) -> DataFrame:
    """P and Q member blocks of complete stripes, computed from their data blocks."""
    s = stripes(members, geometry).withColumn("_pq", _parities()("level", "data"))
    p = parity_index(F.col("stripe_row"))
    pick = F.explode(F.array(F.struct(p.alias("member_idx"), F.col("_pq.p").alias("payload")),
                             F.struct(((p + 1) % F.col("n_members")).cast("int").alias("member_idx"), F.col("_pq.q").alias("payload"))))
    return s.withColumn("_x", pick).select("array_id", "_x.member_idx", "lba", "_x.payload").where("payload IS NOT NULL")


def parity_scrub(members: DataFrame, geometry: DataFrame) -> DataFrame:
    """RAID-6: complete stripe rows whose stored parity differs from the recomputed one."""
    s = stripes(members, geometry).where((F.col("level") >= 5) & (F.size("data") == data_disks()))
    s = s.withColumn("_pq", _parities()("level", "data"))
    bad_p = F.col("p").isNotNull() & (F.col("p") != F.col("_pq.p"))
    bad_q = F.col("q").isNotNull() & (F.col("q") != F.col("_pq.q"))
    return s.select("array_id", "lba", "stripe_row", F.coalesce(bad_p, F.lit(False)).alias("p_differs"),
                    F.coalesce(bad_q, F.lit(False)).alias("q_differs")).where("p_differs OR q_differs")


def member_order(superblocks: DataFrame) -> DataFrame:
    """JN-17: slots of the members that share the primary's set id, absent slots with a null member.

    ``superblocks``: array_id, candidate, set_uuid, dev_number, raid_disks. The first
    candidate is the primary; of two candidates for one slot the later one stays.
    """
    prime = superblocks.groupBy("array_id").agg(F.min_by(F.struct("set_uuid", "raid_disks"), "candidate").alias("_p")).select(
        "array_id", F.col("_p.set_uuid").alias("set_uuid"), F.col("_p.raid_disks").alias("disks"))
    mine = (superblocks.join(prime, ["array_id", "set_uuid"]).where(F.col("dev_number") < F.col("disks"))
            .groupBy("array_id", F.col("dev_number").alias("slot")).agg(F.max("candidate").alias("candidate")))
    slots = prime.where("disks > 0").select("array_id", F.explode(F.sequence(F.lit(0), F.col("disks") - 1)).alias("slot"))
    return slots.join(mine, ["array_id", "slot"], "left").withColumn("missing", F.col("candidate").isNull())
