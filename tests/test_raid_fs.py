import random

import pytest
from pyspark.sql import functions as F

from blocklens.functions import gf256
from blocklens.operators import fsmeta, raid

SECTOR = 32


def layout(spark, level, name, n, gone=(), logical=96, chunk=2, offset=3):
    g = spark.createDataFrame([(1, level, name, chunk, n, offset, 200)],
                              "array_id bigint, level int, layout string, chunk int, n_members int, data_offset bigint, capacity bigint")
    rng = random.Random(level * 10 + n)
    blocks = [(1, i, bytes(rng.randrange(256) for _ in range(SECTOR))) for i in range(logical)]
    lg = spark.createDataFrame(blocks, "array_id bigint, array_lba bigint, payload binary")
    data = raid.map_lba(lg.join(g, "array_id")).selectExpr("array_id", "member_idx", "member_lba AS lba", "payload")
    m = data.unionByName(raid.parity_blocks(data, g)).where(~data.member_idx.isin(list(gone)) if gone else "true")
    return m, g, {b[1]: b[2] for b in blocks}


@pytest.mark.parametrize("level,name,n,gone", [
    (0, "left_symmetric", 4, ()), (5, "right_asymmetric", 5, (0,)), (6, "left_symmetric", 5, (1, 2)), (6, "right_asymmetric", 5, (2, 3))])
def test_degraded_arrays_read_whole(spark, level, name, n, gone):
    m, g, want = layout(spark, level, name, n)
    if gone:
        m = m.where(~m.member_idx.isin(list(gone)))
    whole = raid.assemble(m, g).unionByName(raid.rebuild(m, g).where("recoverable").select("array_id", "array_lba", "payload")).collect()
    assert {r["array_lba"]: bytes(r["payload"]) for r in whole} == want and len(whole) == len(want)


@pytest.mark.parametrize("level,n,gone", [(0, 4, (1,)), (6, 5, (0, 1, 2))])
def test_too_many_gone(spark, level, n, gone):
    m, g, _ = layout(spark, level, "left_symmetric", n)
    got = raid.rebuild(m.where(~m.member_idx.isin(list(gone))), g)
    assert got.where("NOT recoverable").count() > 0


def test_lost_stripe_is_reported(spark):
    """A stripe of which no member holds anything is on the geometry's grid and not recoverable."""
    m, g, want = layout(spark, 5, "left_symmetric", 4)
    g = g.withColumn("capacity", F.lit(3 + 32).cast("bigint"))
    got = raid.rebuild(m.where("lba < 3 + 4 OR lba >= 3 + 6"), g).collect()
    assert sorted(r["array_lba"] for r in got) == list(range(12, 18)) and not any(r["recoverable"] for r in got)


def test_field_inverse():
    assert all(gf256.EXP[gf256.LOG[a] + gf256.LOG[gf256.inverse(a)]] == 1 for a in range(1, 256))
    assert gf256.power(8) == 0x1D


def test_chain_flags(spark):
    t = spark.createDataFrame([("v", 2, 3), ("v", 3, 4), ("v", 4, None), ("v", 10, 11), ("v", 11, 12), ("v", 12, 10), ("v", 20, 999)], "volume string, cluster bigint, next bigint")
    s = spark.createDataFrame([("v", 1, 2), ("v", 2, 10), ("v", 3, 20), ("v", 4, 3), ("v", 5, 1), ("v", 6, 50)], "volume string, file_id bigint, start bigint")
    rows = fsmeta.follow_chain(t, s, 100, ["volume"]).collect()
    by = {}
    for r in sorted(rows, key=lambda r: r["pos"]):
        by.setdefault(r["file_id"], []).append((r["cluster"], r["looped"], r["out_of_range"]))
    assert [c for c, *_ in by[1]] == [2, 3, 4] and not any(x[1] for x in by[1])
    assert [c for c, *_ in by[2]] == [10, 11, 12] and all(x[1] for x in by[2])
    assert by[3] == [(20, False, True)] and [c for c, *_ in by[4]] == [3, 4] and 5 not in by and [c for c, *_ in by[6]] == [50]


def test_paths_stop_at_cycles(spark):
    d = spark.createDataFrame([("v", 0, 1, "a", True, False), ("v", 1, 2, "b", True, False), ("v", 2, 1, "a2", True, False), ("v", 2, 9, "f", False, False),
                               ("v", 0, 3, "gone", True, True), ("v", 3, 4, "x", False, False)], "volume string, dir_id int, entry_id int, name string, is_dir boolean, unlinked boolean")
    roots = spark.createDataFrame([("v", 0)], "volume string, dir_id int")
    assert sorted(r["path"] for r in fsmeta.build_paths(d, roots, ["volume"]).collect()) == ["/a", "/a/b", "/a/b/a2", "/a/b/f", "/gone"]


def test_zeroed_chain_falls_back_to_run(spark):
    fat = spark.createDataFrame([("v", c, n) for c, n in [(2, 0), (3, 0), (4, 9), (9, None), (5, 0), (6, 7), (7, None)]], "volume string, cluster bigint, next bigint")
    vol = spark.createDataFrame([("v", 512, 8)], "volume string, cluster_bytes int, total_clusters bigint")
    e = spark.createDataFrame([("v", 1, 2, 1000), ("v", 2, 6, 5000), ("v", 3, 3, 5000)], "volume string, entry_id bigint, start_cluster bigint, size bigint")
    got = fsmeta.deleted_extents(e, fat, vol, ["volume"])
    by = {}
    for r in got.orderBy("pos").collect():
        by.setdefault(r["entry_id"], []).append(r["cluster"])
    assert by == {1: [2, 3], 2: [6, 7], 3: [3, 4, 5, 6, 7, 8, 9]}
    conf = {r["entry_id"]: r["confidence"] for r in fsmeta.deleted_confidence(got, ["volume"]).collect()}
    assert conf == {1: "Confirmed", 2: "Partial", 3: "Partial"}


def plain_paths(rows, roots):
    """Breadth first; a directory is entered once, through the first path of its level."""
    level, seen, out, depth = {r: "" for r in roots}, set(roots), [], 0
    while level:
        depth += 1
        found = [(e, d, u, f"{level[a]}/{n}") for a, e, n, d, u in rows if a in level]
        out += [(e, p, depth) for e, _, _, p in found]
        level = {}
        for e, d, u, p in found:
            if d and not u and e not in seen:
                level[e] = min(p, level.get(e, p))
        seen |= set(level)
    return sorted(out)


def test_paths_of_deep_trees_cycles_and_second_links(spark):
    import random
    rng = random.Random(4)
    rows = [(i, i + 1, f"d{i}", True, False) for i in range(150)]  # one long branch
    rows += [(rng.randrange(150), 1000 + i, f"x{i}", i % 3 > 0, i % 7 == 0) for i in range(120)]
    rows += [(1000 + i, 2000 + i, f"f{i}", False, False) for i in range(120)]
    rows += [(rng.randrange(150), 3000 + i % 9, f"m{i}", True, False) for i in range(27)]  # several links, some to each other
    rows += [(3000 + i, 3000 + (i + 1) % 9, "next", True, False) for i in range(9)] + [(3004, 0, "back to the root", True, False), (3005, 40, "up", True, False)]
    rows += [(5000, 5001, "a", True, False), (5001, 5002, "b", True, False), (5002, 5000, "c", True, False), (5001, 5003, "lost", False, False)]  # reached from nowhere
    rows += [(6000, 6001, "dangling", True, False), (6001, 6002, "too", False, False)]
    df = spark.createDataFrame([(1, *r) for r in rows], "volume int, dir_id long, entry_id long, name string, is_dir boolean, unlinked boolean")
    got = fsmeta.build_paths(df, spark.createDataFrame([(1, 0)], "volume int, dir_id long"), ["volume"])
    assert sorted((r["entry_id"], r["path"], r["depth"]) for r in got.collect()) == plain_paths(rows, [0])
    assert fsmeta.build_paths(df.limit(0), spark.createDataFrame([(1, 0)], "volume int, dir_id long"), ["volume"]).count() == 0
