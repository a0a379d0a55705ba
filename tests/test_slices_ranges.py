import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from blocklens.operators import ranges, slices
from blocklens.session import cut_lineage


def rows(spark, n=2000, seed=3):
    """One key holds more than half of all rows."""
    rng = random.Random(seed)
    data = [("hot" if rng.random() < 0.6 else rng.choice("abc"), i, rng.randint(0, 50)) for i in rng.sample(range(100_000), n)]
    return spark.createDataFrame(data, "k string, at bigint, v bigint")


def same(a, b):
    return sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_sliced_windows_equal_plain_windows(spark):
    df = rows(spark)
    w = Window.partitionBy("k").orderBy("at")
    cut = slices.by_width("at", 700)
    assert same(slices.previous_row(df, ["k"], ["at"], cut, {"p": "v"}).select("k", "at", "p"),
                df.select("k", "at", F.lag("v").over(w).alias("p")))
    assert same(slices.running_total(df, ["k"], ["at"], cut, F.col("v"), "s").select("k", "at", "s"),
                df.select("k", "at", F.sum("v").over(w).alias("s")))
    assert same(slices.row_numbers(df, ["k"], ["at"], cut, "n").select("k", "at", "n"),
                df.select("k", "at", F.row_number().over(w).cast("bigint").alias("n")))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    assert same(slices.max_so_far(df, ["k"], ["at"], cut, F.col("v"), "m").select("k", "at", "m"),
                df.select("k", "at", F.max("v").over(before).alias("m")))


def test_sliced_fold_equals_sequential(spark):
    df = rows(spark, 800)

    def step(state, v):
        total = (0 if state is None else int(state[0])) * 3 % 101 + v
        return (str(total),), total

    got = slices.fold_slices(df, ["k"], ["at"], slices.by_width("at", 9000), step, ["v"], "out bigint", ["t"], cut_lineage)
    want = {}
    state = {}
    for k, at, v in sorted(map(tuple, df.collect())):
        state[k] = state.get(k, 0) * 3 % 101 + v
        want[k, at] = state[k]
    assert {(r["k"], r["at"]): r["out"] for r in got.collect()} == want


def test_point_and_overlap_joins_brute_force(spark):
    rng = random.Random(9)
    ext = [(rng.choice("xy"), rng.randint(0, 20_000), rng.randint(1, 9000)) for _ in range(60)]
    pts = [(rng.choice("xy"), rng.randint(0, 30_000)) for _ in range(400)]
    e = spark.createDataFrame(ext, "i string, start_lba bigint, block_count bigint")
    p = spark.createDataFrame(pts, "i string, lba bigint")
    inside = [x for x in pts if any(x[0] == i and s <= x[1] < s + c for i, s, c in ext)]
    assert sorted(map(tuple, ranges.points_in_ranges(p, e, ["i"], "left_semi", width=512).collect())) == sorted(inside)
    outside = [x for x in pts if x not in inside]
    assert sorted(map(tuple, ranges.points_in_ranges(p, e, ["i"], "left_anti", width=512).collect())) == sorted(outside)
    other = [(rng.choice("xy"), rng.randint(0, 25_000), rng.randint(1, 4000)) for _ in range(60)]
    a = spark.createDataFrame(other, "i string, a_start bigint, a_count bigint")
    b = e.withColumnsRenamed({"start_lba": "b_start", "block_count": "b_count"})
    want = sorted((x[0], x[1], x[2], y[1], y[2]) for x in other for y in ext
                  if x[0] == y[0] and x[1] < y[1] + y[2] and x[1] + x[2] > y[1])
    got = ranges.overlap_pairs(a, b, ["i"], width=1000).select("i", "a_start", "a_count", "b_start", "b_count")
    assert sorted(map(tuple, got.collect())) == want


def test_islands_across_slices(spark):
    edge = ranges.ISLAND_SLICE
    lbas = [1, 2, 3, 7, edge - 2, edge - 1, edge, edge + 1, 3 * edge, 3 * edge + 5]
    df = spark.createDataFrame([("i", x, f"e{x}") for x in lbas], "image_id string, lba bigint, error string")
    got = sorted((r["start_lba"], r["block_count"], r["error"], r["bytes"]) for r in ranges.merge_bad_ranges(df, ["image_id"]).collect())
    assert got == [(1, 3, "e1", 1536), (7, 1, "e7", 512), (edge - 2, 4, f"e{edge - 2}", 2048), (3 * edge, 1, f"e{3 * edge}", 512),
                   (3 * edge + 5, 1, f"e{3 * edge + 5}", 512)]


def test_storage_map_priority(spark):
    tot = spark.createDataFrame([("i", 1280)], "image_id string, total_blocks bigint")
    ext = spark.createDataFrame([("i", 0, 30, "allocated"), ("i", 5, 1, "bad_sector"), ("i", 10, 10, "artifact"), ("i", 1275, 500, "sanitized")],
                                "image_id string, start_lba bigint, block_count bigint, kind string")
    got = {r["segment"]: r["status"] for r in ranges.storage_map(tot, ext, ["image_id"]).collect()}
    assert [got[i] for i in (0, 1, 2, 3, 127)] == ["bad_sector", "artifact", "allocated", "unallocated", "sanitized"] and len(got) == 128


def _way(rows):
    met, until = [], None
    for at, to in sorted(rows):
        if until is None or at >= until:
            met.append(at)
            until = to
    return met


def test_hops_equal_the_plain_way(spark):
    """Dense and sparse ways, spans longer than slices, empty slices, a single row, over two keys."""
    import random

    from blocklens.session import cut_lineage
    rng = random.Random(3)
    data = {"dense": [(i, i + rng.randint(1, 9)) for i in range(2000)], "long": [(i * 3, i * 3 + rng.choice([1, 5, 700])) for i in range(900)],
            "gaps": [(i * i, i * i + rng.randint(1, 40)) for i in range(90)], "one": [(70, 71)], "ahead": [(5, 10**6), (6, 7), (10**6, 10**6 + 1)]}
    df = spark.createDataFrame([(k, a, b) for k, v in data.items() for a, b in v], "k string, at bigint, until bigint")
    got = {}
    for r in slices.hops(df, ["k"], "at", "until", 64, cut_lineage).collect():
        got.setdefault(r["k"], []).append(r["at"])
    assert {k: sorted(v) for k, v in got.items()} == {k: _way(v) for k, v in data.items()}


def test_next_mark_reads_frames_that_grow(spark):
    """One slice of 60,000 rows: linear, where a frame to the far end is read again for every row; a mark on the point itself counts."""
    import time
    points = spark.range(30000).selectExpr("'a' as k", "id * 2 as at")
    marks = spark.range(30000).selectExpr("'a' as k", "id * 2 + (id % 2) as at")
    got = slices.next_at_or_after(points, marks, ["k"], "at", 1 << 20, "next")
    assert "unboundedfollowing" not in got._jdf.queryExecution().executedPlan().toString().lower()
    t0 = time.time()
    rows = {r["at"]: r["next"] for r in got.collect()}
    assert rows[4] == 4 and rows[6] == 7 and rows[59998] == 59999 and len(rows) == 30000 and time.time() - t0 < 60


def test_hops_of_many_short_keys_take_one_pass(spark):
    """A call per slice cost over a millisecond each, in one task: most media hold a few objects."""
    rng = random.Random(8)
    data = [(2 ** 60 + k, at, at + rng.randint(1, 90)) for k in range(300) for at in rng.sample(range(400), rng.randint(1, 40))]
    df = spark.createDataFrame(data, "k bigint, at bigint, until bigint")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")  # slices cross batches
    try:
        got = slices.hops(df, ["k"], "at", "until", 64, cut_lineage)
        assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()
        met = sorted((r["k"], r["at"]) for r in got.collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    want, end = [], {}
    for k, at, until in sorted(data):
        if at >= end.get(k, 0):
            want.append((k, at))
            end[k] = until
    assert met == want
