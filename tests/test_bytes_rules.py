import math
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from blocklens.functions import payload as kern
from blocklens.functions import rules
from blocklens.operators import acquire, byte_stats, filters, wipe

CASES = [b"", b"A", bytes(1024), os.urandom(1024), b"plain ascii text, " * 50, bytes(range(256)) * 3, b"\xff\x00" * 33]


def plain_features(data: bytes) -> list[float]:
    """Straightforward restatement used only to check the vectorised kernels."""
    n = len(data)
    if n == 0:
        return [0.0] * 280
    ent = lambda d: -sum(c / len(d) * math.log2(c / len(d)) for c in Counter(d).values())
    counts = Counter(data)
    out = [counts[i] / n for i in range(256)]
    size = max(n // 16, 1)
    for i in range(16):
        part = data[i * size:] if i == 15 else data[i * size:(i + 1) * size]
        out.append(ent(part) if part else 0.0)
    pairs = Counter(zip(data, data[1:]))
    if n > 1:
        p = [c / (n - 1) for c in pairs.values()]
        mean = sum(p) / len(p)
        out += [(65536 - len(p)) / 65536, sum(sorted(pairs.values())[-10:]) / (n - 1), -sum(x * math.log2(x) for x in p), 1 / len(p),
                sum((x - mean) ** 2 for x in p) / len(p), len(p) / 65536]
    else:
        out += [1.0, 0, 0, 0, 0, 0]
    run = best = 0
    for b in data:
        run = run + 1 if 0x20 <= b <= 0x7E or b in (9, 10, 13) else 0
        best = max(best, run)
    out.append(math.log2(best + 1) / math.log2(n + 1))
    chi = sum((counts[i] - n / 256) ** 2 / (n / 256) for i in range(256))
    out.append(min(max(math.log10(chi + 1) / 10, 0), 1))
    return out


def test_feature_parity(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(CASES)], "i int, payload binary")
    got = {r["i"]: r["features"] for r in byte_stats.feature_vector(df, ["i"]).collect()}
    for i, c in enumerate(CASES):
        assert got[i] == pytest.approx(plain_features(c), abs=1e-9)
    assert len(kern.FEATURE_NAMES) == 280


def test_zero_and_uniform(spark):
    df = spark.createDataFrame([(0, bytes(16)), (1, b"zz"), (2, b"za")], "i int, payload binary")
    got = df.select("i", byte_stats.is_zero().alias("z"), byte_stats.is_uniform().alias("u")).collect()
    assert [(r["z"], r["u"]) for r in got] == [(True, True), (False, True), (False, False)]


def test_health_thresholds(spark):
    cols = "kind string, critical_warnings int, spare_percent int, percentage_used int, media_errors int, temperature int, uncorrectable int, pending int, reallocated int"
    data = [("nvme", 0, 100, 0, 0, 30, 0, 0, 0), ("nvme", 0, 19, 0, 0, 30, 0, 0, 0), ("nvme", 0, 100, 95, 0, 30, 0, 0, 0), ("nvme", 0, 100, 0, 0, 70, 0, 0, 0),
            ("nvme", 0, 9, 0, 0, 30, 0, 0, 0), ("nvme", 0, 100, 0, 11, 30, 0, 0, 0), ("hdd", 0, 0, 0, 0, 54, 0, 0, 0), ("hdd", 0, 0, 0, 0, 55, 0, 0, 0),
            ("hdd", 0, 0, 0, 0, 30, 0, 5, 50), ("hdd", 0, 0, 0, 0, 30, 0, 6, 0), ("hdd", 0, 0, 0, 0, 30, 1, 0, 0), ("none", 0, 0, 0, 0, 0, 0, 0, 0)]
    got = [r[0] for r in spark.createDataFrame(data, cols).coalesce(1).select(rules.health_status()).collect()]
    assert got == ["Good", "Warning", "Warning", "Warning", "Critical", "Critical", "Good", "Warning", "Warning", "Critical", "Critical", "Unknown"]


def test_assurance(spark):
    data = [(True, True, True, True, True, "Hdd", "HostOverwriteSinglePass"), (True, True, True, True, True, "SataSsd", "HostOverwriteSinglePass"),
            (True, True, True, True, True, "SataSsd", None), (True, True, True, True, False, "Hdd", None), (False, True, True, True, True, "Hdd", None),
            (True, False, True, True, True, "Hdd", None), (True, True, False, True, True, "Hdd", None)]
    df = spark.createDataFrame(data, "l1 boolean, l2 boolean, l3 boolean, l4 boolean, l5 boolean, media_type string, method string").coalesce(1)
    assert [r["assurance"] for r in wipe.overall_assurance(df).collect()] == ["HIGH", "MEDIUM", "HIGH", "FAILED", "FAILED", "MEDIUM", "LOW"]


def test_residual_states(spark):
    data = [(True, True, True, 0, "x"), (True, True, True, 2, None), (True, True, True, 0, None), (True, False, True, 0, None), (False, True, True, 0, None)]
    df = spark.createDataFrame(data, "d boolean, m boolean, j boolean, t int, e string").coalesce(1)
    got = [r[0] for r in df.select(rules.residual_state(*[F.col(c) for c in "dmjte"])).collect()]
    assert got == ["UnableToVerify", "ResidualTracesDetected", "Sanitized", "PartiallySanitized", "ResidualTracesDetected"]


def test_statistical_check_sample(spark):
    data = [("clean", i, bytes(8)) for i in range(3000)] + [("dirty", i, b"ab" * 4) for i in range(3000)] + [("tiny", 0, bytes(8))]
    df = spark.createDataFrame(data, "image_id string, lba bigint, payload binary")
    tot = df.groupBy("image_id").agg(F.count(F.lit(1)).alias("total_blocks"))
    got = {r["image_id"]: r for r in wipe.statistical_check(df, tot, ["image_id"]).collect()}
    assert got["clean"]["passed"] and got["clean"]["sampled"] == got["clean"]["sample_size"] == 286
    assert not got["dirty"]["passed"] and got["dirty"]["non_conforming"] == 286
    assert got["tiny"]["sample_size"] == 1


def test_digest_of_ordered_chunks(spark):
    import hashlib
    data = [(i % 3, i, bytes([i]) * 700) for i in range(60)]
    df = spark.createDataFrame(data, "image_id int, chunk_no bigint, payload binary").repartition(7)
    got = {r["image_id"]: (r["bytes"], r["image_hash"]) for r in acquire.image_digest(df, ["image_id"]).collect()}
    for img in range(3):
        body = b"".join(p for i, _, p in data if i == img)
        assert got[img] == (len(body), hashlib.sha256(body).hexdigest())


def test_placeholder_and_bounds(spark):
    s = spark.createDataFrame([("i", n, b"data") for n in range(3)], "image_id string, lba bigint, payload binary")
    bad = spark.createDataFrame([("i", 1, 1)], "image_id string, start_lba bigint, block_count bigint")
    got = {r["lba"]: bytes(r["payload"]) for r in acquire.fill_placeholder(s, bad, ["image_id"]).collect()}
    assert got[1] == acquire.PLACEHOLDER * 32 and got[0] == b"data"
    zero = {r["lba"]: bytes(r["payload"]) for r in acquire.fill_placeholder(s, bad, ["image_id"], b"").collect()}
    assert zero[1] == bytes(512)
    plan = spark.createDataFrame([("a", "Physical", 10, 5, 7), ("b", "Partial", 10, 5, 70)], "image_id string, kind string, total_blocks bigint, want_start bigint, want_end bigint")
    assert [(r["start_lba"], r["end_lba"]) for r in acquire.profile_bounds(plan).orderBy("image_id").collect()] == [(0, 9), (5, 9)]
    chunks = acquire.chunk_plan(acquire.profile_bounds(plan), ["image_id"], 4).orderBy("image_id", "chunk_no").collect()
    assert [(r["image_id"], r["start_lba"], r["block_count"]) for r in chunks] == [("a", 0, 4), ("a", 4, 4), ("a", 8, 2), ("b", 5, 4), ("b", 9, 1)]


def test_fingerprint_ignores_interface_and_case(spark):
    data = [(" sn1 ", "Model x", 10, "SATA", b"s"), ("SN1", "MODEL X", 10, "USB", b"s"), ("SN1", "MODEL X", 11, "USB", b"s"), ("SN1", "MODEL X", 10, "USB", b"t")]
    df = spark.createDataFrame(data, "serial string, model string, capacity_bytes bigint, interface string, boundary_sample binary").coalesce(1)
    a, b, c, e = [r["fingerprint"] for r in filters.device_fingerprint(df).collect()]
    assert a == b and len({a, c, e}) == 3


def test_boot_blocks_stay_where_they_lie(spark):
    """Only numbers of fixed width are grouped: no sort aggregation over blocks; a missing boot block is no row, a short one has a kind."""
    boot = bytes(510) + b"\x55\xaa"
    gpt = bytes(450) + b"\xee" + bytes(59) + b"\x55\xaa"
    magic = bytes(56) + b"\x53\xef" + bytes(454)
    data = [("g", 0, gpt), ("g", 1, b"EFI PART" + bytes(504)), ("p", 0, gpt), ("p", 1, bytes(512)), ("q", 0, gpt), ("m", 0, boot), ("s", 0, b"x"), ("none", 1, boot), ("null", 0, None),
            ("e", 0, bytes(512)), ("e", 2, magic), ("n", 0, b"EB0NTFS    " + bytes(501)), ("n", 2, magic), ("a", 0, bytes(32) + b"NXSB" + bytes(476)), ("a", 2, magic)]
    df = spark.createDataFrame(data, "image_id string, lba bigint, payload binary")
    kinds, systems = filters.partition_table_kind(df, ["image_id"]), filters.detect_filesystem(df, ["image_id"])
    for got in (kinds, systems):
        assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
    raw = "Raw / Unpartitioned"
    assert {r[0]: r[1] for r in kinds.collect()} == {
        "g": "GPT (GUID Partition Table)", "p": "GPT (Protective MBR detected)", "q": "GPT (Protective MBR detected)", "m": "MBR (Master Boot Record)", "s": "Raw / Unknown", "e": raw, "n": raw, "a": raw}
    assert {r[0]: r[1] for r in systems.collect()} == {"g": "Unknown", "p": "Unknown", "q": "Unknown", "m": "Unknown", "s": "Unknown", "e": "ext4", "n": "NTFS", "a": "ext4"}


def test_statistical_check_moves_the_sample_only(spark):
    """Two media of 200,000 blocks: what is shuffled follows the sample, not the media; one with absent blocks is ranked whole and fails."""
    from test_carve import _shuffled
    df = spark.range(400000).selectExpr("id % 2 as image_id", "id div 2 as lba", "unhex(repeat('00', 32)) as payload")
    tot = spark.createDataFrame([(0, 200000), (1, 200000), (2, 30)], "image_id bigint, total_blocks bigint")
    before = _shuffled(spark)
    got = {r["image_id"]: r for r in wipe.statistical_check(df.unionByName(df.where("image_id = 0 AND lba < 5").withColumn("image_id", F.lit(2).cast("bigint"))), tot, ["image_id"]).collect()}
    assert _shuffled(spark) - before < 1 << 20
    assert got[0]["passed"] and got[1]["passed"] and got[0]["sampled"] == got[0]["sample_size"] > 290
    assert got[2]["sampled"] == 5 and not got[2]["passed"] and got[2]["non_conforming"] == got[2]["sample_size"] - 5


@pytest.mark.parametrize("name", ["byt07_feature_summary", "byt01_byte_histogram"])
def test_shares_at_exact_halves_round_as_sql_does(spark, tmp_path, name):
    """41 of 640 bytes are half a unit of the sixth digit; documents without bytes or id have no summary."""
    import duckdb

    import __spark_entry__ as entry
    import oracle
    rest = "bcdefghijklmnopqrstu"
    texts = ["a" * k + "".join(rest[i % 20] for i in range(n - k)) for k, n in ((41, 640), (82, 1280), (123, 1920), (7, 160), (9, 160), (1, 128), (3, 128), (1, 3))]
    texts += ["a" * k + "b" * (n - k) for k in range(1, 160) for n in (160, 800)] + ["", None, "x"]
    rows = [(i, t, "s0") for i, t in enumerate(texts)] + ([(None, "no id", "s0")] if name.startswith("byt07") else [])
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    res = oracle.compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], str(tmp_path))
    assert res.startswith("ok"), res
