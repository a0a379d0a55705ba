from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from blocklens.operators import ledger, reports, slices

SCHEMA = "event_id bigint, case_id string, timestamp_utc string, operator_id string, operation string, target_descriptor string, result string"


def events(spark, n=9, case="c1", first=1):
    rows = [(first + i, case, f"2026-01-01T00:00:{i:02d}+00:00", "op", "Acquire", f'disk "{i}"', "SUCCESS") for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def cut():
    return slices.by_width("event_id", 4)


def verdict(df):
    r = ledger.verify_chain(df, ["case_id"], 4).first()
    return r["is_valid"], r["failure"], r["failed_seq"]


@pytest.fixture(scope="module")
def chain(spark):
    return ledger.append_chain(
        events(spark), ["case_id"], ["event_id"], cut())


def test_intact_chain(chain):
    assert verdict(chain) == (True, None, None)


def test_edit_delete_reorder_relink(chain):
    assert verdict(chain.withColumn("result", F.when(F.col("seq") == 4, "EDITED").otherwise(F.col("result")))) == (False, "mismatch", 4)
    assert verdict(chain.where("seq <> 5")) == (False, "gap", 6)
    swapped = chain.withColumn("seq", F.when(F.col("seq") == 3, 4).when(F.col("seq") == 4, 3).otherwise(F.col("seq")))
    assert verdict(swapped)[:2] == (False, "broken")
    assert verdict(chain.withColumn("prev_hash", F.when(F.col("seq") == 7, F.lit("e" * 64)).otherwise(F.col("prev_hash")))) == (False, "broken", 7)


def test_append_continues_head(spark, chain):
    heads = ledger.chain_head(chain, ["case_id"])
    more = ledger.append_chain(events(spark, 3, first=10), ["case_id"], ["event_id"], cut(), heads)
    whole = chain.unionByName(more)
    assert verdict(whole) == (True, None, None)
    assert ledger.chain_head(whole, ["case_id"]).first()["latest_seq"] == 12


def test_anchor_detects_rewrite(spark, chain):
    old = ledger.chain_head(chain, ["case_id"]).select("case_id", F.col("latest_seq").alias("seq"), F.col("latest_hash").alias("head_hash"))
    edited = events(spark).withColumn("operator_id", F.when(F.col("event_id") == 2, "other").otherwise(F.col("operator_id")))
    rewritten = ledger.append_chain(edited, ["case_id"], ["event_id"], cut())
    assert verdict(rewritten) == (True, None, None)
    status = lambda df: ledger.anchor_check(old, df, ["case_id"]).first()["status"]
    assert (status(chain), status(rewritten), status(chain.where("seq < 9"))) == ("consistent", "rewritten", "deleted")


def test_report_checks_mutations(spark, chain):
    cols = [*ledger.HASHED, "prev_hash", "entry_hash"]
    seg = chain.where("seq > 4").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("audit_chain_segment"))
    base = seg.select(F.lit("r").alias("report_id"), "audit_chain_segment", F.lit("{}").alias("content_json"), F.sha2(F.lit("{}"), 256).alias("content_sha256"),
                      F.lit(False).alias("is_rfc3161"), F.lit(None).cast("string").alias("token"), F.lit(None).cast("string").alias("tsa_url"),
                      F.lit("Local timestamp").alias("status_label"), F.array(F.struct(F.lit("AB").alias("sha256_hash"))).alias("evidence_manifest"),
                      F.lit("ab").alias("evidence_hash"))
    got = lambda df: reports.report_checks(df).first()
    assert got(base)["overall"]
    assert not got(base.withColumn("content_json", F.lit("{ }")))["content_ok"]
    assert not got(base.withColumn("status_label", F.lit("sometime")))["timestamp_ok"]
    assert not got(base.withColumn("is_rfc3161", F.lit(True)))["timestamp_ok"]
    assert not got(base.withColumn("evidence_hash", F.lit("cd")))["manifest_ok"]
    assert not got(base.withColumn("audit_chain_segment", F.slice("audit_chain_segment", 9, 1)))["segment_ok"]
    holed = base.withColumn("audit_chain_segment", F.filter("audit_chain_segment", lambda e: e["seq"] != 7))
    assert not got(holed)["segment_ok"]


T0 = datetime(2026, 1, 1)


def custody(spark, rows):
    data = [(i + 1, "e", kind, T0 + timedelta(hours=h), a, b, None) for i, (kind, h, a, b) in enumerate(rows)]
    return spark.createDataFrame(data, "event_id bigint, evidence_id string, event_type string, ts timestamp, from_party string, to_party string, location string")


@pytest.mark.parametrize("rows,want", [
    ([("Seized", 0, None, "x"), ("Transferred", 1, "x", "y"), ("AnalysisStarted", 2, None, None), ("Returned", 3, "y", None)], [None] * 4),
    ([("Transferred", 0, "x", "y"), ("Received", 1, None, "y")], ["invalid_initial", None]),
    ([("Seized", 0, None, "x"), ("Transferred", 1, "x", None)], [None, "missing_parties"]),
    ([("Seized", 0, None, "x"), ("Disposed", 1, None, None), ("Received", 2, None, "y")], [None, None, "after_terminal"]),
    ([("Seized", 5, None, "x"), ("StorageChange", 1, None, None), ("StorageChange", 6, None, None)], [None, "time_backwards", None])])
def test_custody_admission(spark, rows, want):
    got = ledger.custody_admit(custody(spark, rows), slice_width=2).orderBy("event_id").collect()
    assert [r["reason"] for r in got] == want


def test_recorded_violation_looks_at_previous_only(spark):
    df = custody(spark, [("Transferred", 0, "x", "y"), ("StorageChange", 1, None, None), ("Returned", 2, None, None), ("StorageChange", 3, None, None)])
    got = ledger.custody_violations(df).orderBy("event_id").collect()
    assert [r["violation"] for r in got] == ["invalid_initial", None, None, "after_terminal"]


def test_current_keeps_last_known(spark):
    df = custody(spark, [("Seized", 0, None, "x"), ("Transferred", 1, "x", "y"), ("AnalysisStarted", 2, None, None)]).withColumn(
        "location", F.when(F.col("event_id") == 1, "locker"))
    r = ledger.custody_current(df).first()
    assert (r["current_owner"], r["current_location"]) == ("y", "locker")


def test_paged_report_is_whole(spark):
    df = spark.range(2500).select(F.when(F.col("id") % 10 < 7, "hot").otherwise("cold").alias("case_id"), F.col("id").alias("artifact_id"))
    pages = reports.paged(df, ["case_id"], ["artifact_id"], F.col("artifact_id"), "items", 100, slice_width=300).collect()
    assert max(len(p["items"]) for p in pages) == 100 and sum(len(p["items"]) for p in pages) == 2500
    hot = [x for p in sorted((p for p in pages if p["case_id"] == "hot"), key=lambda p: p["part"]) for x in p["items"]]
    assert hot == sorted(hot)


def test_admission_equals_the_sequential_fold(spark):
    import random
    rng, rows = random.Random(11), []
    kinds = ["Seized", "Received", "Transferred", "Analyzed", "Stored", "Returned"]
    for item in range(40):
        for k in range(rng.randrange(60)):
            kind = rng.choices(kinds, [2, 1, 4, 4, 4, 0.15 if item % 2 else 2])[0]
            at = None if rng.random() < 0.1 else 1_600_000_000 + k * 60 + rng.randrange(-200, 200)
            rows.append((f"e{item}", item * 1000 + k * 3, kind, None if at is None else at, rng.choice([None, "a"]), rng.choice([None, "b", "c"])))
    df = spark.createDataFrame(rows, "evidence_id string, event_id long, event_type string, at long, from_party string, to_party string").selectExpr("*", "timestamp_seconds(at) as ts")
    want, last = {}, {}
    for item, event, kind, at, a, b in sorted(rows, key=lambda r: r[1]):
        why = ledger.judge(last.get(item), kind, a is not None and b is not None, None if at is None else at * 1_000_000)
        want[event] = why
        if why is None:
            last[item] = (kind, None if at is None else at * 1_000_000)
    for width in (7, 1 << 16):
        assert {r["event_id"]: r["reason"] for r in ledger.custody_admit(df, slice_width=width).collect()} == want
    assert {None, "invalid_initial", "after_terminal", "missing_parties", "time_backwards"} == set(want.values())


def test_append_is_one_shuffle_and_equals_the_plain_fold(spark):
    """The rows were numbered, hashed and joined back to themselves: four shuffles of the ledger instead of one."""
    import hashlib
    import json
    rows = [(e, f"case-{e * 7 % 5}", f"2026-01-01T00:00:{e % 60:02d}+00:00", "op", "view", 'disk "1"', "SUCCESS") for e in range(200)]
    ev = spark.createDataFrame(rows, SCHEMA)
    got = ledger.append_chain(ev, ["case_id"], ["event_id"], cut())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    want, state = {}, {}
    for e, case, *rest in rows:
        seq, prev = state.get(case, (0, ledger.GENESIS))
        body = json.dumps(dict(zip(ledger.HASHED, (seq + 1, rest[0], rest[1], case, *rest[2:]))), separators=(",", ":"))
        state[case] = seq + 1, hashlib.sha256(f"{body}||{prev}".encode()).hexdigest()
        want[e] = (seq + 1, prev, state[case][1])
    assert {r["event_id"]: (r["seq"], r["prev_hash"], r["entry_hash"]) for r in got.collect()} == want
    assert verdict(got.where("case_id = 'case-3'")) == (True, None, None)
