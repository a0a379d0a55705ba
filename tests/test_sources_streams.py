import json
import time

import golden
from pyspark.sql import functions as F

from blocklens.operators import carve, ledger, reports, slices
from blocklens.sources import image, signatures, sinks, vault
from blocklens.streaming import jobs
from test_ledger import SCHEMA, custody, events


def test_raw_image_ranges_and_padding(spark, tmp_path):
    data = golden.carve_image() + b"tail"
    path = tmp_path / "a.img"
    path.write_bytes(data)
    chunks = image.read_image(spark, [str(path)], partition_bytes=16 * 512 * 8, chunk_blocks=8)
    rows = image.blocks_of(chunks).orderBy("lba").collect()
    assert len(rows) == 401 and b"".join(bytes(r["payload"]) for r in rows) == data.ljust(401 * 512, b"\0")
    part = image.blocks_of(image.read_image_range(spark, str(path), "Partial", 10, 9999, chunk_blocks=8)).orderBy("lba").collect()
    assert [r["lba"] for r in part] == list(range(10, 401)) and bytes(part[0]["payload"]).startswith(golden.PNG)
    whole = image.read_image(spark, [str(path)])
    got = carve.recover_image(whole, signatures.signature_rows(spark), ["image_id"], tiers=(2,)).collect()
    assert sorted(r["start_lba"] for r in got) == [10, 20, 30, 40, 50, 70, 80, 150]


def test_vault_decodes_json_and_times(spark, tmp_path):
    for name, schema in vault.VAULT.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / name))
    bad = json.dumps({"unreadable_ranges": [{"start_lba": 3, "block_count": 2, "error_details": "x"}], "total_unreadable_blocks": 2, "total_unreadable_bytes": 1024})
    row = ("i", "e", "RAW", "/x.dd", "ab", None, bad, "2026-01-02T03:04:05+00:00", "op")
    spark.createDataFrame([row], vault.VAULT["forensic_images"]).write.mode("overwrite").parquet(str(tmp_path / "forensic_images"))
    tables = vault.load_vault(spark, str(tmp_path))
    assert len(tables) == 9
    got = tables["forensic_images"].select("acquired_at", "bad_sector_map.unreadable_ranges").first()
    assert got[0].isoformat() == "2026-01-02T03:04:05" and got[1][0]["start_lba"] == 3


def test_objects_and_artifact_sink(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.png").write_bytes(golden.PNG)
    got = vault.load_objects(spark, str(tmp_path / "in")).first()
    assert got["length"] == len(golden.PNG) and bytes(got["payload"]) == golden.PNG
    chunks = carve.to_chunks(golden.sectors(spark, golden.place(30, {4: golden.PNG})), ["image_id"])
    sinks.write_artifacts(carve.recover_image(chunks, signatures.signature_rows(spark), ["image_id"], tiers=(2,)), str(tmp_path / "out"), 7)
    back = spark.read.parquet(str(tmp_path / "out" / "artifacts")).first()
    assert (back["op_id"], back["tier"], back["file_type"], back["image_id"]) == (7, 2, "png", "img")
    assert spark.read.parquet(str(tmp_path / "out" / "payloads")).count() == 1


def test_artifact_files_do_not_grow_with_images(spark, tmp_path):
    rows = spark.range(600).select((F.col("id") % 300).alias("image_id"), F.element_at(F.array(F.lit("png"), F.lit("pdf")), (F.col("id") % 2 + 1).cast("int")).alias("file_type"),
                                   F.col("id").alias("artifact_id"), F.lit(2).alias("tier"), F.lit("h").alias("content_hash"), F.lit(b"x").alias("payload")).repartition(3)
    sinks.write_artifacts(rows, str(tmp_path), "op")
    assert len(list((tmp_path / "artifacts").rglob("*.parquet"))) <= 6 and len(list((tmp_path / "payloads").rglob("*.parquet"))) <= 3
    back = spark.read.parquet(str(tmp_path / "artifacts"))
    assert back.count() == 600 and back.where("image_id = 7").select("artifact_id").distinct().count() == 2
    assert spark.read.parquet(str(tmp_path / "payloads")).count() == 600


def test_report_sink(spark, tmp_path):
    hist = custody(spark, [("Seized", 0, None, "x"), ("Transferred", 1, "x", "y"), ("Returned", 2, "y", None)])
    ev = spark.createDataFrame([("e", "disk")], "evidence_id string, model string")
    sinks.write_report(reports.custody_report(ev, hist, 2), str(tmp_path), ["evidence_id", "part"], "Chain of custody", "events")
    docs = spark.read.json(str(tmp_path / "json")).orderBy("part").collect()
    assert [len(json.loads(d["content_json"])["events"]) for d in docs] == [2, 1]
    assert docs[0].asDict()["content_sha256"] == spark.range(1).select(F.sha2(F.lit(docs[0]["content_json"]), 256)).first()[0]


def run(stream, mode, tmp_path, name):
    out = str(tmp_path / name)
    q = (stream.writeStream.outputMode(mode).option("checkpointLocation", out + "-state")
         .foreachBatch(lambda b, e: b.write.mode("overwrite").parquet(f"{out}/trigger={e}")).trigger(availableNow=True).start())
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def land(df, path, by, parts):
    """One file per part, in order."""
    numbered = df.withColumn("_n", F.ntile(parts).over(_w(by)))
    for i in range(parts):
        numbered.where(F.col("_n") == i + 1).drop("_n").coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # the file source orders by modification time


def _w(by):
    from pyspark.sql import Window
    return Window.orderBy(by)


def test_custody_stream_equals_batch(spark, tmp_path):
    kinds = ["Transferred", "Seized", "StorageChange", "Transferred", "AnalysisStarted", "Returned", "Received", "StorageChange"]
    df = custody(spark, [(k, i, "a" if i % 2 else None, "b") for i, k in enumerate(kinds)])
    land(df, str(tmp_path / "in"), "event_id", 3)
    feed = vault.stream_ledger(spark, str(tmp_path / "in"), df.schema, files_per_trigger=1)
    got = run(jobs.custody_stream(feed), "append", tmp_path, "c")
    want = ledger.custody_admit(df)
    assert sorted((r["event_id"], r["reason"] or "") for r in got.collect()) == sorted((r["event_id"], r["reason"] or "") for r in want.collect())


def test_audit_streams_over_triggers(spark, tmp_path):
    ev = events(spark, 12)
    land(ev, str(tmp_path / "ev"), "event_id", 4)
    feed = vault.stream_ledger(spark, str(tmp_path / "ev"), SCHEMA, files_per_trigger=1)
    got = run(jobs.append_stream(feed), "append", tmp_path, "a")
    want = ledger.append_chain(ev, ["case_id"], ["event_id"], slices.by_width("event_id", 5))
    pick = ["seq", "prev_hash", "entry_hash"]
    assert sorted(map(tuple, got.select(*pick).collect())) == sorted(map(tuple, want.select(*pick).collect()))
    bent = want.withColumn("result", F.when(F.col("seq") == 5, "EDITED").otherwise(F.col("result")))
    land(bent, str(tmp_path / "led"), "seq", 3)
    seen = run(jobs.audit_stream(vault.stream_ledger(spark, str(tmp_path / "led"), bent.schema, files_per_trigger=1)), "append", tmp_path, "v")
    assert {r["seq"]: r["failure"] for r in seen.collect() if r["failure"]} == {5: "mismatch"}


def test_late_reading_is_dropped(spark, tmp_path):
    # lateness is judged by the watermark of the trigger before, so one more trigger lies between
    cols = ("device_id bigint, ts timestamp_ntz, kind string, critical_warnings int, spare_percent int, percentage_used int, media_errors int, "
            "temperature int, uncorrectable int, pending int, reallocated int")
    make = lambda t, temp: spark.sql(f"SELECT 1L device_id, TIMESTAMP_NTZ'{t}' ts, 'hdd' kind, 0 critical_warnings, 100 spare_percent, 0 percentage_used, "  # noqa: E731
                                     f"0 media_errors, {temp} temperature, 0 uncorrectable, 0 pending, 0 reallocated")
    for t, temp in [("2026-01-01 00:10:00", 60), ("2026-01-01 05:00:00", 30), ("2026-01-01 05:30:00", 30), ("2026-01-01 00:20:00", 30)]:
        make(t, temp).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    feed = vault.stream_ledger(spark, str(tmp_path / "in"), cols, files_per_trigger=1)
    got = run(jobs.health_alerts(feed), "append", tmp_path, "h").collect()
    assert [(r["window_start"].hour, r["status"], r["readings"]) for r in got] == [(0, "Warning", 1)]


def test_progress_checkpoint_sink(spark, tmp_path):
    rows = [(1, 5_000, 25_000, 1), (1, 10_000, 25_000, 2), (1, 20_000, 25_000, 3), (2, 10_000, 10_000, 4), (1, 20_500, 25_000, 5)]
    df = spark.createDataFrame(rows, "job_id bigint, current_lba bigint, end_lba bigint, event_id bigint")
    land(df, str(tmp_path / "in"), "event_id", 2)
    feed = vault.stream_ledger(spark, str(tmp_path / "in"), df.schema, files_per_trigger=1)
    sinks.checkpoint_sink(feed, str(tmp_path / "t"), str(tmp_path / "s")).trigger(availableNow=True).start().awaitTermination()
    assert {r["job_id"]: r["current_lba"] for r in sinks.read_latest(spark, str(tmp_path / "t")).collect()} == {1: 20_000, 2: 10_000}


def test_objects_are_written_in_one_folder_by_the_tasks(spark, tmp_path):
    """A file per row under its key, no folder per row; a null payload is an empty file, no rows are no files."""
    from blocklens.sources import sinks, vault
    rows = spark.range(300).selectExpr("id", "if(id = 7, null, encode(concat('body ', id), 'UTF-8')) as body")
    at = str(tmp_path / "objects")
    assert sinks.write_objects(rows.repartition(4), at, "id", "body", ".txt") == 300
    assert not [p for p in (tmp_path / "objects").iterdir() if p.is_dir()]
    assert (tmp_path / "objects" / "7.txt").stat().st_size == 0
    got = {r["path"].rsplit("/", 1)[1]: bytes(r["payload"]) for r in vault.load_objects(spark, at, "*.txt").collect()}
    got.pop("7.txt", None)  # Spark's file sources leave out files without a byte
    assert got == {f"{i}.txt": f"body {i}".encode() for i in range(300) if i != 7}
    assert sinks.write_objects(rows.limit(0), str(tmp_path / "none"), "id", "body") == 0
