"""Streams replayed over the driver tables; each result equals its batch rule."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blocklens.operators import carve
from blocklens.plans import carve_queries as cq
from blocklens.plans import domain as d
from blocklens.plans import fs_queries as fq
from blocklens.plans import ledger_queries as lq
from blocklens.plans.catalog import ORACLES, query, r4, table
from blocklens.session import checkpoint_root
from blocklens.sources import signatures, vault
from blocklens.streaming import jobs


def feed(spark: SparkSession, sf: str, name: str = "events") -> DataFrame:
    schema = table(spark, sf, name).schema
    return vault.stream_ledger(spark, sf, schema, "parquet", pattern=f"{name}.parquet")


def parted_feed(spark: SparkSession, sf: str, by: str, name: str = "events", files: int = 3) -> DataFrame:
    """The table in several files, a trigger each, in order of ``by``."""
    root = f"{checkpoint_root(spark)}/streams/{uuid.uuid4().hex}/in"
    rows = table(spark, sf, name)
    at = F.unix_micros(F.col(by).cast("timestamp")) if by == "ts" else F.col(by)
    cuts = rows.agg(F.percentile_approx(at, [i / files for i in range(1, files)], 1000)).first()[0] or []
    part = sum((F.when(at > c, 1).otherwise(0) for c in cuts), F.lit(0))
    for k in range(files):
        rows.where(part == k).coalesce(1).write.mode("append").parquet(root)
    return vault.stream_ledger(spark, root, rows.schema, "parquet", files_per_trigger=1)


def replay(stream: DataFrame, mode: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Run until the input is used up; rows of all triggers, in the shared checkpoint folder.

    In update mode a later trigger replaces a key's row: the latest one per ``keys`` is left.
    """
    spark = stream.sparkSession
    root = f"{checkpoint_root(spark)}/streams/{uuid.uuid4().hex}"

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/trigger={epoch}")

    q = (stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{root}/state")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    rows = spark.read.schema(stream.schema).option("basePath", f"{root}/out").parquet(f"{root}/out")
    if mode == "update":
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), F.col("trigger").cast("long")).alias("_last")).select("_last.*")
    return rows.drop("trigger")


@query("str1_health_alerts", f"""WITH {d.TELEMETRY}, r AS (SELECT device_id, date_trunc('hour', ts) AS w, CASE {d.HEALTH} WHEN 'Critical' THEN 3 WHEN 'Warning' THEN 2 WHEN 'Good' THEN 1 ELSE 0 END AS r FROM telemetry)
SELECT device_id, strftime(w, '%Y-%m-%d %H:%M') AS window_start, ['Unknown','Good','Warning','Critical'][max(r) + 1] AS status, count(*) AS readings FROM r GROUP BY device_id, w""")
def health_alerts(spark, sf):
    got = replay(jobs.health_alerts(d.telemetry_of(parted_feed(spark, sf, "ts"))), "update", ("device_id", "window_start"))
    return got.select("device_id", F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "status", "readings")


@query("str2_custody_stream", ORACLES["cus3_custody_admit"])
def custody_stream(spark, sf):
    return replay(jobs.custody_stream(shaky_feed(spark, sf)), "append").select("evidence_id", "event_id", "reason", "accepted")


def shaky_feed(spark, sf):
    e = feed(spark, sf)
    kind = None
    for a, c in d.CUSTODY_TYPE.items():
        kind = F.when(F.col("event_type") == a, c) if kind is None else kind.when(F.col("event_type") == a, c)
    k = d.k_of()
    ts = F.when(F.col("event_id") % 10 == 3, F.col("ts") - F.expr("INTERVAL 3 DAYS")).otherwise(F.col("ts"))
    return e.select("event_id", F.col("user_id").alias("evidence_id"), kind.alias("event_type"), ts.alias("ts"),
                    F.when(k % 3 != 0, F.lit("a")).alias("from_party"), F.when(k % 5 != 0, F.lit("b")).alias("to_party"))


@query("str3_append_stream", f"WITH RECURSIVE {lq.AUDIT} SELECT case_id, seq, prev_hash, entry_hash FROM ch")
def append_stream(spark, sf):
    return replay(jobs.append_stream(lq.audit_of(feed(spark, sf))), "append").select("case_id", "seq", "prev_hash", "entry_hash")


@query("str3_audit_stream", f"WITH RECURSIVE {lq.TAMPER} SELECT case_id, seq, failure FROM fl")
def audit_stream(spark, sf):
    root = f"{checkpoint_root(spark)}/streams/{uuid.uuid4().hex}"
    stored = lq.tampered(spark, sf)
    stored.write.parquet(f"{root}/ledger")
    return replay(jobs.audit_stream(vault.stream_ledger(spark, f"{root}/ledger", stored.schema)), "append")


@query("str4_progress_stream", f"""WITH p AS (SELECT user_id AS job_id, event_id, event_id * 3 AS current_lba, 20000 AS total_blocks, event_id * 1536 AS bytes_written, {d.K_SQL} % 4 AS bad FROM events)
SELECT job_id, max(current_lba) AS current_lba, max(bytes_written) AS bytes_written, CAST(sum(bad) AS BIGINT) AS bad_blocks, round(least(max(current_lba) * 100.0::DOUBLE / 20000, 100), 4) AS percent FROM p GROUP BY 1""")
def progress_stream(spark, sf):
    p = parted_feed(spark, sf, "event_id").select(F.col("user_id").alias("job_id"), "event_id", (F.col("event_id") * 3).alias("current_lba"), F.lit(20000).alias("total_blocks"),
                               (F.col("event_id") * 1536).alias("bytes_written"), (d.k_of() % 4).alias("bad_blocks"))
    got = replay(jobs.progress_stream(p), "update", ("job_id",))
    return got.select("job_id", "current_lba", "bytes_written", "bad_blocks", r4("percent").alias("percent"))


@query("str5_deletion_stream", "SELECT user_id % 4 AS volume, event_id AS usn, user_id AS record_ref FROM events WHERE event_type = 'purchase'")
def deletion_stream(spark, sf):
    e = parted_feed(spark, sf, "ts")
    twice = fq.journal_of(e).withColumn("_twice", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_twice")
    return replay(jobs.deletion_stream(twice), "append").select("volume", "usn", "record_ref")


@query("str6_carve_stream", f"WITH {cq.LAYOUT} SELECT image_id, lba, 'html' AS file_type, CASE WHEN is_ok THEN 'OK' ELSE 'EOF' END AS verdict, len AS length FROM v")
def carve_stream(spark, sf):
    """Chunks of 64-page media land in two files; windows across the border wait for the second."""
    root = f"{checkpoint_root(spark)}/streams/{uuid.uuid4().hex}"
    m = cq.chunks(spark, sf)
    half = F.col("chunk_no") < 2
    m.where(half).coalesce(1).write.mode("append").parquet(f"{root}/in")
    m.where(~half).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = vault.stream_ledger(spark, f"{root}/in", m.schema, "parquet", files_per_trigger=1)
    sig = signatures.append_signatures(signatures.signature_rows(spark), signatures.signature_rows(spark, cq.HTML_SIG))
    q = jobs.carve_stream(stream, sig, carve.total_blocks(m, ["image_id"]), f"{root}/store", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{root}/store/verdicts").select("image_id", "lba", "file_type", "verdict", "length")
