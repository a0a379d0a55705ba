"""Vault joins and report documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from blocklens.operators import acquire, ranges, reports
from blocklens.plans import domain as d
from blocklens.plans import ledger_queries as lq
from blocklens.plans import rule_queries as rq
from blocklens.plans.catalog import query, r6, table
from blocklens.session import checkpoint_root
from blocklens.sources import image, vault

SMALL = 25  # items per report part, so that parts occur at test scale


MEDIA = 4


@query("src1_read_image", f"""SELECT doc_id % {MEDIA} AS medium, CAST(ceil(sum(strlen(coalesce(text, '')) + 1) / 512.0) AS BIGINT) AS blocks, CAST(ceil(sum(strlen(coalesce(text, '')) + 1) / 512.0) AS BIGINT) - 1 AS last_lba,
 CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS bytes, sha256(string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id)) AS content_hash FROM documents GROUP BY 1""")
def read_image(spark, sf):
    """Documents written to raw media, a file each, and read back as blocks; the padding of the last block is cut off."""
    at = f"{checkpoint_root(spark)}/io/{uuid.uuid4().hex}"
    docs = table(spark, sf, "documents").select((F.col("doc_id") % MEDIA).alias("medium"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs.repartition(MEDIA, "medium").sortWithinPartitions("medium", "doc_id").select("medium", "text").write.partitionBy("medium").text(at)
    files = vault.load_objects(spark, at, "*.txt").select("path").collect()  # one path per medium
    paths = [r["path"].replace("file:/", "file:///", 1) if r["path"].startswith("file:/") and not r["path"].startswith("file://") else r["path"] for r in files]
    chunks = image.read_image(spark, paths, image_ids=",".join(p.split("medium=")[1].split("/")[0] for p in paths), partition_bytes=1 << 20)
    size = image.blocks_of(chunks).groupBy("image_id").agg(F.count(F.lit(1)).alias("blocks"), F.max("lba").alias("last_lba"))
    bare = chunks.withColumn("payload", F.encode(F.rtrim(F.decode("payload", "ISO-8859-1"), F.lit("\0")), "ISO-8859-1"))
    digest = acquire.image_digest(bare.select("image_id", "chunk_no", "payload"), ["image_id"])
    return size.join(digest, "image_id").select(F.col("image_id").cast("bigint").alias("medium"), "blocks", "last_lba", "bytes", F.col("image_hash").alias("content_hash"))


@query("jn07_artifacts_for_case", f"WITH {d.ARTIFACTS}, {d.OPERATIONS} SELECT o.case_id, a.artifact_id, a.op_id, a.file_type, a.tier FROM artifacts a JOIN operations o USING (op_id)")
def artifacts_for_case(spark, sf):
    return reports.artifacts_for_case(d.artifacts(spark, sf), d.operations(spark, sf)).select("case_id", "artifact_id", "op_id", "file_type", "tier")


@query("jn08_images_for_case", f"WITH {d.IMAGES}, {d.EVIDENCE} SELECT case_id, image_id, evidence_id, acquired_at FROM images JOIN evidence USING (evidence_id)")
def images_for_case(spark, sf):
    return reports.images_for_case(d.images(spark, sf), d.evidence(spark, sf)).select("case_id", "image_id", "evidence_id", "acquired_at")


@query("jn09_custody_for_case", f"WITH {d.CUSTODY}, {d.EVIDENCE} SELECT case_id, event_id, evidence_id, event_type FROM custody JOIN evidence USING (evidence_id)")
def custody_for_case(spark, sf):
    return reports.custody_for_case(d.evidence(spark, sf), d.custody(spark, sf)).select("case_id", "event_id", "evidence_id", "event_type")


@query("jn11_manifest_match", """WITH m AS (SELECT DISTINCT lower(sha256(text)) AS h FROM benchmark), t AS (SELECT doc_id AS file_id, upper(sha256(text)) AS h FROM documents UNION ALL SELECT 1000000000 + item_id, upper(sha256(text)) FROM benchmark)
SELECT t.file_id FROM t WHERE lower(h) IN (SELECT h FROM m)""")
def manifest_match(spark, sf):
    b = table(spark, sf, "benchmark")
    files = table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), F.upper(F.sha2("text", 256)).alias("sha256_hash")).unionByName(
        b.select((F.col("item_id") + 1000000000).alias("file_id"), F.upper(F.sha2("text", 256)).alias("sha256_hash")))
    return reports.manifest_match(files, b.select(F.sha2("text", 256).alias("sha256_hash"))).select("file_id")


@query("rpt01_list_cases", f"WITH {d.CASES}, {d.EVIDENCE} SELECT c.case_id, case_name, status, count(e.evidence_id) AS evidence_count FROM cases c LEFT JOIN evidence e ON e.case_id = c.case_id GROUP BY ALL")
def list_cases(spark, sf):
    return reports.list_cases(d.cases(spark, sf), d.evidence(spark, sf)).select("case_id", "case_name", "status", "evidence_count")


@query("rpt02_case_timeline", f"WITH {d.OPERATIONS} SELECT case_id, op_id, op_type, status FROM operations")
def case_timeline(spark, sf):
    return reports.case_timeline(d.operations(spark, sf)).select("case_id", "op_id", "op_type", "status")


@query("rpt03_recovery_stats", f"""WITH {d.ARTIFACTS} SELECT image_id, count(*) AS total, count(*) FILTER (tier=1) AS tier1_count, count(*) FILTER (tier=2) AS tier2_count, count(*) FILTER (tier=3) AS tier3_count,
 CAST(sum(recovered_bytes) AS BIGINT) AS total_bytes, round(avg(confidence_score), 6) AS mean_confidence FROM artifacts GROUP BY 1""")
def recovery_stats(spark, sf):
    return reports.recovery_stats(d.artifacts(spark, sf), ["image_id"]).withColumn("mean_confidence", r6("mean_confidence"))


CASE_ART = f"""{d.ARTIFACTS}, {d.OPERATIONS}, ca AS (SELECT a.*, o.case_id, row_number() OVER (PARTITION BY case_id ORDER BY artifact_id, a.op_id, start_lba, recovered_bytes) - 1 AS pos
  FROM artifacts a JOIN operations o USING (op_id))"""


@query("rpt04_recovery_report", f"""WITH {CASE_ART}, tc AS (SELECT case_id, string_agg(file_type || '=' || n, ',' ORDER BY file_type) AS type_counts FROM (SELECT case_id, file_type, count(*) AS n FROM ca GROUP BY ALL) GROUP BY 1),
 t AS (SELECT case_id, count(*) AS total, count(*) FILTER (tier=1) AS t1, count(*) FILTER (tier=2) AS t2, count(*) FILTER (tier=3) AS t3 FROM ca GROUP BY 1)
SELECT case_id, CAST(pos // {SMALL} AS INT) AS part, total, t1 AS tier1_count, t2 AS tier2_count, t3 AS tier3_count, type_counts, string_agg(artifact_id || ':' || file_type, ',' ORDER BY pos) AS artifacts
FROM ca JOIN tc USING (case_id) JOIN t USING (case_id) GROUP BY ALL""")
def recovery_report(spark, sf):
    a = reports.case_artifacts(d.artifacts(spark, sf), d.operations(spark, sf))
    r = reports.recovery_report(a, SMALL)
    return r.select("case_id", "part", "total", "tier1_count", "tier2_count", "tier3_count",
                    F.array_join(F.transform(F.array_sort(F.map_entries("type_counts")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("type_counts"),
                    F.array_join(F.transform("artifacts", lambda x: F.concat_ws(":", x["artifact_id"].cast("string"), x["file_type"])), ",").alias("artifacts"))


@query("rpt05_forensic_exam_report", f"""WITH {CASE_ART}, {d.CASES}, {d.EVIDENCE}, {d.CUSTODY}, {d.IMAGES},
 s AS (SELECT case_id, 'a' AS sec, pos FROM ca UNION ALL SELECT case_id, 'e', row_number() OVER (PARTITION BY case_id ORDER BY evidence_id) - 1 FROM evidence
  UNION ALL SELECT case_id, 'o', row_number() OVER (PARTITION BY case_id ORDER BY op_id) - 1 FROM operations
  UNION ALL SELECT case_id, 'c', row_number() OVER (PARTITION BY case_id ORDER BY event_id) - 1 FROM custody JOIN evidence USING (evidence_id)
  UNION ALL SELECT case_id, 'm', row_number() OVER (PARTITION BY case_id ORDER BY image_id) - 1 FROM images JOIN evidence USING (evidence_id))
SELECT c.case_id, c.case_name, CAST(coalesce(pos // {SMALL}, 0) AS INT) AS part, count(*) FILTER (sec='e') AS evidence, count(*) FILTER (sec='o') AS operations, count(*) FILTER (sec='a') AS artifacts,
 count(*) FILTER (sec='c') AS custody, count(*) FILTER (sec='m') AS manifest FROM cases c LEFT JOIN s USING (case_id) GROUP BY ALL""")
def exam_report(spark, sf):
    r = reports.forensic_exam_report(d.cases(spark, sf), d.evidence(spark, sf), d.operations(spark, sf), d.artifacts(spark, sf), d.custody(spark, sf), d.images(spark, sf), SMALL)
    return r.select("case_id", "case_name", "part", *[F.size(s).cast("bigint").alias(s) for s in reports.SECTIONS])


@query("rpt06_acquisition_report", f"""WITH {d.IMAGES}, {d.EVIDENCE}, {d.BAD}, b2 AS (SELECT image_id, lba, lba - row_number() OVER (PARTITION BY image_id ORDER BY lba) AS g FROM bad),
 r AS (SELECT image_id, min(lba) AS start_lba, count(*) AS block_count FROM b2 GROUP BY image_id, g), n AS (SELECT *, (row_number() OVER (PARTITION BY image_id ORDER BY start_lba) - 1) // 500 AS part FROM r),
 t AS (SELECT image_id, count(*) AS c, CAST(sum(block_count) AS BIGINT) AS bl FROM r GROUP BY 1)
SELECT i.image_id, serial, coalesce(lower(acquisition_hash) = lower(verification_hash), false) AS reread_verified, coalesce(t.c, 0) AS bad_range_count, coalesce(t.bl, 0) AS bad_blocks,
 CAST(coalesce(n.part, 0) AS INT) AS part, string_agg(n.start_lba || '+' || n.block_count, ',' ORDER BY n.start_lba) AS ranges FROM images i JOIN evidence USING (evidence_id) LEFT JOIN t ON t.image_id = i.image_id
 LEFT JOIN n ON n.image_id = i.image_id GROUP BY ALL""")
def acquisition_report(spark, sf):
    bad = ranges.merge_bad_ranges(d.bad_blocks(spark, sf), ["image_id"])
    r = reports.acquisition_report(d.images(spark, sf), d.evidence(spark, sf), bad, 500)
    return r.select("image_id", "serial", "reread_verified", "bad_range_count", "bad_blocks", "part",
                    F.array_join(F.transform("bad_ranges", lambda x: F.concat_ws("+", x["start_lba"].cast("string"), x["block_count"].cast("string"))), ",").alias("ranges"))


@query("rpt07_device_health_report", f"""WITH {d.TELEMETRY}, {d.EVIDENCE}, l AS (SELECT * FROM telemetry QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY event_id DESC) = 1)
SELECT evidence_id AS device_id, model, CASE WHEN l.kind IS NULL THEN 'Unknown' ELSE {d.HEALTH} END AS status FROM evidence LEFT JOIN l ON l.device_id = evidence_id""")
def health_report(spark, sf):
    inv = d.evidence(spark, sf).withColumnRenamed("evidence_id", "device_id")
    return reports.device_health_report(inv, d.telemetry(spark, sf)).select("device_id", "model", "status")


@query("rpt08_custody_report", f"""WITH {d.CUSTODY}, {d.EVIDENCE}, p AS (SELECT *, (row_number() OVER (PARTITION BY evidence_id ORDER BY event_id) - 1) // {SMALL} AS part FROM custody),
 c AS (SELECT evidence_id, count(*) AS n, arg_max(coalesce(to_party, from_party), event_id) FILTER (coalesce(to_party, from_party) IS NOT NULL) AS o FROM custody GROUP BY 1)
SELECT e.evidence_id, c.o AS current_owner, coalesce(c.n, 0) AS total_events, CAST(coalesce(p.part, 0) AS INT) AS part, count(p.event_id) AS listed FROM evidence e LEFT JOIN c USING (evidence_id)
 LEFT JOIN p USING (evidence_id) GROUP BY ALL""")
def custody_report(spark, sf):
    r = reports.custody_report(d.evidence(spark, sf), d.custody(spark, sf), SMALL)
    return r.select("evidence_id", "current_owner", "total_events", "part", F.coalesce(F.size("events"), F.lit(0)).cast("bigint").alias("listed"))


@query("rpt09_sanitization_report", f"WITH {d.EVIDENCE}, {rq.LAYERS} SELECT device_id, e.model, {rq.ASSURANCE} AS assurance FROM layers l JOIN (SELECT evidence_id, model FROM evidence) e ON e.evidence_id = l.device_id")
def sanitization_report(spark, sf):
    inv = d.evidence(spark, sf).select(F.col("evidence_id").alias("device_id"), "model")
    return reports.sanitization_report(inv, rq.layers(spark, sf)).select("device_id", "model", "assurance")


@query("rpt10_report_checks", f"""WITH RECURSIVE {lq.AUDIT}, s AS (SELECT user_id, 'case-' || user_id AS report_id, user_id % 7 AS a, user_id % 5 AS b, user_id % 11 AS c, min(event_id) AS first FROM events GROUP BY user_id)
SELECT report_id, a <> 3 AS content_ok, c <> 4 AS segment_ok, CASE b WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE b = 3 END AS timestamp_ok, CASE WHEN user_id % 3 = 0 THEN user_id % 2 = 0 END AS manifest_ok,
 a <> 3 AND c <> 4 AND b IN (0, 2, 3) AND (user_id % 3 <> 0 OR user_id % 2 = 0) AS overall FROM s""")
def report_checks(spark, sf):
    from blocklens.operators import ledger
    cols = [*ledger.HASHED, "prev_hash", "entry_hash"]
    u = F.expr("CAST(substr(case_id, 6) AS BIGINT)")
    c = lq.chained(spark, sf).withColumn("result", F.when((u % 11 == 4) & (F.col("seq") == 1), "EDITED").otherwise(F.col("result")))
    seg = c.groupBy(F.col("case_id").alias("report_id")).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("audit_chain_segment"))
    u = F.expr("CAST(substr(report_id, 6) AS BIGINT)")
    doc = F.concat(F.lit('{"report":"'), "report_id", F.lit('"}'))
    h = F.sha2("report_id", 256)
    r = seg.select("report_id", "audit_chain_segment", doc.alias("content_json"), F.when(u % 7 == 3, F.sha2(F.concat(doc, F.lit(" ")), 256)).otherwise(F.upper(F.sha2(doc, 256))).alias("content_sha256"),
                   (u % 5 < 2).alias("is_rfc3161"), F.when(u % 5 == 0, "AAAA").alias("token"), F.lit("http://tsa").alias("tsa_url"),
                   F.when(u % 5 == 4, "made up").otherwise("Local timestamp (offline)").alias("status_label"),
                   F.array(F.struct(F.upper(h).alias("sha256_hash"))).alias("evidence_manifest"),
                   F.when(u % 3 == 0, F.when(u % 2 == 0, h).otherwise(F.sha2(F.lit("other"), 256))).alias("evidence_hash"))
    return reports.report_checks(r).select("report_id", "content_ok", "segment_ok", "timestamp_ok", "manifest_ok", "overall")


@query("snk2_report_documents", f"""WITH {d.CUSTODY}, {d.EVIDENCE} SELECT e.evidence_id, CAST(coalesce(p.part, 0) AS INT) AS part, coalesce(strlen(max(p.t)), 0) > 0 AS has_events FROM evidence e
 LEFT JOIN (SELECT evidence_id, (row_number() OVER (PARTITION BY evidence_id ORDER BY event_id) - 1) // {SMALL} AS part, event_type AS t FROM custody) p USING (evidence_id) GROUP BY ALL""")
def documents(spark, sf):
    r = reports.custody_report(d.evidence(spark, sf), d.custody(spark, sf), SMALL)
    docs = reports.to_document(r, ["evidence_id", "part"], "Chain of custody", "events")
    return docs.select("evidence_id", "part", F.col("content_markdown").contains("- {").alias("has_events"))
