"""Filters, projections, scoring, calibration, wipe and health rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from blocklens.functions import rules, scoring
from blocklens.operators import acquire, byte_stats, calibrate, filters, wipe
from blocklens.plans import domain as d
from blocklens.plans.catalog import query, r4, r6, table


# ---- filters -----------------------------------------------------------------------
@query("flt1_target_types", f"WITH {d.ARTIFACTS} SELECT artifact_id, op_id, file_type FROM artifacts WHERE file_type IN ('jpeg','mp4')")
def target_types(spark, sf):
    return filters.filter_target_types(d.artifacts(spark, sf), ["JPEG", "Mp4"]).select("artifact_id", "op_id", "file_type")


ENTRIES = """entries AS (SELECT l_suppkey AS volume, l_orderkey AS entry_id, l_orderkey % 40 AS record_num, l_returnflag = 'R' AS deleted,
 CASE l_partkey % 6 WHEN 0 THEN '$MFT' WHEN 1 THEN 'photo.' || l_partkey || '.JPG' WHEN 2 THEN 'README'
  WHEN 3 THEN 'VSS_store' || (l_partkey % 5) WHEN 4 THEN 'x{3808876b-c176-4e48-b7ae-04046e6cc752}' || (l_partkey % 3) ELSE NULL END AS name
 FROM lineitem)"""


def entries(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(
        "l_suppkey AS volume", "l_orderkey AS entry_id", "l_orderkey % 40 AS record_num", "l_returnflag = 'R' AS deleted",
        """CASE l_partkey % 6 WHEN 0 THEN '$MFT' WHEN 1 THEN concat('photo.', l_partkey, '.JPG') WHEN 2 THEN 'README'
           WHEN 3 THEN concat('VSS_store', l_partkey % 5)
           WHEN 4 THEN concat('x{3808876b-c176-4e48-b7ae-04046e6cc752}', l_partkey % 3) ELSE NULL END AS name""")


@query("flt2_deleted", f"WITH {ENTRIES} SELECT volume, entry_id, name FROM entries WHERE deleted")
def deleted(spark, sf):
    return filters.filter_deleted(entries(spark, sf)).select("volume", "entry_id", "name")


@query("flt3_tier", f"WITH {d.ARTIFACTS} SELECT artifact_id, op_id, tier FROM artifacts WHERE tier = 2")
def tier(spark, sf):
    return filters.filter_tier(d.artifacts(spark, sf), 2).select("artifact_id", "op_id", "tier")


@query("flt4_skip_system_records", f"""WITH {ENTRIES} SELECT volume, entry_id, record_num, name FROM entries
WHERE NOT (record_num < 16 AND starts_with(name, '$'))""")
def skip_system(spark, sf):
    return filters.skip_system_records(entries(spark, sf)).select("volume", "entry_id", "record_num", "name")


@query("flt5_resumable_ops", f"""WITH {d.OPERATIONS} SELECT op_id, case_id, status, current_lba FROM operations
WHERE op_type = 'Acquire' AND status IN ('Paused','Failed') AND parsable""")
def resumable(spark, sf):
    return filters.resumable_ops(d.operations(spark, sf)).select(
        "op_id", "case_id", "status", F.col("checkpoint.current_lba").alias("current_lba"))


def filled(spark, sf):
    """Order rows as small blocks: zero filled, uniformly filled, or text."""
    return table(spark, sf, "orders").selectExpr(
        "o_custkey AS image_id", "o_orderkey AS lba",
        """CASE o_orderkey % 4 WHEN 0 THEN unhex(repeat('00', 32)) WHEN 1 THEN encode(repeat(substr(o_orderpriority, 1, 1), 32), 'UTF-8')
           ELSE encode(rpad(o_orderpriority, 32, ' '), 'UTF-8') END AS payload""")


FILLED = """filled AS (SELECT o_custkey AS image_id, o_orderkey AS lba, CASE o_orderkey % 4 WHEN 0 THEN repeat('00', 32)
 WHEN 1 THEN repeat(hex(encode(substr(o_orderpriority, 1, 1))), 32) ELSE hex(encode(rpad(o_orderpriority, 32, ' '))) END AS h FROM orders)"""


@query("flt6_zero_blocks", f"WITH {FILLED} SELECT image_id, lba FROM filled WHERE h = repeat('00', 32)")
def zero_blocks(spark, sf):
    return filters.zero_block_filter(filled(spark, sf)).select("image_id", "lba")


@query("flt7_uniform_blocks", f"WITH {FILLED} SELECT image_id, lba FROM filled WHERE h = repeat(substr(h, 1, 2), 32)")
def uniform_blocks(spark, sf):
    return filters.uniform_block_filter(filled(spark, sf)).select("image_id", "lba")


@query("flt8_vss_summary", f"""WITH {ENTRIES} SELECT volume, count(DISTINCT name) AS stores, min(name) AS first_store FROM entries
WHERE name LIKE '%{{3808876b-c176-4e48-b7ae-04046e6cc752}}%' OR contains(lower(name), 'vss_') OR contains(lower(name), 'syscache.hve') GROUP BY volume""")
def vss(spark, sf):
    return filters.vss_summary(entries(spark, sf), ["volume"])


@query("flt9_media_class", f"""WITH {d.EVIDENCE} SELECT evidence_id, media_type, media_type IN ('SataSsd','Nvme','Sed','Usb','SdCard') AS is_solid_state,
 media_type = 'ForensicImage' AS is_image FROM evidence""")
def media_class(spark, sf):
    return filters.media_class(d.evidence(spark, sf)).select("evidence_id", "media_type", "is_solid_state", "is_image")


# ---- projections -------------------------------------------------------------------
@query("prj1_file_type_from_name", f"""WITH {ENTRIES} SELECT file_type, count(*) AS n FROM (SELECT coalesce(lower(string_split(name, '.')[-1]), 'unknown')
 AS file_type FROM entries) GROUP BY file_type""")
def file_type(spark, sf):
    return entries(spark, sf).groupBy(filters.file_type_from_name().alias("file_type")).agg(F.count(F.lit(1)).alias("n"))


@query("prj2_format_provenance", f"""WITH {d.ARTIFACTS} SELECT artifact_id, op_id, 'Recovered File #R-' || artifact_id || chr(10) || 'Recovery method: ' ||
 CASE tier WHEN 1 THEN 'Tier 1 (metadata)' WHEN 2 THEN 'Tier 2 (signature)' ELSE 'Tier 3 (fragmented)' END || chr(10) || 'Source: LBA ' || start_lba ||
 ' -> ' || (start_lba + block_count) || CASE WHEN tier = 3 THEN ', LBA ' || (start_lba + block_count + 8) || ' -> ' || (start_lba + 2 * block_count + 8) ELSE '' END
 || chr(10) || CASE WHEN tier = 1 THEN 'Original path: /f' || op_id || chr(10) ELSE '' END
 || 'Confidence: ' || printf('%.1f%%', confidence_score * 100) || ' (Structural: 100.0%, Meta: ' || CASE WHEN tier = 1 THEN '60.0' ELSE '0.0' END || '%, Entropy: 80.0%)' || chr(10)
 || CASE WHEN tier = 3 THEN 'Fragmentation: 2 fragments (gap size: 8 sectors | LBA ' || start_lba || '..' || (start_lba + block_count) || ' + LBA ' ||
   (start_lba + block_count + 8) || '..' || (start_lba + 2 * block_count + 8) || ')' || chr(10) ELSE '' END
 || 'Recovered bytes: ' || recovered_bytes || ' / ' || CASE WHEN limitations IS NULL THEN CAST(recovered_bytes AS VARCHAR) ELSE 'Unknown' END || chr(10)
 || 'SHA-256: ' || sha256(CAST(artifact_id AS VARCHAR)) || chr(10) || 'Recovery limitations: ' || coalesce(limitations, 'None (Complete & verified payload)') || chr(10)
 AS provenance FROM artifacts""")
def provenance(spark, sf):
    a = d.artifacts(spark, sf)
    one = "named_struct('start_lba', start_lba, 'block_count', block_count)"
    two = "named_struct('start_lba', start_lba + block_count + 8, 'block_count', block_count)"
    full = a.selectExpr(
        "*", f"IF(tier = 3, array({one}, {two}), array({one})) AS extents", "IF(tier = 3, 8L, NULL) AS gap",
        "IF(tier = 1, concat('/f', op_id), NULL) AS original_path", "1.0D AS structural", "IF(tier = 1, 0.6D, 0.0D) AS metadata",
        "0.8D AS entropy", "IF(limitations IS NULL, recovered_bytes, NULL) AS expected_bytes",
        "sha2(CAST(artifact_id AS STRING), 256) AS content_hash")
    return filters.format_provenance(full).select("artifact_id", "op_id", "provenance")


@query("prj3_device_fingerprint", f"""WITH {d.EVIDENCE}, f AS (SELECT *, upper(trim(serial)) AS s, upper(trim(model)) AS m, lpad(hex(capacity_bytes), 16, '0') AS c FROM evidence)
SELECT evidence_id, sha256(unhex(lpad(hex(strlen(s)), 2, '0') || '000000') || encode(s) || unhex(lpad(hex(strlen(m)), 2, '0') || '000000') || encode(m)
 || unhex(c[15:16] || c[13:14] || c[11:12] || c[9:10] || c[7:8] || c[5:6] || c[3:4] || c[1:2]) || unhex(lpad(hex(strlen(vendor)), 2, '0') || '000000') || encode(vendor)) AS fingerprint FROM f""")
def fingerprint(spark, sf):
    return filters.device_fingerprint(d.evidence(spark, sf).withColumn("boundary_sample", F.encode("vendor", "UTF-8"))).select(
        "evidence_id", "fingerprint")


def boot_sectors(spark, sf):
    """Three leading blocks per part: eight boot-block layouts chosen by the part key."""
    hexes = F.expr("""CASE p_partkey % 8
      WHEN 0 THEN concat(repeat('00', 510), '0000')
      WHEN 1 THEN concat('EB5890', hex('NTFS    '), repeat('00', 499), '55AA')
      WHEN 2 THEN concat('EB7690', hex('EXFAT   '), repeat('00', 435), '07', repeat('00', 63), '55AA')
      WHEN 3 THEN concat(repeat('00', 450), 'EE', repeat('00', 59), '55AA')
      WHEN 4 THEN concat('EB5890', hex('MSDOS5.0'), '0002', '08', '2000', '02', repeat('00', 65), hex('FAT32   '), repeat('00', 420), '55AA')
      WHEN 5 THEN concat('EB3C90', hex('MSDOS5.0'), '0002', '04', '0100', '02', '0002', 'FFFF', 'F8', '4000', repeat('00', 486), '55AA')
      WHEN 6 THEN concat('EB3C90', hex('MSDOS5.0'), '0002', '01', '0100', '02', 'E000', '400B', 'F0', '0900', repeat('00', 486), '55AA')
      ELSE concat(repeat('00', 32), hex('NXSB'), repeat('00', 476)) END""")
    p = table(spark, sf, "part").select("p_partkey", "p_size", hexes.alias("h0"))
    return p.selectExpr("p_partkey AS image_id", """stack(3, 0L, unhex(h0),
        1L, IF(p_size % 2 = 0, encode(rpad('EFI PART', 512, '.'), 'UTF-8'), encode(repeat('.', 512), 'UTF-8')),
        2L, unhex(IF(p_partkey % 8 = 0 AND p_size % 2 = 0, concat(repeat('00', 56), '53EF', repeat('00', 454)), repeat('00', 512)))) AS (lba, payload)""")


@query("prj4_partition_table_kind", """SELECT p_partkey AS image_id, CASE p_partkey % 8 WHEN 0 THEN 'Raw / Unpartitioned' WHEN 7 THEN 'Raw / Unpartitioned'
 WHEN 3 THEN CASE WHEN p_size % 2 = 0 THEN 'GPT (GUID Partition Table)' ELSE 'GPT (Protective MBR detected)' END ELSE 'MBR (Master Boot Record)' END AS partition_table FROM part""")
def partition_table(spark, sf):
    return filters.partition_table_kind(boot_sectors(spark, sf), ["image_id"])


@query("prj5_detect_filesystem", """SELECT p_partkey AS image_id, CASE p_partkey % 8 WHEN 0 THEN CASE WHEN p_size % 2 = 0 THEN 'ext4' ELSE 'Unknown' END
 WHEN 1 THEN 'NTFS' WHEN 2 THEN 'exFAT' WHEN 3 THEN 'Unknown' WHEN 4 THEN 'FAT32' WHEN 5 THEN 'FAT16' WHEN 6 THEN 'FAT12' ELSE 'APFS' END AS filesystem FROM part""")
def filesystem(spark, sf):
    return filters.detect_filesystem(boot_sectors(spark, sf), ["image_id"])


@query("prj6_write_blocker_flag", """WITH i AS (SELECT p_partkey AS device_id, CASE p_partkey % 3 WHEN 0 THEN 3791 WHEN 1 THEN 5948 ELSE NULL END AS vid, p_partkey % 12 AS pid,
 CASE WHEN p_size % 7 = 0 THEN 'Tableau unit' ELSE p_brand END AS vendor, p_name AS model, p_size % 5 = 0 AS ro FROM part),
 j AS (SELECT *, coalesce((vid = 3791 AND pid IN (1,2,3,4,5,8,9)) OR (vid = 5948 AND pid = 21930), false) AS by_id, contains(upper(vendor), 'TABLEAU') AS word FROM i)
SELECT device_id, by_id OR word AS hardware_blocked, by_id OR word OR ro AS write_blocked,
 CASE WHEN by_id OR word THEN 'KnownVidPid' WHEN ro THEN 'OsQuery' END AS detection_method FROM j""")
def write_blocker(spark, sf):
    inv = table(spark, sf, "part").selectExpr(
        "p_partkey AS device_id", "CASE p_partkey % 3 WHEN 0 THEN 3791 WHEN 1 THEN 5948 ELSE NULL END AS vid", "p_partkey % 12 AS pid",
        "IF(p_size % 7 = 0, 'Tableau unit', p_brand) AS vendor", "p_name AS model", "p_size % 5 = 0 AS os_read_only")
    return filters.write_blocker_flag(inv).select("device_id", "hardware_blocked", "write_blocked", "detection_method")


# ---- acquisition checks ------------------------------------------------------------
@query("acq4_dual_hash_report", f"""WITH {d.IMAGES} SELECT image_id, CASE WHEN verification_hash IS NULL THEN 'MISSING'
 WHEN lower(verification_hash) = lower(acquisition_hash) THEN 'MATCH' ELSE 'MISMATCH' END AS hash_status FROM images""")
def dual_hash(spark, sf):
    return acquire.dual_hash_report(d.images(spark, sf)).select("image_id", "hash_status")


@query("acq6_progress", f"""WITH {d.OPERATIONS} SELECT op_id, CASE WHEN parsable THEN round(CASE WHEN blocks = 0 THEN 0 ELSE
 least(current_lba * 100.0::DOUBLE / blocks, 100) END, 4) END AS percent FROM operations""")
def progress(spark, sf):
    return acquire.progress(d.operations(spark, sf)).select("op_id", r4("percent").alias("percent"))


@query("acq7_preflight", f"""WITH {d.OPERATIONS} SELECT op_id, blocks * 512 AS required_bytes, coalesce(CAST(floor(s_acctbal * 10000) AS BIGINT) >= blocks * 512, false) AS accepted
FROM operations LEFT JOIN supplier ON s_suppkey = case_id % 200""")
def preflight(spark, sf):
    plan = d.operations(spark, sf).select("op_id", "blocks", (F.col("case_id") % 200).alias("volume_id"))
    vols = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("volume_id"), F.floor(F.col("s_acctbal") * 10000).cast("bigint").alias("available_bytes"))
    return acquire.preflight(plan, vols).select("op_id", "required_bytes", "accepted")


@query("acq8_resume_check", f"""WITH {d.OPERATIONS} SELECT op_id, parsable AND coalesce(lower(fp) = lower('fp' || (s_nationkey * 4)), false) AS may_resume
FROM operations LEFT JOIN supplier ON s_suppkey = op_id % 97""")
def resume_check(spark, sf):
    ops = filters.with_checkpoint(d.operations(spark, sf)).select(
        "op_id", F.col("checkpoint.source_fingerprint").alias("source_fingerprint"), (F.col("op_id") % 97).alias("device_id"))
    dev = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("device_id"),
                                              F.concat(F.lit("fp"), (F.col("s_nationkey") * 4).cast("string")).alias("current_fingerprint"))
    return acquire.resume_check(ops, dev).select("op_id", "may_resume")


@query("jn12_manifest_diff", """WITH a AS (SELECT d.doc_id % 16 AS image_id, d.doc_id AS chunk_no, sha256(text) AS h FROM documents d),
 b AS (SELECT d.doc_id % 16 AS image_id, d.doc_id AS chunk_no, CASE WHEN quality = 1 THEN upper(sha256(text)) WHEN toxic = 1 THEN sha256(text || '!') ELSE sha256(text) END AS h
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id)
SELECT coalesce(a.image_id, b.image_id) AS image_id, coalesce(a.chunk_no, b.chunk_no) AS chunk_no, a.h AS acquired_hash, lower(b.h) AS reread_hash,
 CASE WHEN a.h IS NULL THEN 'missing_in_acquired' WHEN b.h IS NULL THEN 'missing_in_reread' ELSE 'mismatch' END AS status
FROM a FULL JOIN b ON a.image_id = b.image_id AND a.chunk_no = b.chunk_no WHERE a.h IS DISTINCT FROM lower(b.h)""")
def manifest_diff(spark, sf):
    docs = table(spark, sf, "documents").select((F.col("doc_id") % 16).alias("image_id"), F.col("doc_id").alias("chunk_no"), "text")
    a = docs.select("image_id", "chunk_no", F.sha2("text", 256).alias("chunk_hash"))
    lab = table(spark, sf, "labels").withColumnRenamed("doc_id", "chunk_no")
    b = docs.join(lab, "chunk_no").selectExpr(
        "image_id", "chunk_no", """CASE WHEN quality = 1 THEN upper(sha2(text, 256)) WHEN toxic = 1 THEN sha2(concat(text, '!'), 256)
        ELSE sha2(text, 256) END AS chunk_hash""")
    return acquire.manifest_diff(a, b, ["image_id"])


# ---- confidence --------------------------------------------------------------------
SAMPLES = """samples AS (SELECT d.doc_id, quality = 1 AS truth, least(n_chars / 2000.0::DOUBLE, 1.0::DOUBLE) AS header_footer, (n_chars % 101) / 100.0::DOUBLE AS structural,
 CASE n_chars % 5 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.6::DOUBLE WHEN 2 THEN 0.4::DOUBLE WHEN 3 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS metadata,
 (n_chars % 11) / 10.0::DOUBLE AS entropy, CASE WHEN n_chars % 3 = 0 THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS fragmentation,
 CASE WHEN toxic = 1 THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END AS overwrite FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""
SCORE = """greatest(least(0.20::DOUBLE*header_footer + 0.25::DOUBLE*structural + 0.20::DOUBLE*metadata + 0.15::DOUBLE*entropy
 + 0.15::DOUBLE*fragmentation + 0.05::DOUBLE*overwrite, 1), 0)"""


def samples(spark, sf):
    n = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    meta = F.when(F.col("n_chars") % 5 == 0, "Confirmed").when(F.col("n_chars") % 5 == 1, "Partial").when(
        F.col("n_chars") % 5 == 2, "Reconstructed").when(F.col("n_chars") % 5 == 3, "Low").otherwise("none")
    return n.select(
        "doc_id", (F.col("quality") == 1).alias("truth"), F.least(F.col("n_chars") / 2000.0, F.lit(1.0)).alias("header_footer"),
        ((F.col("n_chars") % 101) / 100.0).alias("structural"), scoring.metadata_score(meta).alias("metadata"),
        ((F.col("n_chars") % 11) / 10.0).alias("entropy"),
        scoring.fragmentation_score(F.when(F.col("n_chars") % 3 == 0, "partial").otherwise("contiguous"), F.lit(0), 2048).alias("fragmentation"),
        scoring.overwrite_score(F.lit(1), F.when(F.col("toxic") == 1, "Partial").otherwise("Confirmed")).alias("overwrite"))


@query("cnf3_metadata_score", """SELECT l_orderkey, l_linenumber, CASE l_linenumber % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.6 WHEN 2 THEN 0.4 WHEN 3 THEN 0.1 ELSE 0.0 END::DOUBLE AS metadata FROM lineitem""")
def metadata_score(spark, sf):
    names = F.array(*[F.lit(x) for x in ("Confirmed", "Partial", "Reconstructed", "Low", "none")])
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", scoring.metadata_score(
        F.element_at(names, F.col("l_linenumber") % 5 + 1)).alias("metadata"))


@query("cnf4_fragmentation_score", """SELECT l_orderkey, l_linenumber, l_partkey, round(CASE l_linenumber % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.8::DOUBLE
 ELSE greatest(least(1 - least(l_partkey / 2048.0::DOUBLE, 1) * 0.5::DOUBLE, 1), 0.1::DOUBLE) END, 6) AS fragmentation FROM lineitem""")
def fragmentation_score(spark, sf):
    kind = F.when(F.col("l_linenumber") % 3 == 0, "contiguous").when(F.col("l_linenumber") % 3 == 1, "partial").otherwise("reassembled")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r6(
        scoring.fragmentation_score(kind, F.col("l_partkey"), 2048)).alias("fragmentation"))


@query("cnf5_overwrite_score", """SELECT l_orderkey, l_linenumber, l_returnflag, CASE WHEN l_linenumber % 3 + 1 = 1 AND l_returnflag <> 'A' THEN 0.6 ELSE 1.0 END::DOUBLE AS overwrite FROM lineitem""")
def overwrite_score(spark, sf):
    conf = F.when(F.col("l_returnflag") == "A", "Confirmed").otherwise("Partial")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", scoring.overwrite_score(
        F.col("l_linenumber") % 3 + 1, conf).alias("overwrite"))


@query("cnf6_composite_confidence", f"WITH {SAMPLES} SELECT doc_id, round({SCORE}, 6) AS confidence FROM samples")
def composite(spark, sf):
    return samples(spark, sf).select("doc_id", r6(scoring.composite()).alias("confidence"))


RATES = """round(CASE WHEN tp+fp>0 THEN tp::DOUBLE/(tp+fp) ELSE 0 END,6) AS "precision", round(CASE WHEN tp+fn>0 THEN tp::DOUBLE/(tp+fn) ELSE 0 END,6) AS recall,
 round(CASE WHEN tp>0 THEN 2.0*tp/(2*tp+fp+fn) ELSE 0 END::DOUBLE,6) AS f1, round(sse/n,6) AS brier"""


@query("cal1_evaluate_profile", f"""WITH {SAMPLES}, s AS (SELECT truth, {SCORE} AS score FROM samples),
 c AS (SELECT count(*) AS n, count(*) FILTER (score>=0.7::DOUBLE AND truth) AS tp, count(*) FILTER (score>=0.7::DOUBLE AND NOT truth) AS fp,
 count(*) FILTER (score<0.7::DOUBLE AND NOT truth) AS tn, count(*) FILTER (score<0.7::DOUBLE AND truth) AS fn, sum((score-truth::INT)*(score-truth::INT)) AS sse FROM s)
SELECT n, tp, fp, tn, fn, {RATES} FROM c""")
def evaluate_profile(spark, sf):
    return calibrate.evaluate_profile(samples(spark, sf)).select(
        "n", "tp", "fp", "tn", "fn", *[r6(c).alias(c) for c in ("precision", "recall", "f1", "brier")])


GRID = """g5(i, v) AS (VALUES (0, 0.10::DOUBLE), (1, 0.15::DOUBLE), (2, 0.20::DOUBLE), (3, 0.25::DOUBLE), (4, 0.30::DOUBLE)),
 g3(i, v) AS (VALUES (0, 0.05::DOUBLE), (1, 0.10::DOUBLE), (2, 0.15::DOUBLE)),
 raw AS (SELECT 1 + a.i*75 + b.i*15 + c.i*3 + e.i AS profile, a.v AS w1, b.v AS w2, c.v AS w3, e.v AS w4, a.v+b.v+c.v+e.v+0.15::DOUBLE+0.05::DOUBLE AS t
  FROM g5 a, g5 b, g5 c, g3 e),
 grid AS (SELECT 0 AS profile, 0.20::DOUBLE AS w1, 0.25::DOUBLE AS w2, 0.20::DOUBLE AS w3, 0.15::DOUBLE AS w4, 0.15::DOUBLE AS w5, 0.05::DOUBLE AS w6
  UNION ALL SELECT profile, w1/t, w2/t, w3/t, w4/t, 0.15::DOUBLE/t, 0.05::DOUBLE/t FROM raw),
 sc AS (SELECT profile, truth, greatest(least(w1*header_footer+w2*structural+w3*metadata+w4*entropy+w5*fragmentation+w6*overwrite,1),0) AS score FROM samples, grid),
 m AS (SELECT profile, count(*) AS n, count(*) FILTER (score>=0.7::DOUBLE AND truth) AS tp, count(*) FILTER (score>=0.7::DOUBLE AND NOT truth) AS fp,
 count(*) FILTER (score<0.7::DOUBLE AND NOT truth) AS tn, count(*) FILTER (score<0.7::DOUBLE AND truth) AS fn, sum((score-truth::INT)*(score-truth::INT)) AS sse FROM sc GROUP BY profile)"""


@query("cal2_grid_metrics", f"WITH {SAMPLES}, {GRID} SELECT profile, n, tp, fp, tn, fn, {RATES} FROM m")
def grid_metrics(spark, sf):
    return calibrate.grid_metrics(samples(spark, sf)).select(
        "profile", "n", "tp", "fp", "tn", "fn", *[r6(c).alias(c) for c in ("precision", "recall", "f1", "brier")])


@query("cal2_grid_search", f"""WITH {SAMPLES}, {GRID}, r AS (SELECT profile, {RATES}, sse/n AS b FROM m)
SELECT profile, f1, brier, round(w1,6) AS w_header_footer, round(w2,6) AS w_structural, round(w3,6) AS w_metadata, round(w4,6) AS w_entropy FROM r JOIN grid USING (profile)
ORDER BY f1 DESC, round(b,9), profile LIMIT 1""")
def grid_search(spark, sf):
    w = ["w_header_footer", "w_structural", "w_metadata", "w_entropy"]
    return calibrate.grid_search(samples(spark, sf)).select("profile", *[r6(c).alias(c) for c in ["f1", "brier", *w]])


@query("cal3_calibration_curve", f"""WITH {SAMPLES} SELECT least(CAST(floor(s*10) AS INT), 9) AS bucket, count(*) AS n, round(avg(s),6) AS mean_predicted, round(avg(truth::INT),6) AS observed
FROM (SELECT truth, {SCORE} AS s FROM samples) GROUP BY 1""")
def calibration_curve(spark, sf):
    scored = samples(spark, sf).select("truth", scoring.composite().alias("score"))
    return calibrate.calibration_curve(scored).select("bucket", "n", r6("mean_predicted").alias("mean_predicted"), r6("observed").alias("observed"))


@query("cal4_benchmark_metrics", """WITH p AS (SELECT page_id, strlen(html) AS n, strlen(html) - strlen(replace(html, 'a', '')) AS na FROM pages),
 got AS (SELECT page_id + CASE WHEN page_id % 11 = 0 THEN 1000000 ELSE 0 END AS k, n, na, page_id % 3 = 0 AS changed, page_id % 7 = 5 AS lost FROM p),
 j AS (SELECT g.k, p.page_id, p.n, CASE WHEN g.changed THEN p.n - p.na ELSE p.n END AS eq FROM (SELECT * FROM got WHERE NOT lost) g FULL JOIN p ON p.page_id = g.k),
 c AS (SELECT count(*) FILTER (k IS NOT NULL AND page_id IS NOT NULL) AS tp, count(*) FILTER (page_id IS NULL) AS fp, count(*) FILTER (k IS NULL) AS fn,
  count(*) FILTER (k IS NOT NULL AND page_id IS NOT NULL AND eq = n) AS exact, avg(eq::DOUBLE/n) FILTER (k IS NOT NULL AND page_id IS NOT NULL) AS ba FROM j)
SELECT tp, fp, fn, exact, round(tp::DOUBLE/(tp+fp),6) AS "precision", round(tp::DOUBLE/(tp+fn),6) AS recall, round(2.0::DOUBLE*tp/(2*tp+fp+fn),6) AS f1,
 round(fp::DOUBLE/(tp+fp),6) AS false_positive_rate, round(tp::DOUBLE/(tp+fn),6) AS completeness, round(ba,6) AS byte_accuracy FROM c""")
def benchmark(spark, sf):
    pages = table(spark, sf, "pages")
    truth = pages.select(F.lit(0).alias("image_id"), F.col("page_id").alias("start_lba"), F.encode("html", "UTF-8").alias("payload"))
    got = pages.where("page_id % 7 <> 5").selectExpr(
        "0 AS image_id", "page_id + IF(page_id % 11 = 0, 1000000, 0) AS start_lba",
        "encode(IF(page_id % 3 = 0, replace(html, 'a', 'b'), html), 'UTF-8') AS payload")
    m = calibrate.benchmark_metrics(got, truth)
    return m.select("tp", "fp", "fn", "exact", *[r6(c).alias(c) for c in (
        "precision", "recall", "f1", "false_positive_rate", "completeness", "byte_accuracy")])


# ---- wipe and health ---------------------------------------------------------------
@query("san1_deterministic_check", f"""WITH {FILLED}, img AS (SELECT image_id % 16 AS image_id, lba, h FROM filled), tot AS (SELECT image_id, max(lba)+1 AS total_blocks FROM img GROUP BY 1),
 want AS (SELECT DISTINCT l_suppkey % 16 AS image_id, l_orderkey * 3 AS lba FROM lineitem),
 j AS (SELECT w.image_id, coalesce(i.h = repeat(substr(i.h,1,2),32), false) AS ok FROM want w JOIN tot t ON t.image_id=w.image_id AND w.lba < t.total_blocks
  LEFT JOIN img i ON i.image_id=w.image_id AND i.lba=w.lba)
SELECT t.image_id, count(*) FILTER (ok) AS matches, count(*) FILTER (NOT ok) AS mismatches, count(*) FILTER (ok) >= 1 AND count(*) FILTER (NOT ok) = 0 AS passed
FROM tot t LEFT JOIN j ON j.image_id = t.image_id GROUP BY 1""")
def deterministic_check(spark, sf):
    img = filled(spark, sf).withColumn("image_id", F.col("image_id") % 16)
    tot = img.groupBy("image_id").agg((F.max("lba") + 1).alias("total_blocks"))
    want = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 16).alias("image_id"), (F.col("l_orderkey") * 3).alias("lba"))
    return wipe.deterministic_check(img, want, tot, ["image_id"])


@query("san2_required_sample_size", """SELECT o_orderkey, CASE WHEN n=0 THEN 0 ELSE least(greatest(CAST(ceil((1-pow(0.05::DOUBLE, 1/greatest(n*0.01::DOUBLE,1)))*n) AS BIGINT),10),n,50000) END AS sample_size
FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS n FROM orders)""")
def sample_size(spark, sf):
    n = F.floor("o_totalprice").cast("bigint")
    return table(spark, sf, "orders").select("o_orderkey", rules.required_sample_size(n, 0.95, 0.01).alias("sample_size"))


@query("san3_statistical_check", """WITH s AS (SELECT o_custkey % 5 AS image_id, o_orderkey AS lba FROM orders), t AS (SELECT image_id, count(*) AS n FROM s GROUP BY 1)
SELECT image_id, least(greatest(CAST(ceil((1-pow(0.05::DOUBLE, 1/greatest(n*0.01::DOUBLE,1)))*n) AS BIGINT),10),n,50000) AS sample_size, image_id <> 3 AS passed FROM t""")
def statistical_check(spark, sf):
    s = table(spark, sf, "orders").selectExpr("o_custkey % 5 AS image_id", "o_orderkey AS lba",
                                              "IF(o_custkey % 5 = 3, encode('dirty', 'UTF-8'), unhex(repeat('00', 32))) AS payload")
    tot = s.groupBy("image_id").agg(F.count(F.lit(1)).alias("total_blocks"))
    return wipe.statistical_check(s, tot, ["image_id"]).select("image_id", "sample_size", "passed")


LAYERS = f"""layers AS (SELECT o_orderkey AS device_id, o_orderkey % 13 <> 0 AS l1, o_custkey % 5 <> 0 AS l2, o_custkey % 7 <> 0 AS l3, o_custkey % 11 <> 0 AS l4, o_orderkey % 17 <> 0 AS l5,
 CASE o_orderkey % 7 {' '.join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(d.MEDIA))} END AS media_type,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'HostOverwriteSinglePass' WHEN '2-HIGH' THEN 'NvmeFormat' WHEN '3-MEDIUM' THEN 'HostOverwriteMultiPass' END AS method FROM orders)"""


def layers(spark, sf):
    media = F.element_at(F.array(*[F.lit(m) for m in d.MEDIA]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("device_id"), (F.col("o_orderkey") % 13 != 0).alias("l1"), (F.col("o_custkey") % 5 != 0).alias("l2"),
        (F.col("o_custkey") % 7 != 0).alias("l3"), (F.col("o_custkey") % 11 != 0).alias("l4"), (F.col("o_orderkey") % 17 != 0).alias("l5"),
        media.alias("media_type"), F.expr("""CASE o_orderpriority WHEN '1-URGENT' THEN 'HostOverwriteSinglePass' WHEN '2-HIGH' THEN 'NvmeFormat'
        WHEN '3-MEDIUM' THEN 'HostOverwriteMultiPass' END""").alias("method"))


ASSURANCE = """CASE WHEN NOT l5 OR NOT l1 THEN 'FAILED' WHEN l2 AND l3 AND l4 THEN CASE WHEN media_type IN ('Nvme','SataSsd','Usb','SdCard')
 AND coalesce(method LIKE 'HostOverwrite%', false) THEN 'MEDIUM' ELSE 'HIGH' END WHEN l3 AND l4 THEN 'MEDIUM' ELSE 'LOW' END"""


@query("san5_overall_assurance", f"WITH {LAYERS} SELECT device_id, {ASSURANCE} AS assurance FROM layers")
def assurance(spark, sf):
    return wipe.overall_assurance(layers(spark, sf)).select("device_id", "assurance")


@query("san6_residual_state", """SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'UnableToVerify' WHEN o_custkey % 4 = 0 THEN 'ResidualTracesDetected'
 WHEN o_custkey % 3 > 0 AND o_orderkey % 2 = 0 AND o_orderkey % 5 > 0 THEN 'Sanitized' WHEN o_custkey % 3 > 0 THEN 'PartiallySanitized' ELSE 'ResidualTracesDetected' END AS state FROM orders""")
def residual(spark, sf):
    c = F.col
    return table(spark, sf, "orders").select("o_orderkey", rules.residual_state(
        c("o_custkey") % 3 > 0, c("o_orderkey") % 2 == 0, c("o_orderkey") % 5 > 0, F.when(c("o_custkey") % 4 == 0, 2).otherwise(0),
        F.when(c("o_orderkey") % 9 == 0, F.lit("read failed"))).alias("state"))


@query("san7_recommend_method", f"""WITH {d.EVIDENCE}, s AS (SELECT *, evidence_id % 5 = 0 AS crypto, evidence_id % 3 = 0 AS best, evidence_id % 2 = 0 AS plain FROM evidence),
 m AS (SELECT *, CASE WHEN crypto THEN 'CryptographicErase' WHEN media_type='Nvme' AND best THEN 'NvmeSanitizeBlock' WHEN media_type='Nvme' AND plain THEN 'NvmeFormat'
 WHEN media_type='SataSsd' AND best THEN 'AtaEnhancedSecureErase' WHEN media_type='SataSsd' AND plain THEN 'AtaSecureErase' ELSE 'HostOverwriteSinglePass' END AS method FROM s)
SELECT evidence_id, method, CASE method WHEN 'CryptographicErase' THEN CASE WHEN best THEN 'NvmeSanitizeBlock' END WHEN 'NvmeSanitizeBlock' THEN CASE WHEN plain THEN 'NvmeFormat' END
 WHEN 'AtaEnhancedSecureErase' THEN CASE WHEN plain THEN 'AtaSecureErase' END WHEN 'HostOverwriteSinglePass' THEN 'HostOverwriteMultiPass' END AS alternative,
 method = 'HostOverwriteSinglePass' AND media_type <> 'Hdd' AS residual_risk FROM m""")
def recommend(spark, sf):
    sup = F.array_compact(F.array(
        F.when(F.col("evidence_id") % 5 == 0, "CryptographicErase"), F.when(F.col("evidence_id") % 3 == 0, "NvmeSanitizeBlock"),
        F.when(F.col("evidence_id") % 2 == 0, "NvmeFormat"), F.when(F.col("evidence_id") % 3 == 0, "AtaEnhancedSecureErase"),
        F.when(F.col("evidence_id") % 2 == 0, "AtaSecureErase")))
    e = d.evidence(spark, sf).withColumn("supported", sup)
    e = e.withColumn("method", rules.recommend_method(F.col("media_type"), F.col("supported")))
    return e.select("evidence_id", "method", rules.alternative_method(F.col("method"), F.col("supported")).alias("alternative"),
                    rules.residual_risk(F.col("media_type"), F.col("method")).isNotNull().alias("residual_risk"))


@query("hlt1_health_status", f"WITH {d.TELEMETRY} SELECT event_id, device_id, {d.HEALTH} AS status FROM telemetry")
def health(spark, sf):
    return d.telemetry(spark, sf).select("event_id", "device_id", rules.health_status().alias("status"))


@query("hlt2_hidden_area", """SELECT vendor, count(*) AS devices, CAST(sum(hidden) AS BIGINT) AS hidden_sectors FROM (SELECT p_brand AS vendor, greatest(p_partkey * 7 - p_size * 100, 0) AS hidden,
 p_size % 3 = 0 OR p_size % 4 = 0 AS present FROM part) WHERE present GROUP BY vendor""")
def hidden(spark, sf):
    inv = table(spark, sf, "part").selectExpr("p_brand AS vendor", "p_size % 3 = 0 AS hpa_detected", "p_size % 4 = 0 AS dco_detected",
                                              "p_partkey * 7 AS native_max_lba", "p_size * 100L AS user_max_lba")
    return wipe.hidden_area(inv).groupBy("vendor").agg(F.count(F.lit(1)).alias("devices"), F.sum("hidden_sectors").alias("hidden_sectors"))


@query("byt10_block_summary", f"""WITH {FILLED}, {d.EXTENTS.replace('extents AS', 'ext0 AS')}, ext AS (SELECT image_id, start_lba // 10 AS start_lba, block_count,
 CASE start_lba // 10 % 3 WHEN 0 THEN 'allocated' WHEN 1 THEN 'artifact' ELSE 'bad_sector' END AS kind FROM ext0),
 f AS (SELECT image_id % 16 AS image_id, lba, h FROM filled),
 b AS (SELECT image_id, lba, unnest(regexp_extract_all(h, '..')) AS v FROM f), c AS (SELECT image_id, lba, v, count(*) AS n FROM b GROUP BY ALL),
 en AS (SELECT image_id, lba, abs(sum(-(n/32.0::DOUBLE)*log2(n/32.0::DOUBLE))) AS e FROM c GROUP BY ALL),
 hit AS (SELECT f.image_id, f.lba, max(CASE kind WHEN 'allocated' THEN 1 WHEN 'artifact' THEN 2 ELSE 3 END) AS r FROM f JOIN ext ON ext.image_id=f.image_id
  AND f.lba>=ext.start_lba AND f.lba<ext.start_lba+ext.block_count GROUP BY ALL)
SELECT f.image_id, f.lba, CASE WHEN h=repeat('00',32) THEN 'zero' WHEN h=repeat(substr(h,1,2),32) THEN 'uniform' ELSE 'mixed' END AS content, round(e,4) AS entropy,
 CASE coalesce(r,0) WHEN 0 THEN 'unallocated' WHEN 1 THEN 'allocated' WHEN 2 THEN 'artifact' ELSE 'bad_sector' END AS status
FROM f JOIN en USING (image_id, lba) LEFT JOIN hit USING (image_id, lba)""")
def block_summary(spark, sf):
    s = filled(spark, sf).withColumn("image_id", F.col("image_id") % 16)
    kinds = F.element_at(F.array(F.lit("allocated"), F.lit("artifact"), F.lit("bad_sector")), (F.col("start_lba") % 3 + 1).cast("int"))
    ext = d.extents(spark, sf).withColumn("start_lba", F.floor(F.col("start_lba") / 10).cast("bigint")).withColumn("kind", kinds)
    return byte_stats.block_summary(s, ext, ["image_id"]).withColumn("entropy", r4("entropy"))
