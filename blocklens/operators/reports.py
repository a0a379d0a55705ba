"""Case joins and report documents (JN-7..9, JN-11, RPT-1..10).

A report of an unbounded number of items is a sequence of numbered parts of at most
``page_size`` items, so no case, however large, is collected in one row or task. Counts in
every part describe the whole report.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blocklens.functions import rules
from blocklens.operators import ledger, slices

PAGE = 1000
SLICE_WIDTH = 1 << 16


def _of_case(df: DataFrame, case_id) -> DataFrame:
    return df if case_id is None else df.where(F.col("case_id") == case_id)


def case_artifacts(artifacts: DataFrame, operations: DataFrame, case_id=None) -> DataFrame:
    """Artifacts of the case's operations, in no order: reports order their own items."""
    return artifacts.join(_of_case(operations.select("op_id", "case_id"), case_id), "op_id")


def artifacts_for_case(artifacts: DataFrame, operations: DataFrame, case_id=None) -> DataFrame:
    """JN-7: artifacts of the case's operations in id order."""
    return case_artifacts(artifacts, operations, case_id).orderBy("artifact_id")


def case_images(images: DataFrame, evidence: DataFrame, case_id=None) -> DataFrame:
    """Images of the case's evidence, in no order."""
    return images.join(_of_case(evidence.select("evidence_id", "case_id"), case_id), "evidence_id")


def images_for_case(images: DataFrame, evidence: DataFrame, case_id=None) -> DataFrame:
    """JN-8: images of the case's evidence by acquisition time."""
    return case_images(images, evidence, case_id).orderBy("acquired_at")


def custody_for_case(evidence: DataFrame, custody: DataFrame, case_id=None) -> DataFrame:
    """JN-9."""
    return custody.join(_of_case(evidence.select("evidence_id", "case_id"), case_id), "evidence_id")


def manifest_match(files: DataFrame, manifest: DataFrame, keys: Sequence[str] = (), found: bool = True) -> DataFrame:
    """JN-11: files whose hash occurs (or not) in the manifest of the same report."""
    m = manifest.select(*keys, F.lower("sha256_hash").alias("_h")).distinct()
    left = files.withColumn("_h", F.lower("sha256_hash"))
    return left.join(m, [*keys, "_h"], "left_semi" if found else "left_anti").drop("_h")


def paged(rows: DataFrame, keys: Sequence[str], order: Sequence[str], item: Column, name: str, page_size: int = PAGE,
          slice_width: int = SLICE_WIDTH) -> DataFrame:
    """``(keys, part, name)`` with at most ``page_size`` items per part, in order.

    ``order[0]`` is an integer column; positions come from sliced row numbers. Items are built behind the numbering, so that
    their columns move once beside the order and not a second time within the item.
    """
    numbered = slices.row_numbers(rows, keys, list(order), slices.by_width(order[0], slice_width), "_pos")
    part = F.floor((F.col("_pos") - 1) / page_size).cast("int").alias("part")
    return (numbered.groupBy(*keys, part).agg(F.array_sort(F.collect_list(F.struct("_pos", item.alias("_item")))).alias("_l"))
            .withColumn(name, F.transform("_l", lambda x: x["_item"])).drop("_l"))


def list_cases(cases: DataFrame, evidence: DataFrame) -> DataFrame:
    """RPT-1: newest first with evidence counts; counting before the join keeps it narrow."""
    n = evidence.groupBy("case_id").agg(F.count(F.lit(1)).alias("evidence_count"))
    return cases.join(n, "case_id", "left").na.fill(0, ["evidence_count"]).orderBy(F.desc("created_at"))


def case_timeline(operations: DataFrame, case_id=None) -> DataFrame:
    """RPT-2."""
    return _of_case(operations, case_id).orderBy("started_at", "op_id")


def recovery_stats(artifacts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """RPT-3: totals per key, or one row for everything (zeros for an empty table)."""
    tier = lambda n: F.count_if(F.col("tier") == n).alias(f"tier{n}_count")
    return artifacts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), tier(1), tier(2), tier(3), F.coalesce(F.sum("recovered_bytes"), F.lit(0)).alias("total_bytes"),
        F.coalesce(F.avg("confidence_score"), F.lit(0.0)).alias("mean_confidence"))


def recovery_report(artifacts: DataFrame, page_size: int = PAGE) -> DataFrame:
    """RPT-4: per case the tiers run, counts by tier and type, and the artifact list in parts."""
    totals = recovery_stats(artifacts, ["case_id"])
    kinds = (artifacts.groupBy("case_id", "file_type").agg(F.count(F.lit(1)).alias("n")).groupBy("case_id")
             .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("file_type", "n")))).alias("type_counts")))
    item = F.struct("artifact_id", "file_type", "tier", "recovered_bytes", "confidence_score", "limitations")
    pages = paged(artifacts, ["case_id"], ["artifact_id", "op_id", "start_lba", "recovered_bytes"], item, "artifacts", page_size)
    tiers = F.array_compact(F.array(*[F.when(F.col(f"tier{n}_count") > 0, F.lit(f"Tier {n}")) for n in (1, 2, 3)]))
    return pages.join(totals, "case_id").join(kinds, "case_id").withColumn("tiers_run", tiers)


SECTIONS = ["evidence", "operations", "artifacts", "custody", "manifest"]


def forensic_exam_report(cases: DataFrame, evidence: DataFrame, operations: DataFrame, artifacts: DataFrame, custody: DataFrame,
                         images: DataFrame, page_size: int = PAGE) -> DataFrame:
    """RPT-5: one nested document per case and part; part ``i`` holds page ``i`` of every section."""
    def section(name: str, rows: DataFrame, order: list[str], fields: list[str]) -> DataFrame:
        pages = paged(rows, ["case_id"], order, F.to_json(F.struct(*fields)), "items", page_size)
        return pages.select("case_id", "part", F.lit(name).alias("section"), "items")

    got = section("evidence", evidence, ["evidence_id"], ["evidence_id", "serial", "vendor", "model", "capacity_bytes", "interface"])
    got = got.unionByName(section("operations", operations, ["op_id"], ["op_id", "op_type", "status"]))
    got = got.unionByName(section("artifacts", case_artifacts(artifacts, operations),
                                  ["artifact_id", "op_id", "start_lba", "recovered_bytes"], ["artifact_id", "file_type", "tier", "confidence_score"]))
    got = got.unionByName(section("custody", custody_for_case(evidence, custody), ["event_id"], ["event_id", "evidence_id", "event_type", "from_party", "to_party"]))
    got = got.unionByName(section("manifest", case_images(images, evidence), ["image_id"], ["evidence_id", "file_path", "acquisition_hash"]))
    empty = F.array().cast("array<string>")
    wide = got.groupBy("case_id", "part").agg(*[
        F.coalesce(F.max(F.when(F.col("section") == s, F.col("items"))), empty).alias(s) for s in SECTIONS])
    return cases.join(wide, "case_id", "left").withColumns(
        {"part": F.coalesce("part", F.lit(0)), **{s: F.coalesce(s, empty) for s in SECTIONS}})


def acquisition_report(images: DataFrame, evidence: DataFrame, bad_ranges: DataFrame, page_size: int = PAGE) -> DataFrame:
    """RPT-6: hashes, verified flag, unreadable ranges in parts and their count."""
    bad = bad_ranges.groupBy("image_id").agg(F.count(F.lit(1)).alias("bad_range_count"), F.sum("block_count").alias("bad_blocks"))
    pages = paged(bad_ranges, ["image_id"], ["start_lba"], F.struct("start_lba", "block_count"), "bad_ranges", page_size)
    j = (images.join(evidence, "evidence_id").join(bad, "image_id", "left").join(pages, "image_id", "left")
         .na.fill(0, ["bad_range_count", "bad_blocks", "part"]))
    ok = F.coalesce(F.lower("acquisition_hash") == F.lower("verification_hash"), F.lit(False))
    return j.withColumn("reread_verified", ok)


def device_health_report(inventory: DataFrame, telemetry: DataFrame) -> DataFrame:
    """RPT-7: device columns, latest reading with its status, and the advice."""
    rest = [c for c in telemetry.columns if c != "device_id"]
    last = telemetry.groupBy("device_id").agg(F.max_by(F.struct(*rest), F.struct("ts", "event_id")).alias("_l")).select("device_id", "_l.*")
    j = inventory.join(last, "device_id", "left").withColumn("status", F.when(F.col("kind").isNull(), "Unknown").otherwise(rules.health_status()))
    return j.withColumn("recommendation", rules.health_advice(F.col("status")))


def custody_report(evidence: DataFrame, history: DataFrame, page_size: int = PAGE) -> DataFrame:
    """RPT-8: current holder and place, event count, and the formatted events in parts."""
    n = history.groupBy("evidence_id").agg(F.count(F.lit(1)).alias("total_events"))
    now = ledger.custody_current(history)
    pages = paged(ledger.custody_ledger_text(history), ["evidence_id"], ["event_id"], F.col("line"), "events", page_size)
    return (evidence.join(now, "evidence_id", "left").join(n, "evidence_id", "left").join(pages, "evidence_id", "left")
            .na.fill(0, ["total_events", "part"]))


def sanitization_report(inventory: DataFrame, layers: DataFrame) -> DataFrame:
    """RPT-9: device, the five layer results and the overall assurance."""
    c = F.col
    return inventory.join(layers, "device_id").withColumn("assurance", rules.overall_assurance(
        c("l1"), c("l2"), c("l3"), c("l4"), c("l5"), c("media_type"), c("method")))


def report_checks(reports: DataFrame) -> DataFrame:
    """RPT-10: content hash, chain segment, timestamp label, manifest (when a hash is given), overall."""
    content = F.lower(F.sha2("content_json", 256)) == F.lower("content_sha256")
    stamp = F.when(F.col("is_rfc3161"), F.col("token").isNotNull() & F.col("tsa_url").isNotNull()).otherwise(
        F.coalesce(F.col("status_label").contains("Local timestamp"), F.lit(False)))
    listed = F.exists("evidence_manifest", lambda m: F.lower(m["sha256_hash"]) == F.lower(F.col("evidence_hash")))
    seg = ledger.verify_segment(reports).select("report_id", F.col("is_valid").alias("segment_ok"))
    out = (reports.join(seg, "report_id").withColumn("content_ok", content).withColumn("timestamp_ok", stamp)
           .withColumn("manifest_ok", F.when(F.col("evidence_hash").isNotNull(), listed)))
    return out.withColumn("overall", F.col("content_ok") & F.col("segment_ok") & F.col("timestamp_ok") & F.coalesce("manifest_ok", F.lit(True)))


def to_document(report: DataFrame, id_cols: Sequence[str], title: str, list_col: str) -> DataFrame:
    """SNK-2 body: one JSON text and one Markdown text per report part."""
    scalars = [c for c in report.columns if c != list_col]
    head = F.concat_ws("\n", F.lit(f"# {title}"), F.lit(""), *[
        F.concat(F.lit(f"**{c}:** "), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in scalars])
    items = F.transform(list_col, lambda x: F.concat(F.lit("- "), F.to_json(F.struct(x.alias("item")))))
    return report.select(*id_cols, F.to_json(F.struct(*report.columns)).alias("content_json"),
                         F.concat_ws("\n", head, F.lit(""), F.array_join(items, "\n")).alias("content_markdown")
                         ).withColumn("content_sha256", F.sha2("content_json", 256))
