"""Evidence vault tables (SRC-4), object loads (SRC-5) and ledger feeds (SRC-6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# relation -> columns as stored (text times, JSON text)
VAULT = {
    "cases": "case_id string, case_name string, investigator_id string, created_at string, status string",
    "evidence_items": "evidence_id string, case_id string, item_type string, device_serial string, manufacturer string, model string, "
                      "capacity_bytes bigint, interface string, filesystem string, device_fingerprint_hash string, source_location string, "
                      "physical_condition string, write_block_status string, current_custody_owner string, current_location string",
    "forensic_images": "image_id string, evidence_id string, image_format string, file_path string, acquisition_hash string, "
                       "verification_hash string, bad_sector_map_json string, acquired_at string, operator string",
    "operations": "op_id string, case_id string, evidence_id string, op_type string, parameters_json string, tool_version string, "
                  "build_id string, started_at string, completed_at string, status string",
    "recovered_artifacts": "artifact_id string, op_id string, original_path string, recovered_path string, file_type string, recovery_tier int, "
                           "confidence_score double, confidence_breakdown_json string, provenance_json string",
    "sanitization_events": "san_id string, op_id string, method string, standard_reference string, verification_layers_json string, assurance_level string",
    "custody_events": "event_id string, evidence_id string, event_type string, from_party string, to_party string, timestamp_utc string, "
                      "location string, purpose string, evidence_condition string, signature_ref string",
    "audit_log": "seq bigint, entry_json string, entry_hash string, prev_hash string",
    "reports": "report_id string, case_id string, report_type string, file_path_pdf string, file_path_json string, signature string, "
               "certificate_chain string, trusted_timestamp string",
}
TIMES = ["created_at", "acquired_at", "started_at", "completed_at", "timestamp_utc"]
BAD_MAP = "unreadable_ranges array<struct<start_lba:bigint,block_count:bigint,error_details:string>>, total_unreadable_blocks bigint, total_unreadable_bytes bigint"
BREAKDOWN = ("header_footer_integrity double, structural_validity double, metadata_cross_reference double, entropy_consistency double, "
             "fragmentation_confidence double, overwrite_probability double")
AUDIT_ENTRY = ("seq bigint, timestamp_utc string, operator_id string, case_id string, operation string, target_descriptor string, "
               "result string, prev_hash string, entry_hash string")
DECODED = {"bad_sector_map_json": ("bad_sector_map", BAD_MAP), "confidence_breakdown_json": ("confidence_breakdown", BREAKDOWN),
           "entry_json": ("entry", AUDIT_ENTRY)}


def decode(df: DataFrame) -> DataFrame:
    """Text times to TIMESTAMP, known JSON columns to structs."""
    for c in TIMES:
        if c in df.columns:
            df = df.withColumn(c, F.try_to_timestamp(c))
    for c, (name, schema) in DECODED.items():
        if c in df.columns:
            df = df.withColumn(name, F.from_json(c, schema)).drop(c)
    return df


def load_vault(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    """SRC-4: the nine relations, typed; columns prune through to the Parquet scan."""
    return {name: decode(spark.read.schema(schema).parquet(f"{directory}/{name}")) for name, schema in VAULT.items()}


def load_objects(spark: SparkSession, directory: str, pattern: str = "*") -> DataFrame:
    """SRC-5: whole files as ``(path, length, payload)``."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(directory)
            .select("path", "length", F.col("content").alias("payload")))


def stream_ledger(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_trigger: int | None = None,
                  pattern: str | None = None) -> DataFrame:
    """SRC-6: an append-only feed as a stream."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path)
