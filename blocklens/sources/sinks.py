"""Writers (SNK-1, SNK-2, SNK-4)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blocklens.operators import reports


def write_artifacts(artifacts: DataFrame, path: str, op_id, mode: str = "append") -> None:
    """SNK-1: rows without payload by type, payloads in their own table; both sorted by image inside a file.

    A task writes one file per type: folders per image would be as many as the images times the types. A reader
    of one image skips the row groups of others by their bounds.
    """
    rows = artifacts.withColumn("op_id", F.lit(op_id)).withColumn("tier", F.col("tier").cast("int"))
    rows.drop("payload").sortWithinPartitions("file_type", "image_id").write.mode(mode).partitionBy("file_type").parquet(f"{path}/artifacts")
    if "payload" in artifacts.columns:
        payloads = rows.select("image_id", "artifact_id", "op_id", "content_hash", "payload")
        payloads.sortWithinPartitions("image_id").write.mode(mode).parquet(f"{path}/payloads")


def write_report(report: DataFrame, path: str, id_cols, title: str, list_col: str) -> None:
    """SNK-2: JSON documents and Markdown texts, one per report part."""
    docs = reports.to_document(report, id_cols, title, list_col)
    docs.select(*id_cols, "content_json", "content_sha256").write.mode("overwrite").json(f"{path}/json")
    docs.select("content_markdown").write.mode("overwrite").option("lineSep", "\n\f\n").text(f"{path}/markdown")


def upsert_latest(batch: DataFrame, path: str, keys, order: str) -> None:
    """Merge a micro-batch into a table of the latest row per key.

    The new version goes to a folder of its own and a one-row pointer file names it, so a
    failed attempt leaves the old version in place and a repeated one gives the same rows.
    """
    spark = batch.sparkSession
    current = read_latest(spark, path)
    both = batch if current is None else batch.unionByName(current.select(*batch.columns))
    rest = [c for c in batch.columns if c not in keys]
    merged = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*").select(*batch.columns)
    version = 1 if current is None else _version(spark, path) + 1
    merged.write.mode("overwrite").parquet(f"{path}/v{version}")
    spark.range(1).select(F.lit(version).alias("version")).coalesce(1).write.mode("append").json(f"{path}/pointer")


def _version(spark, path: str) -> int:
    return spark.read.schema("version int").json(f"{path}/pointer").agg(F.max("version")).first()[0]


def read_latest(spark, path: str) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    pointer = jvm.org.apache.hadoop.fs.Path(f"{path}/pointer")
    if not pointer.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(pointer):
        return None
    return spark.read.parquet(f"{path}/v{_version(spark, path)}")


def checkpoint_sink(progress: DataFrame, path: str, checkpoint: str, every_blocks: int = 10_000):
    """SNK-4: keep the latest progress row per job, at block multiples and at the end."""
    due = progress.where((F.col("current_lba") % every_blocks == 0) | (F.col("current_lba") >= F.col("end_lba")))

    def merge(batch: DataFrame, _epoch: int) -> None:
        upsert_latest(batch, path, ["job_id"], "current_lba")

    return due.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def write_objects(rows: DataFrame, directory: str, key: str, payload: str, suffix: str = "") -> int:
    """A file ``<key><suffix>`` per row, in one folder, each written where its row lies; gives their number.

    A file writer partitioned by the key makes a folder per row and moves each of them at the end. A task that runs again writes the same
    files. Keys are unique; a null payload is an empty file.
    """
    from pyarrow import fs as arrow_fs

    def place():
        return arrow_fs.FileSystem.from_uri(directory) if "://" in directory else (arrow_fs.LocalFileSystem(), directory)

    def run(batches):
        system, inner = place()
        for batch in batches:
            names, data = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name, body in zip(names, data):
                with system.open_output_stream(f"{inner}/{name}{suffix}") as out:
                    out.write(body or b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    system, inner = place()
    system.create_dir(inner, recursive=True)
    wanted = rows.select(F.col(key).cast("string").alias("name"), F.col(payload).alias("body"))
    return wanted.mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
