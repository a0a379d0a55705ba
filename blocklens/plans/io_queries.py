"""Sources and sinks driven from the tables: each writes derived data to the shared folder and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from blocklens.operators import acquire, calibrate
from blocklens.plans import domain as d
from blocklens.plans import rule_queries as rq
from blocklens.plans.catalog import ORACLES, query, r6, table
from blocklens.session import checkpoint_root
from blocklens.sources import signatures, sinks, vault
from blocklens.plans import stream_queries as sq


def folder(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/io/{uuid.uuid4().hex}"


@query("src3_read_signatures", """SELECT p_brand AS file_type, hex(encode(p_brand)) AS header_hex, CASE WHEN strlen(p_brand) % 2 = 0 THEN hex(encode(p_brand || '!')) END AS footer_hex,
 max(p_partkey) AS max_size_bytes, CAST(strlen(p_brand) % 3 AS INT) AS header_offset FROM part GROUP BY p_brand""")
def read_signatures(spark, sf):
    """A signature document made from the part brands, one per brand."""
    at = folder(spark)
    codes = lambda c: F.transform(F.split(c, ""), lambda x: F.ascii(x))
    n = F.length("p_brand")
    rows = table(spark, sf, "part").groupBy("p_brand").agg(F.max("p_partkey").alias("max_size_bytes"))
    sig = F.struct(F.col("p_brand").alias("file_type"), codes(F.col("p_brand")).alias("header"),
                   F.when(n % 2 == 0, codes(F.concat("p_brand", F.lit("!")))).alias("footer"), "max_size_bytes",
                   F.col("p_brand").alias("validator_id"), F.when(n % 3 != 0, n % 3).alias("header_offset"))
    rows.select(F.to_json(sig).alias("value")).write.text(at)
    got = signatures.read_signatures(spark, at, multi_line=False)
    return got.select("file_type", F.hex("header").alias("header_hex"), F.hex("footer").alias("footer_hex"), "max_size_bytes", "header_offset")


@query("src4_load_vault", """SELECT CAST(o_orderkey AS VARCHAR) AS op_id, CAST(o_custkey AS VARCHAR) AS case_id, strftime(o_orderdate, '%Y-%m-%d') AS started, o_orderstatus AS status,
 completed IS NULL AS open FROM (SELECT *, CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate END AS completed FROM orders)""")
def load_vault(spark, sf):
    """Operations stored as vault text rows, the other relations empty, all loaded typed."""
    at = folder(spark)
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    ops = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("op_id"), F.col("o_custkey").cast("string").alias("case_id"), F.lit(None).cast("string").alias("evidence_id"),
        F.lit("Acquire").alias("op_type"), F.lit(None).cast("string").alias("parameters_json"), F.lit("1").alias("tool_version"), F.lit("b").alias("build_id"),
        iso.alias("started_at"), F.when(F.col("o_orderkey") % 3 > 0, iso).alias("completed_at"), F.col("o_orderstatus").alias("status"))
    for name, schema in vault.VAULT.items():
        (ops if name == "operations" else spark.createDataFrame([], schema)).write.parquet(f"{at}/{name}")
    got = vault.load_vault(spark, at)["operations"]
    return got.select("op_id", "case_id", F.date_format("started_at", "yyyy-MM-dd").alias("started"), "status", F.col("completed_at").isNull().alias("open"))


@query("src5_load_objects", "SELECT s_suppkey, CAST(strlen(s_name) + 1 AS BIGINT) AS length, sha256(s_name || chr(10)) AS content_hash FROM supplier")
def load_objects(spark, sf):
    """A file per supplier, written from the table and loaded as objects."""
    at = folder(spark)
    body = F.encode(F.concat(F.coalesce("s_name", F.lit("")), F.lit("\n")), "UTF-8")
    rows = table(spark, sf, "supplier").select("s_suppkey", body.alias("body"))
    # few bytes, much work: a set number of tasks, or adaptive execution would leave one
    sinks.write_objects(rows.repartition(spark.sparkContext.defaultParallelism, "s_suppkey"), at, "s_suppkey", "body", ".txt")
    got = vault.load_objects(spark, at, "*.txt")
    return got.select(F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("bigint").alias("s_suppkey"), "length", F.sha2("payload", 256).alias("content_hash"))


@query("acq5_image_digest", """SELECT doc_id % 16 AS image_id, CAST(sum(strlen(text)) AS BIGINT) AS bytes, sha256(string_agg(text, '' ORDER BY doc_id)) AS image_hash FROM documents GROUP BY 1""")
def image_digest(spark, sf):
    c = table(spark, sf, "documents").select((F.col("doc_id") % 16).alias("image_id"), F.col("doc_id").alias("chunk_no"), F.encode("text", "UTF-8").alias("payload"))
    return acquire.image_digest(c, ["image_id"])


@query("snk1_write_artifacts", f"WITH {d.ARTIFACTS} SELECT image_id, file_type, count(*) AS n, CAST(sum(tier) AS BIGINT) AS tiers FROM artifacts GROUP BY ALL")
def write_artifacts(spark, sf):
    at = folder(spark)
    sinks.write_artifacts(d.artifacts(spark, sf), at, "bulk")
    return spark.read.parquet(f"{at}/artifacts").groupBy(F.col("image_id").cast("bigint").alias("image_id"), "file_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("tier").cast("bigint").alias("tiers"))


@query("snk3_export_profile", ORACLES["cal2_grid_search"])
def export_profile(spark, sf):
    at = folder(spark)
    calibrate.export_profile(calibrate.grid_search(rq.samples(spark, sf)), at)
    w = ["w_header_footer", "w_structural", "w_metadata", "w_entropy"]
    schema = "profile int, f1 double, brier double, " + ", ".join(f"{c} double" for c in w)
    return spark.read.schema(schema).json(at).select("profile", *[r6(c).alias(c) for c in ["f1", "brier", *w]])


@query("snk4_checkpoint_sink", "SELECT user_id AS job_id, max(event_id) AS current_lba FROM events WHERE event_id % 5 = 0 GROUP BY 1")
def checkpoint_sink(spark, sf):
    at = folder(spark)
    p = sq.feed(spark, sf).select(F.col("user_id").alias("job_id"), F.col("event_id").alias("current_lba"), F.lit(10**12).alias("end_lba"))
    sinks.checkpoint_sink(p, f"{at}/t", f"{at}/s", every_blocks=5).trigger(availableNow=True).start().awaitTermination()
    return sinks.read_latest(spark, f"{at}/t").select("job_id", "current_lba")
