"""Driver tables seen as evidence tables: a Spark view and the same view as a SQL CTE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blocklens.plans.catalog import table

TS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
TS_SQL = "'%Y-%m-%dT%H:%M:%S.%f'"


def k_of(props: str = "props"):
    return F.from_json(props, "k bigint")["k"]


K_SQL = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"


# ---- vault -------------------------------------------------------------------------
def cases(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").selectExpr(
        "c_custkey AS case_id", "c_name AS case_name", "concat('inv-', c_nationkey) AS investigator_id",
        "c_custkey * 3600 AS created_at",
        "CASE WHEN c_mktsegment = 'BUILDING' THEN 'Closed' ELSE 'Active' END AS status")


CASES = """cases AS (SELECT c_custkey AS case_id, c_name AS case_name, 'inv-' || c_nationkey AS investigator_id,
 c_custkey * 3600 AS created_at, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Closed' ELSE 'Active' END AS status FROM customer)"""

MEDIA = ["Hdd", "SataSsd", "Nvme", "Sed", "Usb", "SdCard", "ForensicImage"]


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    media = F.element_at(F.array(*[F.lit(m) for m in MEDIA]), (F.col("p_partkey") % 7 + 1).cast("int"))
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("evidence_id"), F.floor(F.col("p_partkey") / 2).cast("bigint").alias("case_id"),
        F.concat(F.lit(" sn-"), F.col("p_partkey").cast("string"), F.lit(" ")).alias("serial"),
        F.col("p_brand").alias("vendor"), F.col("p_name").alias("model"),
        (F.col("p_size").cast("bigint") * 1000000000).alias("capacity_bytes"), media.alias("media_type"),
        F.col("p_type").alias("interface"))


_MEDIA_SQL = "CASE p_partkey % 7 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MEDIA)) + " END"
EVIDENCE = f"""evidence AS (SELECT p_partkey AS evidence_id, p_partkey // 2 AS case_id, ' sn-' || p_partkey || ' ' AS serial,
 p_brand AS vendor, p_name AS model, CAST(p_size AS BIGINT) * 1000000000 AS capacity_bytes, {_MEDIA_SQL} AS media_type,
 p_type AS interface FROM part)"""

OP_TYPES = ["Acquire", "Recover", "Sanitize", "Verify", "Analyze"]


def operations(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(m) for m in OP_TYPES]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    status = (F.when(F.col("o_orderstatus") == "P", "Paused").when(F.col("o_orderstatus") == "F", "Failed")
              .otherwise("Completed"))
    blocks = F.floor(F.col("o_totalprice")).cast("bigint")
    params = F.when(F.col("o_orderkey") % 10 != 5, F.concat(
        F.lit('{"current_lba": '), F.floor(blocks / 3).cast("string"), F.lit(', "total_blocks": '),
        blocks.cast("string"), F.lit(', "source_fingerprint": "FP'), (F.col("o_orderkey") % 97).cast("string"),
        F.lit('"}'))).otherwise("not json")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("op_id"), F.col("o_custkey").alias("case_id"), kind.alias("op_type"),
        F.col("o_orderdate").alias("started_at"), status.alias("status"), params.alias("parameters_json"),
        blocks.alias("blocks"))


OPERATIONS = ("operations AS (SELECT o_orderkey AS op_id, o_custkey AS case_id, CASE o_orderkey % 5 "
              + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(OP_TYPES))
              + """ END AS op_type, o_orderdate AS started_at,
 CASE o_orderstatus WHEN 'P' THEN 'Paused' WHEN 'F' THEN 'Failed' ELSE 'Completed' END AS status,
 CAST(floor(o_totalprice) AS BIGINT) AS blocks, CAST(floor(o_totalprice) AS BIGINT)//3 AS current_lba,
 o_orderkey % 10 <> 5 AS parsable, 'FP' || (o_orderkey % 97) AS fp FROM orders)""")

TYPES = ["jpeg", "png", "pdf", "zip", "sqlite", "ole2", "mp4"]


def artifacts(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(m) for m in TYPES]), (F.col("l_partkey") % 7 + 1).cast("int"))
    li = table(spark, sf, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("artifact_id"), F.col("l_orderkey").alias("op_id"),
        kind.alias("file_type"), (F.col("l_linenumber") % 3 + 1).alias("tier"),
        F.floor(F.col("l_extendedprice")).cast("bigint").alias("recovered_bytes"),
        (F.col("l_quantity") / 50).alias("confidence_score"),
        F.when(F.col("l_returnflag") == "R", "Truncated candidate").alias("limitations"),
        F.col("l_suppkey").alias("image_id"), (F.col("l_partkey") * 16).alias("start_lba"),
        F.col("l_quantity").cast("bigint").alias("block_count"))


ARTIFACTS = ("artifacts AS (SELECT l_orderkey * 8 + l_linenumber AS artifact_id, l_orderkey AS op_id, CASE l_partkey % 7 "
             + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(TYPES))
             + """ END AS file_type, l_linenumber % 3 + 1 AS tier, CAST(floor(l_extendedprice) AS BIGINT) AS recovered_bytes,
 l_quantity / 50 AS confidence_score, CASE WHEN l_returnflag = 'R' THEN 'Truncated candidate' END AS limitations,
 l_suppkey AS image_id, l_partkey * 16 AS start_lba, CAST(l_quantity AS BIGINT) AS block_count FROM lineitem)""")


def images(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("image_id"), (F.col("s_suppkey") * 20).alias("evidence_id"),
        F.concat(F.lit("/vault/"), "s_name", F.lit(".dd")).alias("file_path"),
        F.sha2("s_name", 256).alias("acquisition_hash"),
        F.when(F.col("s_suppkey") % 4 == 0, F.upper(F.sha2("s_name", 256)))
        .when(F.col("s_suppkey") % 4 == 1, F.sha2(F.concat("s_name", F.lit("x")), 256))
        .when(F.col("s_suppkey") % 4 == 2, F.sha2("s_name", 256)).alias("verification_hash"),
        (F.col("s_nationkey") * 86400 + F.col("s_suppkey")).cast("bigint").alias("acquired_at"))


IMAGES = """images AS (SELECT s_suppkey AS image_id, s_suppkey * 20 AS evidence_id, '/vault/' || s_name || '.dd' AS file_path,
 sha256(s_name) AS acquisition_hash, CASE s_suppkey % 4 WHEN 0 THEN upper(sha256(s_name)) WHEN 1 THEN sha256(s_name || 'x')
 WHEN 2 THEN sha256(s_name) END AS verification_hash, CAST(s_nationkey * 86400 + s_suppkey AS BIGINT) AS acquired_at FROM supplier)"""

# ---- ledgers -----------------------------------------------------------------------
CUSTODY_TYPE = {"signup": "Received", "view": "StorageChange", "click": "AnalysisStarted",
                "error": "Transferred", "purchase": "Returned"}


def custody(spark: SparkSession, sf: str) -> DataFrame:
    kind = None
    for e, c in CUSTODY_TYPE.items():
        kind = F.when(F.col("event_type") == e, c) if kind is None else kind.when(F.col("event_type") == e, c)
    k = k_of()
    return table(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("evidence_id"), kind.alias("event_type"), "ts",
        F.when(k % 3 != 0, F.concat(F.lit("party-"), (k % 7).cast("string"))).alias("from_party"),
        F.when(k % 5 != 0, F.concat(F.lit("party-"), (k % 11).cast("string"))).alias("to_party"),
        F.when(k % 2 == 0, F.concat(F.lit("locker-"), (k % 13).cast("string"))).alias("location"))


CUSTODY = (f"""custody AS (SELECT event_id, user_id AS evidence_id, CASE event_type """
           + " ".join(f"WHEN '{e}' THEN '{c}'" for e, c in CUSTODY_TYPE.items())
           + f""" END AS event_type, ts, CASE WHEN k % 3 <> 0 THEN 'party-' || (k % 7) END AS from_party,
 CASE WHEN k % 5 <> 0 THEN 'party-' || (k % 11) END AS to_party, CASE WHEN k % 2 = 0 THEN 'locker-' || (k % 13) END AS location
 FROM (SELECT *, {K_SQL} AS k FROM events))""")


# ---- devices -----------------------------------------------------------------------
def telemetry(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry_of(table(spark, sf, "events"))


def telemetry_of(events: DataFrame) -> DataFrame:
    """Readings of a device (= user): counters come from the value and the JSON property."""
    k = k_of()
    v = F.floor("value").cast("bigint")
    return events.select(
        "event_id", F.col("user_id").alias("device_id"), "ts",
        F.when(F.col("user_id") % 3 == 0, "nvme").when(F.col("user_id") % 3 == 1, "hdd").otherwise("none").alias("kind"),
        F.when(k == 99, 1).otherwise(0).alias("critical_warnings"), (100 - k).alias("spare_percent"),
        k.alias("percentage_used"), F.floor(v / 40).alias("media_errors"), (30 + v % 50).alias("temperature"),
        F.floor(v / 150).alias("uncorrectable"), F.floor(k / 16).alias("pending"), F.floor(v / 3).alias("reallocated"))


TELEMETRY = f"""telemetry AS (SELECT event_id, user_id AS device_id, ts,
 CASE user_id % 3 WHEN 0 THEN 'nvme' WHEN 1 THEN 'hdd' ELSE 'none' END AS kind, CASE WHEN k = 99 THEN 1 ELSE 0 END AS critical_warnings,
 100 - k AS spare_percent, k AS percentage_used, v // 40 AS media_errors, 30 + v % 50 AS temperature, v // 150 AS uncorrectable,
 k // 16 AS pending, v // 3 AS reallocated FROM (SELECT *, {K_SQL} AS k, CAST(floor(value) AS BIGINT) AS v FROM events))"""
HEALTH = """CASE kind WHEN 'nvme' THEN CASE WHEN critical_warnings<>0 OR spare_percent<10 OR media_errors>10 THEN 'Critical'
  WHEN spare_percent<20 OR percentage_used>=95 OR media_errors>0 OR temperature>=70 THEN 'Warning' ELSE 'Good' END
 WHEN 'hdd' THEN CASE WHEN uncorrectable>0 OR pending>5 OR reallocated>50 THEN 'Critical'
  WHEN pending>0 OR reallocated>0 OR temperature>=55 THEN 'Warning' ELSE 'Good' END ELSE 'Unknown' END"""


# ---- ranges ------------------------------------------------------------------------
def bad_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct order keys as unreadable blocks of one of 16 images: dense and broken runs."""
    return (table(spark, sf, "lineitem")
            .select((F.col("l_suppkey") % 16).alias("image_id"), F.col("l_orderkey").alias("lba"))
            .groupBy("image_id", "lba").agg(F.lit(1).alias("one")).drop("one")
            .withColumn("error", F.concat(F.lit("read error "), (F.col("lba") % 3).cast("string"))))


BAD = """bad AS (SELECT image_id, lba, 'read error ' || (lba % 3) AS error FROM
 (SELECT DISTINCT l_suppkey % 16 AS image_id, l_orderkey AS lba FROM lineitem))"""


def extents(spark: SparkSession, sf: str) -> DataFrame:
    """Disjoint allocated extents: up to seven blocks from ten times the order key on."""
    return table(spark, sf, "orders").select(
        (F.col("o_custkey") % 16).alias("image_id"), (F.col("o_orderkey") * 10).alias("start_lba"),
        (F.lit(1) + F.floor(F.col("o_totalprice")).cast("bigint") % 7).alias("block_count"))


EXTENTS = """extents AS (SELECT o_custkey % 16 AS image_id, o_orderkey * 10 AS start_lba,
 1 + CAST(floor(o_totalprice) AS BIGINT) % 7 AS block_count FROM orders)"""


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Every (order, line) position as a block to be tested."""
    return (table(spark, sf, "lineitem")
            .select((F.col("l_partkey") % 16).alias("image_id"),
                    (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("lba"))
            .groupBy("image_id", "lba").agg(F.count(F.lit(1)).alias("hits")))


BLOCKS = """blocks AS (SELECT l_partkey % 16 AS image_id, l_orderkey * 10 + l_linenumber AS lba, count(*) AS hits
 FROM lineitem GROUP BY ALL)"""


def spans(spark: SparkSession, sf: str) -> DataFrame:
    """Extents of recovered objects, overlapping each other and the allocated ones."""
    return table(spark, sf, "lineitem").select(
        (F.col("l_partkey") % 16).alias("image_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("start_lba"),
        F.col("l_quantity").cast("bigint").alias("block_count"), (F.col("l_orderkey") % 3).alias("kind_no"))


SPANS = """spans AS (SELECT l_partkey % 16 AS image_id, l_orderkey * 10 + l_linenumber AS start_lba,
 CAST(l_quantity AS BIGINT) AS block_count, l_orderkey % 3 AS kind_no FROM lineitem)"""
