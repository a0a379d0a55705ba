"""Corpus pipeline: quality rules, line dedup, near-duplicate removal, source mixing and tokenising, stage by stage.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each result as Parquet in the shared folder and hands
the reread table to the next stage. All but the last return the columns of ``documents``.

Defined results: null texts count as empty and fail the quality rules; an empty table passes through as an empty table; a document whose lines all
repeat others' stays as an empty text, and of empty texts one stays as a near copy; documents that the mix takes several times
appear as several equal rows and are tokenised each.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blocklens.llm import bpe, lines, mixing, nearcopies, quality
from blocklens.session import DEFAULTS, checkpoint_root, ship_package

#: rows and bytes of a batch handed to Python: texts may be long, and an executor holds several batches per core at once
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": DEFAULTS["spark.sql.execution.arrow.maxRecordsPerBatch"],
            "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def _ready(spark: SparkSession) -> None:
    for key, value in _BATCHES.items():
        spark.conf.set(key, value)
    ship_package(spark)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents inside the fences of their language and source; rejected ones go."""
    _ready(spark)
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later occurrences of repeated multi-line chunks; ``n_chars`` follows."""
    _ready(spark)
    return lines.remove_chunks(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group linked by five-word similarities of 0.8 or more; SimHash components and MinHash bands find the pairs."""
    _ready(spark)
    return nearcopies.drop_near_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    _ready(spark)
    return mixing.mix(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit numbers) and the digest of the decoded text, one row per row of the mix."""
    _ready(spark)
    decoded = bpe.decode(bpe.encode(docs))
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("source_mix", source_mix), ("tokenise", tokenise)]

#: SQL can express neither the fingerprints nor the tokens; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{checkpoint_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}-{name}")
        docs = spark.read.parquet(f"{root}/{k}-{name}")
    return docs
