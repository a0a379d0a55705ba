"""Signature dimension (SRC-3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# fixed values: file type, header bytes, footer bytes, size limit, header offset
DEFAULT_SIGNATURES = [
    ("jpeg", "FFD8FF", "FFD9", 52428800, 0),
    ("png", "89504E470D0A1A0A", "49454E44AE426082", 52428800, 0),
    ("pdf", "255044462D", "2525454F46", 104857600, 0),
    ("zip", "504B0304", "504B0506", 104857600, 0),
    ("sqlite", "53514C69746520666F726D6174203300", None, 209715200, 0),
    ("ole2", "D0CF11E0A1B11AE1", None, 104857600, 0),
    ("mp4", "66747970", None, 1073741824, 4),
]
JSON_SCHEMA = ("file_type string, header array<int>, footer array<int>, max_size_bytes bigint, "
               "validator_id string, header_offset int")
COLUMNS = ["file_type", "header", "footer", "max_size_bytes", "validator_id", "header_offset", "sig_order"]


def signature_rows(spark: SparkSession, rows=DEFAULT_SIGNATURES) -> DataFrame:
    """Table from ``(type, header hex, footer hex, limit, offset)`` in list order."""
    data = [(t, bytes.fromhex(h), None if f is None else bytes.fromhex(f), limit, t, offset, i)
            for i, (t, h, f, limit, offset) in enumerate(rows)]
    return spark.createDataFrame(data, "file_type string, header binary, footer binary, max_size_bytes bigint, "
                                       "validator_id string, header_offset int, sig_order int")


def _bytes(numbers):
    return F.when(numbers.isNotNull(), F.unhex(F.array_join(F.transform(numbers, lambda x: F.lpad(F.hex(x), 2, "0")), "")))


def read_signatures(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """SRC-3: a JSON array of signatures (or JSON lines); a missing offset is 0, order is file order."""
    raw = spark.read.schema(JSON_SCHEMA).option("multiLine", multi_line).json(path)
    order = Window.orderBy("_id")  # a signature file is one small JSON document
    return (raw.withColumn("_id", F.monotonically_increasing_id())
            .withColumn("sig_order", F.row_number().over(order) - 1)
            .withColumn("header", _bytes(F.col("header"))).withColumn("footer", _bytes(F.col("footer")))
            .withColumn("header_offset", F.coalesce("header_offset", F.lit(0))).select(*COLUMNS))


def append_signatures(base: DataFrame, more: DataFrame) -> DataFrame:
    """Register further signatures after the existing ones."""
    top = base.agg(F.max("sig_order")).first()[0]
    shifted = more.withColumn("sig_order", (F.col("sig_order") + F.lit(-1 if top is None else top) + 1).cast("int"))
    return base.unionByName(shifted.select(*base.columns))
