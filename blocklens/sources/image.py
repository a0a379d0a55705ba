"""Raw image source (SRC-1, SRC-2): ``spark.read.format("raw_image")``.

Options: ``paths`` (comma separated), ``image_ids`` (as many, comma separated; a path names its image by default), ``block_size`` (512), ``chunk_blocks`` (128),
``partition_bytes`` (64 MiB), ``start_lba`` and ``end_lba`` (inclusive, clamped to the
medium). Every partition reads one byte range of one file; a chunk row holds up to
``chunk_blocks`` blocks and the last block of a file is padded with zeros.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "image_id string, chunk_no bigint, start_lba bigint, n bigint, payload binary"


@dataclass
class ByteRange(InputPartition):
    path: str
    image: str
    first: int
    last: int  # blocks, exclusive
    total: int


def open_medium(path: str):
    """Random-access handle on a local path or any URI Arrow knows (file, hdfs, s3, gs)."""
    if "://" in path:
        system, inner = arrow_fs.FileSystem.from_uri(path)
    else:
        system, inner = arrow_fs.LocalFileSystem(), path
    return system.open_input_file(inner)


class ImageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options["paths"].split(",") if p]
        self.ids = options["image_ids"].split(",") if options.get("image_ids") else self.paths
        if len(self.ids) != len(self.paths) or len(set(self.ids)) != len(self.ids):
            raise ValueError("image_ids must name every path once")
        self.block = int(options.get("block_size", 512))
        self.chunk = int(options.get("chunk_blocks", 128))
        self.part = int(options.get("partition_bytes", 64 << 20))
        self.start = int(options.get("start_lba", 0))
        self.end = options.get("end_lba")

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        step = max(self.part // (self.block * self.chunk), 1) * self.chunk
        for path, image in zip(self.paths, self.ids):
            with open_medium(path) as f:
                total = -(-f.size() // self.block)
            stop = total if self.end is None else min(int(self.end) + 1, total)
            # chunk borders stay multiples of the chunk size whatever the range
            first = self.start // self.chunk * self.chunk
            for at in range(first, stop, step):
                out.append(ByteRange(path, image, max(at, self.start), min(at + step, stop), total))
        return out

    def read(self, partition: ByteRange) -> Iterator[tuple]:
        with open_medium(partition.path) as f:
            at = partition.first
            while at < partition.last:
                upto = min((at // self.chunk + 1) * self.chunk, partition.last)
                f.seek(at * self.block)
                data = f.read((upto - at) * self.block)
                yield partition.image, at // self.chunk, at, upto - at, data.ljust((upto - at) * self.block, b"\0")
                at = upto


class RawImage(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raw_image"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ImageReader(self.options)


def read_image(spark: SparkSession, paths: list[str], block_size: int = 512, **options) -> DataFrame:
    """SRC-1: chunk rows of one or more raw images; ``carve.block_heads`` or ``blocks_of`` give blocks."""
    spark.dataSource.register(RawImage)
    reader = spark.read.format("raw_image").option("paths", ",".join(paths)).option("block_size", block_size)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def read_image_range(spark: SparkSession, path: str, kind: str = "Physical", start_lba: int = 0, end_lba: int | None = None, **options) -> DataFrame:
    """SRC-2: the whole medium (Physical) or a clamped block range (Partial, Logical)."""
    if kind == "Physical":
        return read_image(spark, [path], **options)
    return read_image(spark, [path], start_lba=start_lba, end_lba=end_lba, **options)


def blocks_of(chunks: DataFrame, block_size: int = 512) -> DataFrame:
    """One row per block: image_id, lba, payload."""
    from pyspark.sql import functions as F
    at = F.posexplode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("_p", "_i")
    return chunks.where("n > 0").select("image_id", "start_lba", "payload", at).select(
        "image_id", (F.col("start_lba") + F.col("_i")).alias("lba"),
        F.substring(F.col("payload"), F.col("_i") * block_size + 1, F.lit(block_size)).alias("payload"))
