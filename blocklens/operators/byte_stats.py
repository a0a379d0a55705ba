"""Byte-level analytics over a payload column (BYT-1..10, FLT-6, FLT-7).

One Arrow pass per call computes every requested statistic, so a payload crosses to
Python once. Uniformity and zero tests stay native.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blocklens.functions import payload as kern
from blocklens.functions import scoring
from blocklens.operators import ranges

PAIR_NAMES = ["sparsity", "top10_share", "transition_entropy", "mean_prob", "variance", "distinct_ratio"]


def _array(rows: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(rows, dtype=np.float64).ravel())
    return pa.ListArray.from_arrays(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32), flat)


def _each(fn) -> Callable[[list[bytes]], np.ndarray]:
    def over(ps: list[bytes]) -> np.ndarray:
        return np.array([fn(np.frombuffer(p, dtype=np.uint8)) for p in ps])
    return over


# statistic -> (Spark type, kernel over a list of payloads giving an Arrow array)
STATS: dict[str, tuple[str, Callable[[list[bytes]], pa.Array]]] = {
    "histogram": ("array<bigint>", lambda ps: pa.ListArray.from_arrays(
        np.arange(0, len(ps) * 256 + 1, 256, dtype=np.int32), pa.array(kern.histograms(ps).ravel()))),
    "entropy": ("double", lambda ps: pa.array(kern.entropy_of_counts(kern.histograms(ps)))),
    "entropy_profile": ("array<double>", lambda ps: _array(_each(kern.chunk_entropies)(ps))),
    "bigram": ("array<double>", lambda ps: _array(_each(kern.pair_stats)(ps))),
    "longest_run": ("bigint", lambda ps: pa.array(_each(kern.longest_text_run)(ps).astype(np.int64))),
    "run_ratio": ("double", lambda ps: pa.array(_each(kern.text_run_ratio)(ps).astype(np.float64))),
    "chi_square": ("double", lambda ps: pa.array(kern.chi_square_score(kern.histograms(ps)))),
    "features": ("array<double>", lambda ps: _array(kern.feature_rows(ps))),
}


def profile(objects: DataFrame, ids: Sequence[str], want: Sequence[str], payload: str = "payload") -> DataFrame:
    """``ids`` plus one column per requested statistic of the payload."""
    wanted, ids = list(want), list(ids)
    kernels = [STATS[w][1] for w in wanted]
    kept = objects.select(*ids, F.col(payload).alias("_p"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]]
                       + [f"{w} {STATS[w][0]}" for w in wanted])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ps = [p or b"" for p in batch.column(len(ids)).to_pylist()]
            cols = [batch.column(i) for i in range(len(ids))] + [k(ps) for k in kernels]
            yield pa.RecordBatch.from_arrays(cols, names=ids + wanted)

    return kept.mapInArrow(run, schema)


def byte_histogram(objects: DataFrame, ids: Sequence[str], payload: str = "payload") -> DataFrame:
    """BYT-1: one row per byte value that occurs: count and share."""
    counted = profile(objects, ids, ["histogram"], payload)
    total = F.aggregate("histogram", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return (counted.withColumn("_n", total)
            .select(*ids, "_n", F.posexplode("histogram").alias("byte_value", "n"))
            .where("n > 0").withColumn("share", F.col("n") / F.col("_n")).drop("_n"))


def shannon_entropy(objects: DataFrame, ids: Sequence[str], payload: str = "payload") -> DataFrame:
    """BYT-2."""
    return profile(objects, ids, ["entropy"], payload)


def entropy_profile(objects: DataFrame, ids: Sequence[str], payload: str = "payload") -> DataFrame:
    """BYT-3: one row per chunk."""
    return profile(objects, ids, ["entropy_profile"], payload).select(
        *ids, F.posexplode("entropy_profile").alias("chunk_no", "entropy"))


def bigram_stats(objects: DataFrame, ids: Sequence[str], payload: str = "payload") -> DataFrame:
    """BYT-4."""
    got = profile(objects, ids, ["bigram"], payload)
    return got.select(*ids, *[F.col("bigram")[i].alias(n) for i, n in enumerate(PAIR_NAMES)])


def longest_ascii_run(objects: DataFrame, ids: Sequence[str], payload: str = "payload") -> DataFrame:
    """BYT-5."""
    return profile(objects, ids, ["longest_run", "run_ratio"], payload)


def chi_square_uniformity(objects: DataFrame, ids: Sequence[str], payload: str = "payload") -> DataFrame:
    """BYT-6."""
    return profile(objects, ids, ["chi_square"], payload)


def feature_vector(objects: DataFrame, ids: Sequence[str], payload: str = "payload") -> DataFrame:
    """BYT-7: ``features`` as ARRAY<DOUBLE> of 280."""
    return profile(objects, ids, ["features"], payload)


def entropy_consistency(objects: DataFrame, ids: Sequence[str], file_type: str = "file_type",
                        payload: str = "payload") -> DataFrame:
    """BYT-8: banded plausibility of the entropy for the claimed type."""
    keep = list(dict.fromkeys([*ids, file_type]))
    got = profile(objects.withColumn("_empty", F.octet_length(payload) == 0), [*keep, "_empty"], ["entropy"], payload)
    return got.withColumn("consistency", scoring.entropy_consistency(
        F.col("entropy"), F.col(file_type), F.col("_empty"))).drop("_empty")


def payload_hash(objects: DataFrame, ids: Sequence[str], payload: str = "payload") -> DataFrame:
    """BYT-9."""
    return objects.select(*ids, F.sha2(payload, 256).alias("content_hash"))


def is_zero(payload: str | Column = "payload") -> Column:
    """FLT-6 predicate."""
    p = F.col(payload) if isinstance(payload, str) else payload
    return F.hex(p) == F.repeat(F.lit("00"), F.octet_length(p))


def is_uniform(payload: str | Column = "payload") -> Column:
    """FLT-7 predicate: every byte equals the first."""
    p = F.col(payload) if isinstance(payload, str) else payload
    h = F.hex(p)
    return h == F.repeat(F.substring(h, 1, 2), F.octet_length(p))


def block_summary(sectors: DataFrame, extents: DataFrame, keys: Sequence[str], payload: str = "payload") -> DataFrame:
    """BYT-10: content class, entropy and strongest extent status of every block.

    ``extents`` carries ``kind`` in allocated / artifact / bad_sector.
    """
    classed = sectors.withColumn("content", F.when(is_zero(payload), "zero")
                                 .when(is_uniform(payload), "uniform").otherwise("mixed"))
    stats = profile(classed, [*keys, "lba", "content"], ["entropy"], payload)
    out = stats
    for kind in ("bad_sector", "artifact", "allocated"):
        hit = ranges.points_in_ranges(
            stats.select(*keys, "lba"), extents.where(F.col("kind") == kind).select(*keys, "start_lba", "block_count"),
            keys, "left_semi").withColumn(f"_{kind}", F.lit(True))
        out = out.join(hit, [*keys, "lba"], "left")
    status = (F.when(F.col("_bad_sector"), "bad_sector").when(F.col("_artifact"), "artifact")
              .when(F.col("_allocated"), "allocated").otherwise("unallocated"))
    return out.withColumn("status", status).drop("_bad_sector", "_artifact", "_allocated")
