"""SimHash near-duplicates through the binary Golay code.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. Two fingerprints at three or fewer differing bits differ in at
most one bit on at least two of the segments (pigeonhole), so the joins run on pairs of segments. A segment, filled up to the 23 bits
of the perfect Golay code, decodes to the index of the codeword within three bits. One side of the join brings the index
of its segment, the other the indices of its segment with any one bit flipped: one key if the segment lies within two
bits of its codeword, else up to six. Equal keys are candidates, and the differing bits are counted before a pair becomes a link.

Copies never meet: equal fingerprints are one row with their smallest doc_id, and links between fingerprints become components.

Defined results: a null or wordless text has fingerprint zero and is linked like any other; texts of fewer words than a shingle
are one shingle; null ids count last; repeated rows are fingerprinted one by one and share their component; an empty table gives
an empty result; other columns are not looked at.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blocklens.llm.common import query, table
from blocklens.llm.graphs import components
from blocklens.session import cut_lineage

SHINGLE = 3
BITS = 3
SEED = 42
#: lowest bit and width of the segments
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: fixed value: generator polynomial of the binary Golay code of length 23
GENERATOR = 0xC75


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    words = raw.lower().split()
    if not words:
        return 0
    norm = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(norm, SEED)], np.uint64)
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size + 1) - 1
        begins = ends - size
        h = xxhash.xxh64_intdigest
        hashes = np.fromiter((h(norm[a:b], SEED) for a, b in zip(begins[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist())), np.uint64, len(words) - shingle + 1)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """Fingerprint of hashes: bit k is set if it is in over half of them."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255
    count = bits[whole:].sum(axis=0, dtype=np.int64)
    if whole:  # sums of 255 rows fit a byte
        count += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (as a signed long); one pass over the whole texts."""
    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = np.array([fingerprint(texts[i].as_py() or b"", shingle) for i in range(batch.num_rows)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fingerprint"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint long")


class Golay:
    """Decoder of the [23, 12] code: index of the nearest codeword, for arrays of 23-bit vectors."""

    def __init__(self):
        def remainder(v):
            for k in range(22, 10, -1):
                if v >> k & 1:
                    v ^= GENERATOR << (k - 11)
            return v
        self.high = np.array([remainder(h << 11) for h in range(1 << 12)], np.uint32)
        self.leader = np.zeros(1 << 11, np.uint32)
        for weight in (1, 2, 3):
            for at in combinations(range(23), weight):
                e = sum(1 << k for k in at)
                self.leader[remainder(e)] = e

    def decode(self, v: np.ndarray) -> np.ndarray:
        v = v.astype(np.uint32)
        return (v ^ self.leader[self.high[v >> 11] ^ (v & 0x7FF)]) >> 11

    def near(self, v: np.ndarray, width: int) -> np.ndarray:
        """Indices of each vector with no bit or one of its ``width`` bits flipped, repeats as -1: one row per vector."""
        flips = np.concatenate([[0], 1 << np.arange(width)]).astype(np.uint32)
        found = np.sort(self.decode(v.astype(np.uint32)[:, None] ^ flips).astype(np.int64), axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        return found


def _segments(f: np.ndarray) -> list[np.ndarray]:
    return [((f >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.uint32) for low, width in SEGMENTS]


def _keys(wide: bool):
    """Rows (key, fingerprint): three of each fingerprint, or with ``wide`` those of its neighbourhood."""
    def run(batches):
        golay = Golay()
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                f = np.asarray(batch.column(0))[at:at + 2048].view(np.uint64)
                cut = _segments(f)
                keys, prints = [], []
                for n, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
                    if wide:
                        x, y = golay.near(cut[a], SEGMENTS[a][1]), golay.near(cut[b], SEGMENTS[b][1])
                        row, col = np.nonzero(x >= 0)
                        left = x[row, col]
                        again, other = np.nonzero(y[row] >= 0)
                        keys.append(n << 24 | left[again] << 12 | y[row[again], other])
                        prints.append(f[row[again]])
                    else:
                        keys.append(n << 24 | golay.decode(cut[a]).astype(np.int64) << 12 | golay.decode(cut[b]).astype(np.int64))
                        prints.append(f)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype(np.int32)), pa.array(np.concatenate(prints).view(np.int64))], names=["key", "fingerprint"])
    return run


def links(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """Pairs (a, b) of different fingerprints at ``bits`` (3 at most) or fewer differing bits; ``prints`` has each fingerprint once."""
    if bits > 3:
        raise ValueError("the segments find pairs at three or fewer differing bits")
    own = prints.mapInArrow(_keys(False), "key int, fingerprint long").withColumnRenamed("fingerprint", "a")
    near = prints.mapInArrow(_keys(True), "key int, fingerprint long").withColumnRenamed("fingerprint", "b")
    # about a hundred keys of a fingerprint are hidden from Spark's size estimates, which would broadcast them: only a merge join holds at any size
    near = near.hint("merge")
    # a link is found from either side; the order keeps one
    return own.join(near, (own["key"] == near["key"]) & (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)).select("a", "b").distinct()


def group(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint, component_id: one row per document."""
    found = cut_lineage(fingerprints(docs, shingle))
    classes = cut_lineage(found.groupBy("fingerprint").agg(F.min("doc_id").alias("first")))
    roots = components(links(classes.select("fingerprint"), bits))
    named = classes.join(roots, classes["fingerprint"] == roots["node"], "left").select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    first = named.groupBy("root").agg(F.min("first").alias("component_id"))
    label = cut_lineage(named.join(first, "root").select("fingerprint", "component_id"))
    return found.join(label, "fingerprint").select("doc_id", "fingerprint", "component_id")


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """One document of each group, that with the smallest doc_id, with all its columns; rows repeating it (id and text) go too."""
    stays = group(docs, shingle, bits).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("id_s")).distinct()
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row_"), docs["doc_id"].alias("id_"), F.xxhash64(docs["text"]).alias("hash_"))
    return rows.join(stays, F.col("id_").eqNullSafe(F.col("id_s")), "left_semi").dropDuplicates(["id_", "hash_"]).select(*[F.col(f"row_.`{c}`").alias(c) for c in docs.columns])


@query("op6_simhash")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
