"""Context-triggered piecewise hashing: fingerprints of whole texts that change only where the text does.

A rolling hash over the last ``WINDOW`` bytes decides where a chunk ends; every chunk gives one letter from the hash of its bytes. The block
size, the mean length of a chunk, is the smallest ``LEAST * 2 ** k`` at which a text has at most ``PIECES`` of them on average; a second
signature at twice that size makes texts of neighbouring sizes comparable. No chunk but the last is shorter than a quarter of the
block size and none is longer than four times it, so a signature has at most four times ``PIECES`` letters and one, and a text that repeats
one phrase has more than one letter. No part of a text is left out.

Two fingerprints are compared at a block size both have: one less the edit distance of the signatures as a share of the longer one, the
better of two if both sizes match. Signatures must share a run of four letters, of three if one has fewer than 16, which unrelated ones do
once in some thousand cases; without one, and without a common block size, the likeness is 0. Signatures of one or two letters need none.

Each document is also set beside its successor in descending order of doc_id. One range partitioning brings neighbours together, texts
move once, and a task compares while it reads; only the two border rows of each partition are kept and paired afterwards.

Defined results: a null text is empty; an empty text has block size ``LEAST`` and empty signatures and is like itself (1) and like nothing else (0); null
ids come after all others; rows of one doc_id follow each other in order of their texts' hashes, and rows equal in both are alike; a
single row is its own successor; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import string
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blocklens.llm.common import partitions, query, table
from blocklens.session import cut_lineage

WINDOW = 7
LEAST = 3
PIECES = 64
#: letters of a run that signatures must share: long ones, and those of fewer than ``SHORT`` letters
RUN, SHORT_RUN, SHORT = 4, 3, 16
#: share of a text's code points that the edit replaces: one in ``EDIT``
EDIT = 3
LETTERS = string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/"
_BASE = 0x9E3779B1
_POWERS = [np.uint32(pow(_BASE, k, 1 << 32)) for k in range(WINDOW)]


def block_size(n: int) -> int:
    """The block size of a text of ``n`` bytes."""
    b = LEAST
    while n > PIECES * b:
        b *= 2
    return b


def rolling(data: bytes) -> np.ndarray:
    """At every byte a hash of the window that ends there."""
    a = np.frombuffer(data, np.uint8).astype(np.uint32) + np.uint32(1)
    h = a * _POWERS[0]
    for k in range(1, WINDOW):
        h[k:] += a[:-k] * _POWERS[k]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(16))


def ends(h: np.ndarray, block: int) -> list[int]:
    """Where chunks end: behind bytes whose hash is in the lowest of ``block`` parts, a quarter to four times ``block`` behind the last end."""
    marks = np.append(np.flatnonzero(h < np.uint32((1 << 32) // block)) + 1, len(h))
    out, at, least, most = [], 0, max(block // 4, 1), 4 * block
    while at < len(h):
        at = min(int(marks[min(np.searchsorted(marks, at + least), len(marks) - 1)]), at + most)
        out.append(at)
    return out


def signature(data: bytes, h: np.ndarray, block: int) -> str:
    cuts = ends(h, block)
    return "".join(LETTERS[zlib.crc32(data[a:b]) >> 26] for a, b in zip([0, *cuts], cuts))


def fingerprint(data: bytes) -> str:
    """``block size:signature:signature at twice the size`` of the bytes of a text."""
    block, h = block_size(len(data)), rolling(data)
    return f"{block}:{signature(data, h, block)}:{signature(data, h, 2 * block)}"


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as many code points from the head of the following one."""
    n = len(text) // EDIT
    return text[:len(text) - n] + following[:n]


def _row(row: tuple, after: tuple) -> tuple:
    doc_id, text, own = row
    new = edited(text, after[1]).encode()
    return doc_id, len(text), hashlib.sha256(new).hexdigest(), own, fingerprint(new), after[2]


_DONE = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string"
#: a partition's border rows: its first and last row with their texts, for the pairing of partitions
_BORDER = "border string, hash long, text string"
_NAMES = [c.split()[0] for c in f"{_DONE}, {_BORDER}".split(", ")]
_SCHEMA = pa.schema([(c.split()[0], pa.int64() if c.split()[1] == "long" else pa.string()) for c in f"{_DONE}, {_BORDER}".split(", ")])


def _walk(batches):
    """Rows of a sorted partition, each with its successor; the first and the last also as border rows, the last without its result."""
    held, first = None, True
    for batch in batches:
        out = []
        for doc_id, digest, text in zip(*(c.to_pylist() for c in batch.columns)):
            row = (doc_id, text, fingerprint(text.encode()))
            if first:
                out.append((doc_id, None, None, row[2], None, None, "first", digest, text))
                first = False
            else:
                out.append((*_row(held[0], row), None, None, None))
            held = (row, digest)
        yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, r)) for r in out], schema=_SCHEMA)
    if held is not None:
        (doc_id, text, own), digest = held
        yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, (doc_id, None, None, own, None, None, "last", digest, text)))], schema=_SCHEMA)


def _pair(batches):
    for batch in batches:
        out = [dict(zip(_NAMES, _row((d, t, f), (None, t2, f2)))) for d, t, f, t2, f2 in zip(*(c.to_pylist() for c in batch.columns))]
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema(list(_SCHEMA)[:6]))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256 and the fingerprints of the text, of its edited text and of the next document."""
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("hash")]
    n = partitions(docs.sparkSession)
    walked = cut_lineage(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_walk, f"{_DONE}, {_BORDER}"))
    border = walked.filter("border is not null").select("doc_id", "hash", "border", "fingerprint")
    # two narrow rows per partition: each last row is followed by the first row of the partition behind, the very last by the very first
    along = Window.orderBy(*order, F.col("border") == "last")
    ring = Window.orderBy(*order, F.col("border") == "last").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    key = F.struct("doc_id", "hash")
    after = F.coalesce(F.lead(key).over(along), F.first(key).over(ring))
    pairs = border.select("*", after.alias("next")).filter("border = 'last'").select(F.col("doc_id").alias("id_a"), F.col("hash").alias("hash_a"), F.col("next.doc_id").alias("id_b"), F.col("next.hash").alias("hash_b"))
    texts = walked.filter("border is not null").select("doc_id", "hash", "border", "fingerprint", "text")
    a, b = texts.filter("border = 'last'").alias("a"), texts.filter("border = 'first'").dropDuplicates(["doc_id", "hash"]).alias("b")
    met = (a.join(pairs.distinct(), F.col("a.doc_id").eqNullSafe(F.col("id_a")) & (F.col("a.hash") == F.col("hash_a")))
           .join(b, F.col("b.doc_id").eqNullSafe(F.col("id_b")) & (F.col("b.hash") == F.col("hash_b")))
           .select("a.doc_id", "a.text", "a.fingerprint", F.col("b.text").alias("text_b"), F.col("b.fingerprint").alias("fingerprint_b")))
    return walked.filter("border is null").select(*_NAMES[:6]).unionByName(met.mapInArrow(_pair, _DONE))


def _similar(x: Column, y: Column) -> Column:
    """1 less the edit distance over the longer signature; 0 without a common run."""
    longer, shorter = F.greatest(F.length(x), F.length(y)), F.least(F.length(x), F.length(y))
    run = F.when(shorter < SHORT, SHORT_RUN).otherwise(RUN)
    runs = lambda s: F.transform(F.sequence(F.lit(1), F.length(s) - run + 1), lambda k: F.substring(s, k, run))
    share = 1 - F.levenshtein(x, y) / longer
    return F.when(x == y, 1.0).when(shorter == 0, 0.0).when(shorter < SHORT_RUN, share).when(F.arrays_overlap(runs(x), runs(y)), share).otherwise(0.0)


def likeness(x: str, y: str) -> Column:
    """Likeness of two columns of fingerprints, 0 to 1."""
    part = lambda c, k: F.split(F.col(c), ":")[k]
    bx, by = part(x, 0).cast("long"), part(y, 0).cast("long")
    return (F.when(F.col(x) == F.col(y), 1.0)
            .when(bx == by, F.greatest(_similar(part(x, 1), part(y, 1)), _similar(part(x, 2), part(y, 2))))
            .when(bx == 2 * by, _similar(part(x, 1), part(y, 2)))
            .when(by == 2 * bx, _similar(part(x, 2), part(y, 1))).otherwise(0.0).cast("double"))


@query("op12_fingerprints")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                        likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"))
