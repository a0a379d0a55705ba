"""Substring deduplication with fixed-block anchors.

A window of 50 words contains a whole aligned block of 25 words of its own document. So the aligned blocks of all documents are the index,
and every document probes it with all its rolling 25-word windows. Hashes travel packed by bucket; a bucket keeps its block hashes and
one document per hash, and hits are the probes of a hash that more than one document probes.

Hits are extended to maximal exact repeats by contexts: the up to 25 words on either side, which hold every 50-word window
through the anchor. Documents with the same anchor and context share all those windows, so of each context only the smallest doc_id
goes on. Where one anchor has different contexts, these documents' windows are compared one by one. Contexts and windows are compared by
two 64-bit hashes.

Nothing is paired: copies of a passage meet in sums and minima, whatever their number, and texts move once.

Defined results: a null text has no words; rows without a doc_id are never compared and keep all their words; rows that repeat a doc_id are
not compared with each other; texts shorter than a window keep all; an empty table gives an empty result; other columns are not
looked at. Kept words are joined by one space.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blocklens.llm.common import partitions, query, table
from blocklens.llm.hashing import Texts
from blocklens.session import cut_lineage

WINDOW = 50
BLOCK = 25
CHUNK_BYTES = 3 << 20
#: buckets per shuffle partition, so that partitions come out even
SPREAD = 4


def _chunks(batches, columns: int, limit: int = CHUNK_BYTES):
    """Rows (doc_id, text as bytes, ...) in lists of bounded text."""
    rows, held = [], 0
    for batch in batches:
        columns_ = [batch.column(k) for k in range(columns)]
        texts = columns_[1].cast(pa.binary())
        ids = columns_[0].to_pylist()
        for i in range(batch.num_rows):
            raw = texts[i].as_py() or b""
            rows.append((ids[i], raw, *[columns_[k][i].as_py() for k in range(2, columns)]))
            held += len(raw)
            if held >= limit:
                yield rows
                rows, held = [], 0
    if rows:
        yield rows


def _name(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 bits of a hash as one number: what anchors are called."""
    return ((hashes >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | hashes & np.uint64(0xFFFFFFFF)


def _rolling(t: Texts, k: int, length: int) -> np.ndarray:
    """First words of all windows of text ``k``."""
    return np.arange(t.first[k], max(t.first[k], t.first[k + 1] - length + 1))


def _planes(values: np.ndarray) -> bytes:
    """Numbers byte by byte, which leaves long runs to the shuffle's compression."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def _unplanes(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


PACKED = "bucket int, kind int, docs binary, counts binary, hashes binary"


def _anchors(buckets: int):
    """Rows per chunk and bucket: kind 0 the block hashes, kind 1 the window hashes by document."""
    def run(batches):
        for rows in _chunks(batches, 2):
            t = Texts([r[1] for r in rows])
            ids = np.array([r[0] for r in rows], np.int64)
            at = [_rolling(t, k, BLOCK) for k in range(len(rows))]
            doc = np.repeat(np.arange(len(rows)), [len(a) for a in at])
            at = np.concatenate(at)
            if not len(at):
                continue
            name = _name(t.window(at, BLOCK), buckets)
            aligned = (at - t.first[doc]) % BLOCK == 0
            bucket, part = (name >> np.uint64(32)).astype(np.int64), (name & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            out = []
            blocks, b = part[aligned], bucket[aligned]
            order = np.argsort(b, kind="stable")
            cuts = np.flatnonzero(np.diff(b[order], prepend=-1, append=buckets))
            out += [(int(b[order[x]]), 0, b"", b"", np.unique(blocks[order[x:y]]).tobytes()) for x, y in zip(cuts, cuts[1:])]
            order = np.argsort(bucket, kind="stable")  # documents stay in order within a bucket
            bucket, part, doc = bucket[order], part[order], doc[order]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=buckets))
            for x, y in zip(cuts, cuts[1:]):
                d = doc[x:y]
                new = np.flatnonzero(np.diff(d, prepend=-1))
                out.append((int(bucket[x]), 1, _planes(ids[d[new]]), _planes(np.diff(np.append(new, y - x)).astype(np.uint32)), part[x:y].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()),
                                              *[pa.array([o[k] for o in out], pa.binary()) for k in (2, 3, 4)]], names=["bucket", "kind", "docs", "counts", "hashes"])
    return run


def _probe(batches):
    """Streams a bucket's probes past its blocks: (doc_id, anchor) for anchors probed by more than one document.

    Held: the block hashes, and for each the first document that probed it.
    """
    now, blocks, first, seen = None, [], None, None
    for batch in batches:
        for bucket, kind, docs, counts, hashes in zip(*[batch.column(k).to_pylist() for k in range(5)]):
            if bucket != now:
                now, blocks, first = bucket, [], None
            part = np.frombuffer(hashes, np.uint32)
            if kind == 0:
                blocks.append(part)
                continue
            if first is None:
                known = np.unique(np.concatenate(blocks)) if blocks else np.zeros(0, np.uint32)
                blocks, first, seen = [], np.zeros(len(known), np.int64), np.zeros(len(known), np.int8)
            if not len(known):
                continue
            slot = np.searchsorted(known, part).clip(0, len(known) - 1)
            hit = known[slot] == part
            if not hit.any():
                continue
            doc = np.repeat(_unplanes(docs, np.int64), _unplanes(counts, np.uint32))[hit]
            slot = slot[hit]
            order = np.lexsort((doc, slot))
            slot, doc = slot[order], doc[order]
            fresh = np.concatenate([[True], (slot[1:] != slot[:-1]) | (doc[1:] != doc[:-1])])
            slot, doc = slot[fresh], doc[fresh]  # one entry per anchor and document, by document within an anchor
            head = np.flatnonzero(np.diff(slot, prepend=-1))
            s, low, high = slot[head], doc[head], doc[np.append(head[1:], len(slot)) - 1]
            many = (low != high) | (seen[s] == 2) | ((seen[s] == 1) & ((first[s] != low) | (first[s] != high)))
            owed = many & (seen[s] == 1)  # the first document's hit was held back till now
            out_doc, out_slot = [first[s[owed]]], [s[owed]]
            alone = s[~many]
            first[alone], seen[alone] = low[~many], 1
            # the first document may be among those at hand; it is then sent with them or was sent before
            seen[s[many]] = 2
            sent = np.isin(slot, s[many])
            out_doc.append(doc[sent])
            out_slot.append(slot[sent])
            d, n = np.concatenate(out_doc), np.uint64(now) << np.uint64(32) | known[np.concatenate(out_slot)].astype(np.uint64)
            if len(d):
                yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(n.view(np.int64))], names=["doc_id", "anchor"])


def hits(docs: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, anchor): rolling windows that equal a block, where several documents do."""
    packed = docs.filter("doc_id is not null").mapInArrow(_anchors(buckets), PACKED)
    return packed.repartition(buckets // SPREAD, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_probe, "doc_id long, anchor long")


def _contexts_of(t: Texts, k: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of anchors at words ``p`` of text ``k``: words to the left and right, at most 25, and two hashes of it all."""
    low, high = t.first[k], t.first[k + 1]
    left, right = np.minimum(BLOCK, p - low), np.minimum(BLOCK, high - p - BLOCK)
    both = [t.window(p - left, left + BLOCK + right, h) + (left * 64 + right).astype(np.uint64) for h in (0, 1)]
    return left, right, both[0], both[1]


def _at_anchors(buckets: int):
    def run(batches):
        for rows in _chunks(batches, 3):
            t = Texts([r[1] for r in rows])
            out = []
            for k, (doc_id, _, wanted) in enumerate(rows):
                p = _rolling(t, k, BLOCK)
                if len(p) <= BLOCK:  # no whole window
                    continue
                name = _name(t.window(p, BLOCK), buckets)
                keep = np.isin(name, np.array(wanted, np.int64).view(np.uint64))
                p, name = p[keep], name[keep]
                left, right, c1, c2 = _contexts_of(t, k, p)
                whole = left + right >= BLOCK
                out.append((np.full(int(whole.sum()), doc_id), name[whole], c1[whole], c2[whole]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out]).astype(np.uint64).view(np.int64) if i else np.concatenate([o[0] for o in out]).astype(np.int64)) for i in range(4)],
                                                 names=["doc_id", "anchor", "c1", "c2"])
    return run


def _through(p: np.ndarray, left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
    """First words of all windows that hold one of the anchors at words ``p`` of a text of ``size`` words, each once."""
    edges = np.zeros(size + 1, np.int64)
    some = left + right >= BLOCK
    np.add.at(edges, p[some] - left[some], 1)
    np.add.at(edges, p[some] - (BLOCK - right[some]) + 1, -1)
    return np.flatnonzero(np.cumsum(edges[:-1]) > 0)


def _windows(batches):
    """(w1, w2, doc_id): the windows through anchors whose contexts are wanted, each window of a document once."""
    for rows in _chunks(batches, 3):
        t = Texts([r[1] for r in rows])
        out = []
        for i, (doc_id, _, wanted) in enumerate(rows):
            low, size = t.first[i], t.first[i + 1] - t.first[i]
            p = _rolling(t, i, BLOCK)
            left, right, c1, _ = _contexts_of(t, i, p)
            keep = np.isin(c1, np.array(wanted, np.int64).view(np.uint64))
            at = low + _through(p[keep] - low, left[keep], right[keep], size)
            if len(at):
                out.append((t.window(at, WINDOW, 0), t.window(at, WINDOW, 1), np.full(len(at), doc_id, np.int64)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out]).view(np.int64)) for i in range(3)], names=["w1", "w2", "doc_id"])


def cut_out(t: Texts, k: int, gone: list[dict] | None) -> np.ndarray:
    """A mask of the words of text ``k`` that stay; ``gone`` names contexts all of whose windows go (kind 0) and single windows (kind 1)."""
    low, size = t.first[k], t.first[k + 1] - t.first[k]
    if not gone:
        return np.ones(size, bool)

    def found(kind: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        pairs = {(g["a"], g["b"]) for g in gone if g["kind"] == kind}
        at = np.flatnonzero(np.isin(first, np.array([a for a, _ in pairs], np.int64).view(np.uint64)))
        ok = [j for j, a, b in zip(at.tolist(), first[at].view(np.int64).tolist(), second[at].view(np.int64).tolist()) if (a, b) in pairs]
        return np.array(ok, np.int64)
    p = _rolling(t, k, BLOCK)
    left, right, c1, c2 = _contexts_of(t, k, p)
    whole = found(0, c1, c2)
    starts = [_through(p[whole] - low, left[whole], right[whole], size)]
    every = _rolling(t, k, WINDOW)
    if len(every):
        starts.append(found(1, t.window(every, WINDOW, 0), t.window(every, WINDOW, 1)))
    edges = np.zeros(size + 1, np.int64)
    for at in starts:
        np.add.at(edges, at, 1)
        np.add.at(edges, at + WINDOW, -1)
    return np.cumsum(edges[:-1]) == 0


def _finish(batches):
    for rows in _chunks(batches, 3):
        t = Texts([r[1] for r in rows])
        out = []
        for k, (doc_id, _, gone) in enumerate(rows):
            stays = cut_out(t, k, gone)
            b, e = t.begin[t.first[k]:t.first[k + 1]][stays].tolist(), t.end[t.first[k]:t.first[k + 1]][stays].tolist()
            out.append((doc_id, len(stays), len(stays) - len(b), b" ".join([t.raw[x:y] for x, y in zip(b, e)]).decode("utf-8", "replace")))
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
                                          pa.array([o[2] for o in out], pa.int64()), pa.array([o[3] for o in out], pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the text without repeated passages): one row per document."""
    buckets = SPREAD * partitions(docs.sparkSession)
    every = docs.select("doc_id", "text")
    if dict(every.dtypes)["doc_id"] != "bigint":
        every = every.withColumn("doc_id", F.col("doc_id").cast("long"))
    # filters written out here let the steps below share one shuffle of the texts and one of the contexts
    texts = every.filter("doc_id is not null")
    known = lambda df: df.filter(" and ".join(f"{c} is not null" for c in df.columns))
    found = known(cut_lineage(hits(texts, buckets)))
    wanted = found.groupBy("doc_id").agg(F.collect_list("anchor").alias("wanted"))
    contexts = known(texts.join(wanted, "doc_id").select("doc_id", "text", "wanted").mapInArrow(_at_anchors(buckets), "doc_id long, anchor long, c1 long, c2 long"))
    least = known(contexts.groupBy("anchor", "c1", "c2").agg(F.min("doc_id").alias("m")))
    several = least.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    reps = least.join(several, "anchor").groupBy(F.col("m").alias("doc_id")).agg(F.collect_set("c1").alias("wanted"))
    windows = known(texts.join(reps, "doc_id").select("doc_id", "text", "wanted").mapInArrow(_windows, "w1 long, w2 long, doc_id long"))
    early = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("m"))
    part = windows.join(early, ["w1", "w2"]).filter("m < doc_id").select("doc_id", F.lit(1).alias("kind"), F.col("w1").alias("a"), F.col("w2").alias("b"))
    whole = contexts.join(least, ["anchor", "c1", "c2"]).filter("m < doc_id").select("doc_id", F.lit(0).alias("kind"), F.col("c1").alias("a"), F.col("c2").alias("b"))
    gone = whole.unionByName(part).groupBy("doc_id").agg(F.collect_set(F.struct("kind", "a", "b")).alias("gone"))
    met = texts.join(gone, "doc_id", "left").select("doc_id", "text", "gone")
    alone = every.filter("doc_id is null").select("doc_id", "text", F.lit(None).cast("array<struct<kind: int, a: long, b: long>>").alias("gone"))
    return met.unionByName(alone).mapInArrow(_finish, "doc_id long, n_words long, n_removed long, kept string")


@query("op3_substring_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
