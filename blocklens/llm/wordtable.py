"""Meeting a table of distinct words without moving every word.

The occurrences of a corpus outnumber its distinct words many times over, so a join of occurrences with a word table would shuffle the
corpus as rows. Here each task cuts its documents into chunks of bounded text and sends only the chunk's distinct words, packed
by bucket of the word's hash. A bucket holds all copies of its words, settles each distinct word once, and answers in the order
asked. Positions travel apart, as variable-length numbers into the chunk's word list, and meet the answers at the chunk.

Buckets follow ``spark.sql.shuffle.partitions``: a bucket holds its share of the distinct words, whatever the frequency of one word,
because a chunk sends a word once. A chunk is named by a digest of its rows, so both passes must read the same rows in the
same order, as scans of files do; otherwise the answers are missing and the query fails instead of giving wrong rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

CHUNK_BYTES = 12 << 20
#: bytes of output per batch
OUT_BYTES = 4 << 20


class Index(dict):
    """Numbers words in order of first sight."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


class Chunk:
    """Documents of bounded text: ids, flags, word numbers, and the distinct words by number."""

    def __init__(self):
        self.ids, self.flags, self.codes, self.index, self.bytes = [], [], [], Index(), 0
        self.digest = hashlib.blake2b(digest_size=16)

    def add(self, doc_id, flag, raw: bytes, words: list[bytes]) -> None:
        self.ids.append(doc_id)
        self.flags.append(flag)
        self.codes.append(np.fromiter(map(self.index.__getitem__, words), np.uint32, len(words)))
        self.digest.update(f"{doc_id},{len(raw)};".encode())
        self.digest.update(raw)
        self.bytes += len(raw)

    def key(self) -> bytes:
        return self.digest.digest()


def chunks(batches: Iterator[pa.RecordBatch], words_of: Callable[[bytes], list[bytes]], limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Columns: doc_id, text, flag. A chunk closes at ``limit`` bytes of text; a longer document is a chunk with those before it."""
    chunk = Chunk()
    for batch in batches:
        ids, texts, flags = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2).to_pylist()
        for i, doc_id in enumerate(ids):
            raw = texts[i].as_py() or b""
            chunk.add(doc_id, flags[i], raw, words_of(raw))
            if chunk.bytes >= limit:
                yield chunk
                chunk = Chunk()
    if chunk.ids:
        yield chunk


def buckets_of(words: list[bytes], n: int) -> np.ndarray:
    return (np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) % np.uint64(n)).astype(np.uint32)


def sizes_of(values: np.ndarray) -> np.ndarray:
    """Bytes of each number as ``pack_numbers`` writes it."""
    size = np.ones(len(values), np.int64)
    for k in range(1, 5):
        size += values >= 1 << (7 * k)
    return size


#: numbers and bytes packed or unpacked at once: what the work arrays hold, not the result
PACK_STEP = 1 << 18


def pack_numbers(values: np.ndarray) -> bytes:
    """Variable-length numbers below 2 ** 35, seven bits a byte, low bits first."""
    if len(values) > PACK_STEP:
        return b"".join(pack_numbers(values[at:at + PACK_STEP]) for at in range(0, len(values), PACK_STEP))
    v = values.astype(np.int64)
    size = sizes_of(v)
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(v) else 0, np.uint8)
    at = ends - size
    for k in range(5):
        more = size > k
        if not more.any():
            break
        out[at[more] + k] = (v[more] >> (7 * k)) & 0x7F | (size[more] > k + 1).astype(np.int64) << 7
    return out.tobytes()


def unpack_numbers(data: bytes, kind: type = np.int64) -> np.ndarray:
    raw, parts, at = np.frombuffer(data, np.uint8), [], 0
    while at < len(raw):
        end = min(at + PACK_STEP, len(raw))
        while raw[end - 1] >= 0x80:  # a number of at most five bytes goes on
            end += 1
        parts.append(_unpack(raw[at:end]).astype(kind))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _unpack(raw: np.ndarray) -> np.ndarray:
    starts = np.flatnonzero(np.concatenate([[True], raw[:-1] < 0x80]))
    values = (raw[starts] & 0x7F).astype(np.int64)
    ends = np.append(starts[1:], len(raw))
    for k in range(1, 5):
        longer = np.flatnonzero(ends - starts > k)
        if not len(longer):
            break
        values[longer] |= (raw[starts[longer] + k] & 0x7F).astype(np.int64) << (7 * k)
    return values


ASKED = "bucket int, chunk binary, words binary, extra binary"
ANSWERED = "chunk binary, kind int, bucket int, payload binary"


def ask(docs: DataFrame, words_of: Callable[[bytes], list[bytes]], n: int, counted: bool = False) -> DataFrame:
    """Rows (bucket, chunk, words, extra): a chunk's distinct words, and with ``counted`` how often each stands in flagged documents."""
    def run(batches):
        for chunk in chunks(batches, words_of):
            words = list(chunk.index)
            if not words:
                continue
            bucket = buckets_of(words, n)
            order = np.argsort(bucket, kind="stable")
            if counted:
                flagged = [c for c, f in zip(chunk.codes, chunk.flags) if f]
                count = np.bincount(np.concatenate(flagged), minlength=len(words)) if flagged else np.zeros(len(words), np.int64)
            cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=n))
            rows = [order[a:b] for a, b in zip(cuts, cuts[1:])]
            batch = pa.RecordBatch.from_arrays([
                pa.array([int(bucket[r[0]]) for r in rows], pa.int32()), pa.array([chunk.key()] * len(rows), pa.binary()),
                pa.array([b" ".join([words[i] for i in r.tolist()]) for r in rows], pa.binary()),
                pa.array([pack_numbers(count[r]) if counted else b"" for r in rows], pa.binary())], names=["bucket", "chunk", "words", "extra"])
            # the next chunk is built while this frame waits: it must not hold the one before
            chunk = words = bucket = order = rows = None
            yield batch
    return docs.mapInArrow(run, ASKED)


def by_bucket(asked: DataFrame, solve: Callable[[], Callable], n: int) -> DataFrame:
    """Brings a bucket's rows together; ``solve()`` makes ``answer(rows)``, which turns its (chunk, words, extra) rows into answer rows.

    ``answer`` gets an iterator over the rows of one bucket and yields (chunk, kind, payload).
    """
    def run(batches):
        answer = solve()

        def rows():
            for batch in batches:
                for at in range(batch.num_rows):
                    yield tuple(batch.column(k)[at].as_py() for k in range(4))
        source = rows()
        row = next(source, None)
        while row is not None:
            bucket, ended = row[0], [None]

            def same(first=row, bucket=bucket, ended=ended):
                yield first[1:]
                for r in source:
                    if r[0] != bucket:
                        ended[0] = r
                        return
                    yield r[1:]
            out, size = [], 0
            for chunk, kind, payload in answer(same()):
                out.append((chunk, kind, payload))
                size += len(payload)
                if size >= OUT_BYTES:
                    yield _answers(out, bucket)
                    out, size = [], 0
            if out:
                yield _answers(out, bucket)
            row = ended[0]
    return asked.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, ANSWERED)


def _answers(out: list[tuple], bucket: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.int32()),
                                       pa.array([bucket] * len(out), pa.int32()), pa.array([o[2] for o in out], pa.binary())],
                                      names=["chunk", "kind", "bucket", "payload"])


def positions(docs: DataFrame, words_of: Callable[[bytes], list[bytes]], n: int, describe: Callable[[Chunk], bytes] | None = None) -> DataFrame:
    """Rows (chunk, kind, bucket, payload): kind 1 names documents and buckets of a chunk, kind 2 its word numbers."""
    def run(batches):
        for chunk in chunks(batches, words_of):
            words = list(chunk.index)
            head = [pack_bytes([b"" if i is None else str(i).encode() for i in chunk.ids]), np.array([len(c) for c in chunk.codes], np.uint32).tobytes(),
                    pack_numbers(buckets_of(words, n)) if words else b"", describe(chunk) if describe else b""]
            codes = pack_numbers(np.concatenate(chunk.codes))
            batch = pa.RecordBatch.from_arrays([pa.array([chunk.key()] * 2, pa.binary()), pa.array([1, 2], pa.int32()), pa.array([-1, -1], pa.int32()),
                                                pa.array([pack_bytes(head), codes], pa.binary())], names=["chunk", "kind", "bucket", "payload"])
            chunk = words = head = codes = None
            yield batch
    return docs.mapInArrow(run, ANSWERED)


def pack_bytes(parts: list[bytes]) -> bytes:
    return b"".join([len(parts).to_bytes(8, "little"), np.array([len(p) for p in parts], np.uint64).tobytes(), *parts])


def unpack_bytes(data: bytes) -> list[bytes]:
    n = int.from_bytes(data[:8], "little")
    ends = np.cumsum(np.frombuffer(data, np.uint64, n, 8)).astype(np.int64) + 8 + 8 * n
    starts = np.concatenate([[8 + 8 * n], ends[:-1]]).astype(np.int64) if n else ends
    return [data[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def meet(answers: DataFrame, places: DataFrame, finish: Callable[[], Callable], schema: str, n: int) -> DataFrame:
    """Answers and positions of a chunk come together; ``finish()`` makes ``done(ids, lengths, codes, replies, extra, place)``, which yields Arrow batches.

    ``replies`` are the answer payloads in bucket order and ``codes`` number the words in that order; ``place`` gives that number for
    words in order of first sight, the order of what ``describe`` says of them.
    """
    def run(batches):
        done = finish()
        key, replies, head = None, {}, None
        for batch in batches:
            for at in range(batch.num_rows):
                chunk, kind, bucket, payload = (batch.column(k)[at].as_py() for k in range(4))
                if chunk != key:
                    key, replies, head = chunk, {}, None
                if kind == 0:
                    replies[bucket] = payload
                elif kind == 1:
                    head = payload
                else:
                    ids, lengths, bucket_of, extra = unpack_bytes(head)
                    bucket_of, lengths = unpack_numbers(bucket_of), np.frombuffer(lengths, np.uint32).astype(np.int64)
                    wanted = np.unique(bucket_of).tolist()
                    if any(b not in replies for b in wanted):
                        raise RuntimeError("a chunk's words have no answer: the two passes did not read the same rows in the same order")
                    place = np.empty(len(bucket_of), np.int64)
                    place[np.argsort(bucket_of, kind="stable")] = np.arange(len(bucket_of))
                    ids = [int(i) if i else None for i in unpack_bytes(ids)]
                    yield from done(ids, lengths, place[unpack_numbers(payload, np.uint32)], [replies[b] for b in wanted], extra, place)
    # (kind, bucket) order puts the answers first; repeated rows of equal chunks bring equal answers
    return (answers.filter("kind = 0").unionByName(places).repartition(n, "chunk").sortWithinPartitions("chunk", "kind", "bucket").mapInArrow(run, schema))
