"""BPE encoding and decoding over a distinct-word table.

Texts are split into words at ASCII white space, every distinct word is encoded once, and its ids come back to the word's positions
(``wordtable``). This holds for tokenizers that drop white space and never merge across it, such as the lower-casing word BPE used by
default; the vocabulary file is a parameter. Decoding joins ids with the vocabulary's pieces; the vocabulary is bounded, so it is
broadcast.

Defined results: a null or empty text has no ids and decodes to the empty text; strings of special tokens inside a text become
special ids, as the library does; repeated rows are encoded one by one; an empty table gives an empty result; the input must be a stable
table (files or a checkpoint), which both passes read in the same order; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blocklens.llm import wordtable
from blocklens.llm.common import partitions, query, table

VOCABULARY = "word_bpe_49k.json"
#: words handed to the library at once
ENCODE_WORDS = 4096


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def encode_words(tokenizer, words: list[bytes]) -> list[bytes]:
    """Packed number of ids and ids of each word; the words are encoded as one text and told apart by the tokens' places."""
    names = [w.decode("utf-8", "replace") for w in words]
    found = tokenizer.encode(" ".join(names), add_special_tokens=False)
    ids = np.array(found.ids, np.int64)
    begins = np.cumsum([0, *(len(x) + 1 for x in names[:-1])])
    owner = np.searchsorted(begins, np.array([a for a, _ in found.offsets], np.int64), side="right") - 1
    many = np.bincount(owner, minlength=len(words))
    heads = np.arange(len(words)) + np.cumsum(many) - many
    flat = np.empty(len(ids) + len(words), np.int64)
    flat[heads] = many
    flat[np.arange(len(ids)) + owner + 1] = ids
    data, cuts = wordtable.pack_numbers(flat), np.concatenate([[0], np.cumsum(wordtable.sizes_of(flat))])
    cuts = cuts[np.append(heads, len(flat))].tolist()
    return [data[a:b] for a, b in zip(cuts, cuts[1:])]


def _encoder(path: str):
    def solve():
        tokenizer = load(path)

        def answer(rows):
            known: dict[bytes, bytes] = {}
            for chunk, words, _ in rows:
                asked = words.split(b" ")
                new = [w for w in asked if w not in known]
                for at in range(0, len(new), ENCODE_WORDS):
                    part = new[at:at + ENCODE_WORDS]
                    known.update(zip(part, encode_words(tokenizer, part)))
                yield chunk, 0, b"".join(map(known.__getitem__, asked))
        return answer
    return solve


def _word_ids(replies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all words one after another, where each word begins, and how many it has; one reply at a time."""
    parts, begins, base = [], [], 0
    for reply in replies:
        flat = wordtable.unpack_numbers(reply)
        starts, at, sizes = [], 0, flat.tolist()
        while at < len(sizes):
            starts.append(at)
            at += sizes[at] + 1
        parts.append(flat)
        begins.append(np.array(starts, np.int64) + base)
        base += len(flat)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    starts = np.concatenate(begins) if begins else np.zeros(0, np.int64)
    return flat, starts + 1, flat[starts]


def _finish():
    def done(ids, lengths, codes, replies, extra, place):
        flat, begin, size = _word_ids(replies)
        at = 0
        out_ids, out, held = [], [], 0
        for doc_id, n in zip(ids, lengths.tolist()):
            c = codes[at:at + n]
            at += n
            many = size[c]
            ends = np.cumsum(many)
            tokens = flat[np.repeat(begin[c] - (ends - many), many) + np.arange(ends[-1] if n else 0)].astype("<u4").tobytes()
            out_ids.append(doc_id)
            out.append(tokens)
            held += len(tokens)
            if held >= wordtable.OUT_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(out_ids, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "ids"])
                out_ids, out, held = [], [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out_ids, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "ids"])
    return done


def encode(docs: DataFrame, path: str | None = None, buckets: int | None = None) -> DataFrame:
    """doc_id, ids: a text's ids as little-endian unsigned 32-bit numbers; one row per document."""
    path, n = path or vocabulary_path(), buckets or partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(True).alias("flag"))
    answers = wordtable.by_bucket(wordtable.ask(rows, bytes.split, n), _encoder(path), n)
    return wordtable.meet(answers, wordtable.positions(rows, bytes.split, n), _finish, "doc_id long, ids binary", n)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` (doc_id, ids) with the decoded text: each id meets its piece in the broadcast vocabulary, pieces are joined by one space."""
    vocabulary = load(path or vocabulary_path())
    if vocabulary.decoder is not None:
        raise ValueError("only vocabularies without a decoder of their own are supported")
    table_ = encoded.sparkSession.sparkContext.broadcast([vocabulary.id_to_token(i) for i in range(vocabulary.get_vocab_size(with_added_tokens=True))])

    def run(batches):
        piece = table_.value.__getitem__
        for batch in batches:
            ids = batch.column(1)
            texts = [" ".join(map(piece, np.frombuffer(ids[i].as_py(), "<u4").tolist())) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """The contract's columns, from the operator's ids and texts."""
    return decode(encoded).select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                                  F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def plain(text: str | None, path: str | None = None) -> tuple[int, str, str]:
    """The same digests of one text, straight from the library: what tests compare with."""
    tokenizer = load(path or vocabulary_path())
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest())


@query("op5_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(table(spark, sf_dir, "documents")))
