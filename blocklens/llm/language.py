"""Scoring texts with a log-bilinear language model.

The model predicts a token's class from the three tokens before it: context vectors are weighted per position and summed, and the sum
is multiplied with class vectors in two steps, the groups of classes and the classes of one group, each normalised by a softmax. There are
about as many classes as the square root of the number of distinct training words, in about as many groups as the square root of that, so the model grows
with the vocabulary while a token costs its fourth root. The most frequent words are classes of their own; all other words
fall into classes by their last bytes and share the class's probability by their smoothed counts, so every token of any text
has a normalised probability. Training is noise-contrastive on both steps: each task runs mini-batches in numpy over its part of the training
texts, and the tasks' parameters are averaged by the tokens they saw, for as many rounds as the texts are split into.

Word counts, the number of tokens and of distinct tokens come from all training texts through ``wordtable``. A second pass writes every text as
word numbers and the classes of its words; training and scoring read that. The driver holds the model alone: the head words, sums by
class and the parameters, of the order of the square root of the vocabulary.

Defined results: a null text is empty and has one token, its end; a null doc_id is hashed as the empty string; unseen words count
zero; repeated rows are counted and scored one by one; of head words with equal counts the smaller in byte order come first; an empty table gives
an empty result, a table without training texts the uniform model; the input must be a stable table, which all passes read alike; other columns are
not looked at.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blocklens.llm import wordtable
from blocklens.llm.common import partitions, query, table
from blocklens.session import cut_lineage

FOLDS, HELD = 7, 2
#: class of the end of a text; head words follow, then classes by last bytes
END = 0
CONTEXT = 3
WIDTH = 16
#: noise draws a batch for groups, and for the classes of each group
NOISE, INNER = 16, 8
#: least and most tokens of a mini-batch; it grows with what the task has seen, a ``GROW``-th of it, as later steps need less noise and fewer updates
BATCH, MOST_BATCH, GROW = 1024, 4096, 64
RATE = 0.08
ROUNDS = 2
SCORED = 16384
#: tokens whose order is shuffled together, or scored together, at least one text
TOGETHER = 1 << 18


def words_of(raw: bytes) -> list[bytes]:
    return raw.lower().split()


def sizes(words: int) -> tuple[int, int, int]:
    """Groups (and classes of a group), head words and tail classes of a vocabulary."""
    side = max(8, math.ceil(words ** 0.25))
    tails = 1 << int(math.log2(side * side // 4))
    return side, side * side - 1 - tails, tails


def tail_class(word: bytes, tails: int) -> int:
    """``tails`` is a power of two, so classes of more tails fold into those of fewer."""
    return zlib.crc32(word[-2:]) & (tails - 1)


@dataclass
class Model:
    """Everything a task needs; its size is that of the classes."""
    side: int
    tails: int
    head: dict[bytes, int]
    class_tokens: np.ndarray
    class_words: np.ndarray
    tokens: int
    words: int
    params: list[np.ndarray]

    def classes(self, words: list[bytes]) -> np.ndarray:
        get, first = self.head.get, self.side ** 2 - self.tails
        return np.array([get(w) or first + tail_class(w, self.tails) for w in words], np.int64)

    def noise(self) -> np.ndarray:
        return (self.class_tokens + 1.0) / (self.class_tokens.sum() + len(self.class_tokens))

    def log_noise(self) -> tuple[np.ndarray, np.ndarray]:
        """Of groups, and of classes within their groups."""
        noise = self.noise().reshape(self.side, self.side)
        groups = noise.sum(axis=1)
        return np.log(groups).astype(np.float32), np.log(noise / groups[:, None]).ravel().astype(np.float32)


def initial(model: Model, seed: int = 1) -> list[np.ndarray]:
    """Vectors of contexts, of groups and of classes, the last two with their bias at the end, and position weights; the biases alone are the unigram model."""
    rng = np.random.default_rng(seed)
    contexts, groups, classes = ((0.1 * rng.standard_normal((n, WIDTH))).astype(np.float32) for n in (model.side ** 2 + 1, model.side, model.side ** 2))
    biased = [np.column_stack([v, bias]) for v, bias in zip((groups, classes), model.log_noise())]
    return [contexts, *biased, np.full((CONTEXT, WIDTH), 1 / CONTEXT, np.float32)]


class Stream:
    """Classes of whole texts one after the other, each with the context before a text begins (class ``start``) in front."""

    def __init__(self, stream: np.ndarray, lengths: np.ndarray, start: int):
        self.target = stream.astype(np.int32)
        self.at = np.arange(len(stream)) + CONTEXT * np.repeat(np.arange(1, len(lengths) + 1), lengths)
        self.padded = np.full(len(stream) + CONTEXT * len(lengths), start, np.int32)
        self.padded[self.at] = stream

    def contexts(self, which) -> np.ndarray:
        """Per token, the classes of the ``CONTEXT`` tokens before it, nearest first."""
        return self.padded[self.at[which][:, None] - np.arange(1, CONTEXT + 1)]


def _sums(rows: np.ndarray, values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows, of ``size``, and the sum of the values of each."""
    order = np.argsort(rows.astype(np.uint16) if size <= 1 << 16 else rows, kind="stable")
    rows = rows[order]
    cut = np.flatnonzero(np.diff(rows, prepend=-1))
    return rows[cut], np.add.reduceat(values.take(order, axis=0), cut, axis=0)


def _adagrad(param: np.ndarray, square: np.ndarray, rows, grad: np.ndarray) -> None:
    """Only rows with a gradient change."""
    s = square[rows] + grad * grad
    square[rows] = s
    s += 1e-8
    param[rows] -= RATE * grad / np.sqrt(s, out=s)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def hidden_of(q: np.ndarray, c: np.ndarray, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Context vectors of each token, and their weighted sum with a one at the end, which meets the biases."""
    seen = q.take(ctx, axis=0)
    hidden = np.ones((len(ctx), WIDTH + 1), np.float32)
    np.einsum("bkw,kw->bw", seen, c, out=hidden[:, :-1])
    return seen, hidden


def train_step(model: Model, squares: list[np.ndarray], ctx: np.ndarray, target: np.ndarray, drawn: np.ndarray, inner: np.ndarray, log_noise: tuple[np.ndarray, np.ndarray]) -> None:
    """One mini-batch of noise-contrastive estimation with Adagrad; ``target`` ascends by group.

    The batch shares the drawn noise groups; tokens of a group share that group's drawn classes, a row of ``inner``.
    """
    q, t, r, c = model.params
    group = target // model.side
    seen, hidden = hidden_of(q, c, ctx)
    # groups against noise groups
    less = log_noise[0] + np.float32(np.log(len(drawn)))
    t_mine, t_drawn = t.take(group, axis=0), t[drawn]
    t_true = -_sigmoid(less[group] - np.einsum("bw,bw->b", hidden, t_mine))
    t_false = _sigmoid(hidden @ t_drawn.T - less[drawn])
    # classes against noise classes of the same group
    begin = np.flatnonzero(np.diff(group, prepend=-1))
    runs = list(zip(begin.tolist(), [*begin[1:].tolist(), len(target)]))
    others = inner[group[begin]]
    less = log_noise[1] + np.float32(np.log(inner.shape[1]))
    r_mine, r_others = r.take(target, axis=0), r[others]
    c_true = -_sigmoid(less[target] - np.einsum("bw,bw->b", hidden, r_mine))
    c_false = np.empty((len(target), inner.shape[1]), np.float32)
    for k, (a, b) in enumerate(runs):
        np.matmul(hidden[a:b], r_others[k].T, out=c_false[a:b])
    c_false = _sigmoid(c_false - less[others].repeat(np.diff(begin, append=len(target)), axis=0))
    # what each token's hidden vector, and each vector it met, should change by
    d_hidden = t_false @ t_drawn
    t_mine *= t_true[:, None]
    d_hidden += t_mine
    r_mine *= c_true[:, None]
    d_hidden += r_mine
    g_others = np.empty_like(r_others)
    for k, (a, b) in enumerate(runs):
        d_hidden[a:b] += c_false[a:b] @ r_others[k]
        np.matmul(c_false[a:b].T, hidden[a:b], out=g_others[k])
    g_t = np.zeros_like(t)
    g_t[group[begin]] = np.add.reduceat(t_true[:, None] * hidden, begin, axis=0)
    np.add.at(g_t, drawn, t_false.T @ hidden)
    rows, g_r = _sums(np.concatenate([target, others.ravel()]), np.concatenate([c_true[:, None] * hidden, g_others.reshape(-1, WIDTH + 1)]), len(r))
    d_hidden = np.ascontiguousarray(d_hidden[:, :-1])
    at, g_q = _sums(ctx.ravel(), (d_hidden[:, None, :] * c).reshape(-1, WIDTH), len(q))
    g_c = np.einsum("bw,bkw->kw", d_hidden, seen)
    n = np.float32(len(target))
    for k, (which, grad) in enumerate([(at, g_q), (slice(None), g_t), (rows, g_r), (slice(None), g_c)]):
        grad /= n
        _adagrad(model.params[k], squares[k], which, grad)


def _texts(batches):
    """Rows of ``wordtable.positions`` with ``_describe``: (lengths with the end, class of each word number, flags, word numbers) of each chunk."""
    head = None
    for batch in batches:
        for at in range(batch.num_rows):
            payload = batch.column(1)[at].as_py()
            if batch.column(0)[at].as_py() == 1:
                head = payload
                continue
            _, lengths, _, extra = wordtable.unpack_bytes(head)
            kinds, flags = wordtable.unpack_bytes(extra)
            yield np.frombuffer(lengths, np.uint32).astype(np.int64), np.frombuffer(kinds, np.uint32), np.frombuffer(flags, np.uint8) > 0, wordtable.unpack_numbers(payload)


def _groups(lengths: np.ndarray, kinds: np.ndarray, codes: np.ndarray, start: int):
    """The texts of a chunk in runs of about ``TOGETHER`` tokens: (first text, lengths with ends, stream)."""
    ends = np.cumsum(lengths)
    first = 0
    while first < len(lengths):
        begin = int(ends[first] - lengths[first])
        last = max(first + 1, int(np.searchsorted(ends, begin + TOGETHER, side="right")))
        lens = lengths[first:last] + 1
        stream = np.full(int(lens.sum()), END, np.int64)
        inside = np.ones(len(stream), bool)
        inside[np.cumsum(lens) - 1] = False
        stream[inside] = kinds[codes[begin:int(ends[last - 1])]]
        yield first, lens, Stream(stream, lens, start)
        first = last


def _trainer(model: Model):
    def run(batches):
        own = Model(**{**model.__dict__, "params": [p.copy() for p in model.params]})
        squares, log_noise = [np.zeros_like(p) for p in own.params], own.log_noise()
        edges = np.concatenate([[0], np.cumsum(own.noise())])
        low = edges[:-1:own.side]
        high = np.append(low[1:], edges[-1])
        groups, last = np.arange(own.side)[:, None] * own.side, own.side - 1
        seen, rng = 0, np.random.default_rng(7)
        for lengths, kinds, flags, codes in _texts(batches):
            if not flags.any():
                continue
            codes = codes[np.repeat(flags, lengths)]
            for _, lens, texts in _groups(lengths[flags], kinds, codes, own.side ** 2):
                order = rng.permutation(len(texts.target))
                at = 0
                while at < len(order):
                    pick = order[at:at + min(MOST_BATCH, max(BATCH, seen // GROW))]
                    at, seen = at + len(pick), seen + len(pick)
                    pick = pick[np.argsort(texts.target[pick], kind="stable")]
                    drawn = np.searchsorted(high, rng.random(NOISE) * high[-1], side="right").clip(0, last)
                    draws = low[:, None] + rng.random((own.side, INNER)) * (high - low)[:, None]
                    inner = (np.searchsorted(edges, draws, side="right") - 1).clip(groups, groups + last)
                    train_step(own, squares, texts.contexts(pick), texts.target[pick], drawn, inner, log_noise)
        if seen:
            yield _weighted([seen], [np.concatenate([p.ravel() for p in own.params]).astype(np.float64) * seen])
    return run


def _weighted(seen: list[int], sums: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array([s.tobytes() for s in sums], pa.binary())], names=["seen", "params"])


def _sum_up(batches):
    seen, total = 0, None
    for batch in batches:
        for n, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            seen, p = seen + n, np.frombuffer(p, np.float64)
            total = p if total is None else total + p
    if seen:
        yield _weighted([seen], [total])


def train(places: DataFrame, model: Model) -> Model:
    """Fits the parameters to the flagged texts of ``places``, every text once: a round trains on each part of the chunks and averages."""
    shape = "seen long, params binary"
    model.params = initial(model)
    n = partitions(places.sparkSession)
    for k in range(ROUNDS):
        part = places.filter(F.pmod(F.xxhash64("chunk"), F.lit(ROUNDS)) == k).select("kind", "payload").mapInArrow(_trainer(model), shape)
        # sums of sums: no task reads more than about the square root of the number of tasks, each row has the model's size
        few = part.repartition(max(1, round(n ** 0.5))).mapInArrow(_sum_up, shape).coalesce(1).mapInArrow(_sum_up, shape).collect()
        if few:
            flat, at, params = np.frombuffer(few[0]["params"], np.float64) / few[0]["seen"], 0, []
            for p in model.params:
                params.append(flat[at:at + p.size].reshape(p.shape).astype(np.float32))
                at += p.size
            model.params = params
    return model


def _log_sum(logits: np.ndarray) -> np.ndarray:
    top = logits.max(axis=1)
    logits -= top[:, None]
    np.exp(logits, out=logits)
    return top + np.log(logits.sum(axis=1))


def class_scores(model: Model, texts: Stream) -> np.ndarray:
    """Normalised log10 probability of each token's class, by batched matrix products."""
    q, t, r, c = model.params
    side = model.side
    out = np.empty(len(texts.target), np.float32)
    for at in range(0, len(out), SCORED):
        which = slice(at, at + SCORED)
        target, ctx = texts.target[which], texts.contexts(which)
        order = np.argsort(target.astype(np.uint16) if len(r) <= 1 << 16 else target, kind="stable")
        target, ctx = target[order], ctx[order]
        hidden = hidden_of(q, c, ctx)[1]
        group = target // side
        lines = np.arange(len(target))
        logits = hidden @ t.T
        found = logits[lines, group]
        found -= _log_sum(logits)
        begin = np.flatnonzero(np.diff(group, prepend=-1))
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(group)]):
            first = int(group[a]) * side
            logits = hidden[a:b] @ r[first:first + side].T
            found[a:b] += logits[lines[:b - a], target[a:b] - first]
            found[a:b] -= _log_sum(logits)
        out[at + order] = found
    return out / np.float32(np.log(10))


def _counter(n: int):
    def solve():
        def answer(rows):
            held, total = [], {}
            for chunk, words, extra in rows:
                counts = wordtable.unpack_numbers(extra).tolist()
                held.append((chunk, words))
                for w, m in zip(words.split(b" "), counts):
                    total[w] = total.get(w, 0) + m
            for chunk, words in held:
                yield chunk, 0, wordtable.pack_numbers(np.fromiter(map(total.__getitem__, words.split(b" ")), np.int64))
            # what the model needs to know of this bucket: its most frequent words and sums by tail class. Buckets are cut by a hash, so this one knows
            # the size of all to a small factor; it answers for four times that, and what the model does not need is folded or left out
            seen = {w: m for w, m in total.items() if m}
            if seen:
                _, heads, tails = sizes(4 * n * len(seen))
                top = sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:heads]
                kinds = np.fromiter((tail_class(w, tails) for w in seen), np.int64, len(seen))
                many = np.fromiter(seen.values(), np.int64, len(seen))
                yield b"", 1, wordtable.pack_bytes([np.bincount(kinds, weights=many, minlength=tails).astype(np.int64).tobytes(),
                                                    np.bincount(kinds, minlength=tails).astype(np.int64).tobytes(),
                                                    b" ".join(w for w, _ in top), np.array([m for _, m in top], np.int64).tobytes()])
        return answer
    return solve


def _folded(sums: np.ndarray, tails: int) -> np.ndarray:
    return sums.reshape(-1, tails).sum(axis=0)


def _merge(batches):
    """Summaries of buckets to one: sums by tail class, as coarse as the coarsest, and as many of the most frequent words as the longest list has."""
    tokens = words = None
    top, longest = {}, 0
    for batch in batches:
        for payload in batch.column(0).to_pylist():
            a, b, names, counts = wordtable.unpack_bytes(payload)
            a, b, counts = (np.frombuffer(x, np.int64) for x in (a, b, counts))
            if tokens is None:
                tokens, words = np.zeros_like(a), np.zeros_like(b)
            tails = min(len(tokens), len(a))
            tokens, words = _folded(tokens, tails) + _folded(a, tails), _folded(words, tails) + _folded(b, tails)
            top.update(zip(names.split(b" "), counts.tolist()))
            longest = max(longest, len(counts))
            if len(top) > 4 * longest:
                top = dict(sorted(top.items(), key=lambda x: (-x[1], x[0]))[:longest])
    if tokens is not None:
        top = dict(sorted(top.items(), key=lambda x: (-x[1], x[0]))[:longest])
        yield pa.RecordBatch.from_arrays([pa.array([wordtable.pack_bytes([tokens.tobytes(), words.tobytes(), b" ".join(top), np.array(list(top.values()), np.int64).tobytes()])], pa.binary())], names=["payload"])


def summary(answers: DataFrame, n_texts: int, n: int) -> Model:
    one = (answers.filter("kind = 1").select("payload").repartition(max(1, round(n ** 0.5))).mapInArrow(_merge, "payload binary")
           .coalesce(1).mapInArrow(_merge, "payload binary").collect())
    tokens, words, top = np.zeros(1, np.int64), np.zeros(1, np.int64), {}
    if one:
        a, b, names, counts = wordtable.unpack_bytes(bytes(one[0]["payload"]))
        tokens, words = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)
        top = dict(zip(names.split(b" "), np.frombuffer(counts, np.int64).tolist()))
    all_tokens, all_words = int(tokens.sum()) + n_texts, int(words.sum()) + (n_texts > 0)
    side, _, tails = sizes(all_words)
    tails = min(tails, len(tokens))
    tokens, words, heads = _folded(tokens, tails).copy(), _folded(words, tails).copy(), side * side - 1 - tails
    own, head = np.zeros(heads, np.int64), {}
    for k, (w, c) in enumerate(list(top.items())[:heads]):
        tokens[tail_class(w, tails)] -= c
        words[tail_class(w, tails)] -= 1
        own[k], head[w] = c, END + 1 + k
    return Model(side, tails, head, np.concatenate([[n_texts], own, tokens]), np.concatenate([np.ones(heads + 1, np.int64), words]), all_tokens, all_words, [])


SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _describe(model: Model):
    """What goes with a chunk's positions: the class of each word and the flag of each text."""
    def describe(chunk: wordtable.Chunk) -> bytes:
        return wordtable.pack_bytes([model.classes(list(chunk.index)).astype(np.uint32).tobytes(), np.array(chunk.flags, np.uint8).tobytes()])
    return describe


def _score(model: Model):
    def finish():
        base = np.log10(model.tokens + model.words + 1.0)
        shared = np.log10(model.class_tokens + model.class_words + 1.0)
        end_count, first_tail = int(model.class_tokens[END]), model.side ** 2 - model.tails

        def done(ids, lengths, codes, replies, extra, place):
            kinds = np.frombuffer(wordtable.unpack_bytes(extra)[0], np.uint32).astype(np.int64)
            count = wordtable.unpack_numbers(b"".join(replies))
            kind = np.empty_like(kinds)
            kind[place] = kinds
            logs = np.log10(count + 1.0)
            own = np.where(kind < first_tail, 0.0, logs - shared[kind])
            known = (count > 0).astype(np.int64)
            ends = np.cumsum(lengths)
            tail = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[codes])])[np.concatenate([[0], ends])])
            neural = []
            for _, lens, texts in _groups(lengths, kind, codes, model.side ** 2):
                neural.append(np.add.reduceat(class_scores(model, texts).astype(np.float64), np.cumsum(lens) - lens))
            n = lengths + 1
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(tail(known) + (end_count > 0), pa.int64()),
                pa.array(tail(logs) + np.log10(end_count + 1.0) - n * base, pa.float64()), pa.array(np.concatenate(neural) + tail(own), pa.float64())],
                names=["doc_id", "n_tokens", "n_known", "base_score", "score"])
        return done
    return finish


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: the model learns from texts that are not held out and scores all."""
    n = partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (~held_out()).alias("flag"))
    answers = cut_lineage(wordtable.by_bucket(wordtable.ask(rows, words_of, n, counted=True), _counter(n), n))
    model = summary(answers, rows.filter("flag").count(), n)
    places = cut_lineage(wordtable.positions(rows, words_of, n, _describe(model)))
    scored = wordtable.meet(answers, places, _score(train(places, model)), SCORES, n)
    return scored.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


@query("op8_lm_score")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
