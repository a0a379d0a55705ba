"""The operators again, in plain Python over small lists: what the Spark results are compared with."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from functools import cache

import xxhash

SPACE = r"[\x20\x09-\x0D]"


def prose(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    syllables = ["an", "ble", "ed", "er", "ing", "ion", "ou", "re", "st", "th", "é", "ß", "ñ"]
    return ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(text) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def quality(text):
    w = words(text)
    found = Counter(zip(w, w[1:], w[2:]))
    covered = {i + d for i, g in enumerate(zip(w, w[1:], w[2:])) if found[g] > 1 for d in (0, 1, 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    row = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum((text or "").count(c) for c in "#*$%&|<>"), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}
    row["base_failed"] = row["n_words"] < 50 or 100 * row["n_repeat_words"] > 50 * row["n_words"]
    upper = len(re.findall(r"[A-ZÀ-ÖØ-Þ]", text or ""))
    rates = {"r_symbol": 10000 * row["n_symbols"] // max(row["word_chars"], 1), "r_dup": 10000 * row["n_dup_lines"] // max(len(lines), 1), "r_repeat": 10000 * len(covered) // max(len(w), 1),
             "r_upper": 10000 * upper // max(row["word_chars"], 1), "r_length": 100 * row["word_chars"] // max(len(w), 1)}
    return row, rates


def kept_by_quality(docs, margins, prior, spreads):
    """docs: (doc_id, text, lang, source) rows; the verdict of each. A level's weights are its counts plus the level above, worth ``prior`` documents."""
    measured = [(quality(t), lang, source) for _, t, lang, source in docs]
    cut = lambda x: x if x < 1000 else x - x % 10 ** (len(str(x)) - 3)
    bins = defaultdict(Counter)
    for (row, rates), lang, source in measured:
        if not row["base_failed"]:
            for r, v in rates.items():
                for level in ((lang, source, r), (lang, r), (r,)):
                    bins[level][cut(v)] += 1

    @cache
    def weights(level):
        own = {b: Fraction(n) for b, n in bins[level].items()}
        if len(level) > 1:
            above = weights((level[0], level[2]) if len(level) == 3 else (level[1],))
            total = sum(above.values())
            for b, w in above.items():
                own[b] = own.get(b, 0) + prior * w / total
        return own

    @cache
    def quartiles(level):
        w, below, out = weights(level), Fraction(0), []
        total = sum(w.values())
        for b in sorted(w):
            below += w[b]
            while len(out) < 3 and 4 * below >= (len(out) + 1) * total:
                out.append(b)
        return out
    out = []
    for (row, rates), lang, source in measured:
        ok = not row["base_failed"]
        for r, v in rates.items():
            if not ok:
                break
            q1, q2, q3 = quartiles((lang, source, r))
            low = min(q2 - margins[r], q1 - spreads * (q3 - q1)) if r == "r_length" else -1
            ok = low <= v <= max(q2 + margins[r], q3 + spreads * (q3 - q1))
        out.append(ok)
    return out


def chunked(text, divisor=3):
    lines = (text or "").split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    out, start = [], 0
    for i in range(len(lines)):
        if i == len(lines) - 1 or i >= 1 and (h[i - 1] * 31 + h[i]) % divisor == 0:
            out.append((start, lines[start:i + 1]))
            start = i + 1
    return out


def line_dedup(docs):
    """docs: (doc_id, text) rows, no doc_id twice with different texts; new text and removed lines of each."""
    seen, out = {}, {}
    for doc_id, text in sorted(set(docs), key=lambda r: (r[0] is None, r[0] or 0)):
        kept, removed = [], 0
        for start, part in chunked(text):
            piece = "\n".join(part)
            if sum(bool(words(x)) for x in part) >= 2 and seen.setdefault(piece, (doc_id, start)) != (doc_id, start):
                removed += len(part)
            else:
                kept += part
        out[doc_id, text] = ("\n".join(kept), removed)
    return [out[r] for r in docs]


def fingerprint(text) -> int:
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints: dict) -> dict:
    """Smallest id reachable over links of three or fewer differing bits."""
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def substring_dedup(docs: dict, window=50):
    seen, out = {}, {}
    for d in sorted(docs):
        w = words(docs[d])
        stays = [True] * len(w)
        for i in range(len(w) - window + 1):
            g = tuple(w[i:i + window])
            if seen.setdefault(g, d) < d:
                stays[i:i + window] = [False] * window
        out[d] = (len(w), stays.count(False), sha(" ".join(x for x, s in zip(w, stays) if s)))
    return out


def targets(sizes: dict, most=3):
    """source -> target, by repeated resharing."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, done = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in done]
        left = total - sum(done.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return done | share
        done |= {s: most * sizes[s] for s in over}


def licenses(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    starts, labels = [], set()
    for phrase, label in {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i:i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def unigrams(docs: dict):
    """doc_id -> (held_out, n_tokens, n_known, train_tokens, base_score)."""
    tokens = {d: [*(t or "").encode().lower().split(), None] for d, t in docs.items()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in docs}
    c = Counter(w for d in docs if not held[d] for w in tokens[d])
    n, v = sum(c.values()), len(c)
    return {d: (held[d], len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) for d, t in tokens.items()}
