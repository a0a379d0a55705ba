"""NumPy kernels over one Arrow batch of payloads; Spark owns partitioning and shuffles."""

from __future__ import annotations

import numpy as np

CHUNKS = 16
PAIRS = 65536
# printable ASCII plus tab, line feed, carriage return
TEXT_BYTES = np.zeros(256, dtype=bool)
TEXT_BYTES[0x20:0x7F] = True
TEXT_BYTES[[0x09, 0x0A, 0x0D]] = True


def entropy_of_counts(counts: np.ndarray) -> np.ndarray:
    """Bits per byte of each row of a count matrix; 0 for an empty row."""
    total = counts.sum(axis=1, keepdims=True)
    p = counts / np.maximum(total, 1)
    logs = np.zeros_like(p)
    np.log2(p, out=logs, where=p > 0)
    return np.abs((p * logs).sum(axis=1))


def histograms(payloads: list[bytes], group_bytes: int = 4 << 20) -> np.ndarray:
    """256 counts per payload, many payloads per bincount call."""
    out = np.zeros((len(payloads), 256), dtype=np.int64)
    i = 0
    while i < len(payloads):
        j, size = i, 0
        while j < len(payloads) and (j == i or size + len(payloads[j]) <= group_bytes):
            size += len(payloads[j])
            j += 1
        raw = np.frombuffer(b"".join(payloads[i:j]), dtype=np.uint8)
        lens = np.fromiter((len(p) for p in payloads[i:j]), dtype=np.int64, count=j - i)
        slot = np.repeat(np.arange(j - i, dtype=np.int64) * 256, lens)
        out[i:j] = np.bincount(slot + raw, minlength=(j - i) * 256).reshape(j - i, 256)
        i = j
    return out


def chunk_entropies(raw: np.ndarray, k: int = CHUNKS) -> np.ndarray:
    """Entropy of ``k`` equal chunks; the last takes the remainder, missing chunks are 0."""
    n = raw.size
    if n == 0:
        return np.zeros(k)
    slot = np.minimum(np.arange(n) // max(n // k, 1), k - 1)
    return entropy_of_counts(np.bincount(slot * 256 + raw, minlength=k * 256).reshape(k, 256))


def pair_stats(raw: np.ndarray) -> np.ndarray:
    """sparsity, top-10 share, transition entropy, 1/distinct, variance, distinct ratio."""
    if raw.size < 2:
        return np.array([1.0 if raw.size else 0.0, 0, 0, 0, 0, 0])
    codes = (raw[:-1].astype(np.int64) << 8) | raw[1:]
    counts = np.bincount(codes, minlength=PAIRS)
    counts = np.sort(counts[counts > 0])
    p = counts / codes.size
    d = counts.size
    return np.array([(PAIRS - d) / PAIRS, counts[-10:].sum() / codes.size,
                     -(p * np.log2(p)).sum(), 1.0 / d, p.var(), d / PAIRS])


def longest_text_run(raw: np.ndarray) -> int:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], TEXT_BYTES[raw].astype(np.int8), [0]))))
    return int((edges[1::2] - edges[::2]).max()) if edges.size else 0


def text_run_ratio(raw: np.ndarray) -> float:
    return float(np.log2(longest_text_run(raw) + 1) / np.log2(raw.size + 1)) if raw.size else 0.0


def chi_square_score(counts: np.ndarray) -> np.ndarray:
    n = counts.sum(axis=1, keepdims=True)
    expected = np.maximum(n, 1) / 256.0
    chi2 = ((counts - expected) ** 2 / expected).sum(axis=1)
    return np.where(n[:, 0] > 0, np.clip(np.log10(chi2 + 1.0) / 10.0, 0.0, 1.0), 0.0)


def feature_rows(payloads: list[bytes]) -> np.ndarray:
    """280 features: 256 byte shares, 16 chunk entropies, 6 pair stats, text run, chi-square."""
    counts = histograms(payloads)
    n = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    out = np.zeros((len(payloads), 280))
    out[:, :256] = counts / n
    out[:, 279] = chi_square_score(counts)
    for i, p in enumerate(payloads):
        if p:
            raw = np.frombuffer(p, dtype=np.uint8)
            out[i, 256:272] = chunk_entropies(raw)
            out[i, 272:278] = pair_stats(raw)
            out[i, 278] = text_run_ratio(raw)
    return out


FEATURE_NAMES = ([f"byte_freq_{i:02x}" for i in range(256)]
                 + [f"entropy_chunk_{i}" for i in range(CHUNKS)]
                 + ["bigram_sparsity", "bigram_top10_concentration", "bigram_transition_entropy",
                    "bigram_mean_prob", "bigram_variance", "bigram_distinct_ratio",
                    "longest_ascii_run_ratio", "chi_square_uniformity"])
