"""Word and window hashes of whole batches of texts, in numpy."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: odd bases of the two window hashes and their inverses modulo 2 ** 64
BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base & (2**64 - 1)), np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Texts:
    """Words of several texts: ``begin`` and ``end`` in ``raw``, one hash each, and where each text's words begin (``first``)."""

    def __init__(self, texts: list[bytes]):
        self.raw = b"\n".join(texts) + b"\n"
        data = np.frombuffer(self.raw, np.uint8)
        inside = ~_SPACE[data]
        edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
        self.begin, self.end = edge[::2], edge[1::2]
        starts = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.first = np.searchsorted(self.begin, starts)
        self.n = len(self.begin)
        if self.n:
            size = self.end - self.begin
            value = np.where(inside, _BYTE[data], np.uint64(0))
            # position within the word: a step per byte, counted from the word's first byte
            where = np.flatnonzero(inside)
            within = where - np.repeat(self.begin, size)
            value[where] *= _powers(int(_STEP) | 1, int(size.max()))[within]
            self.word = mix(np.add.reduceat(value, self.begin) + size.astype(np.uint64) * _STEP)
        else:
            self.word = np.zeros(0, np.uint64)
        self.sums = [self._sums(b, k) for k, b in enumerate(BASES)]

    def _sums(self, base: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        powers = _powers(base, self.n)
        word = self.word if k == 0 else mix(self.word ^ np.uint64(0x5851F42D4C957F2D))
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(word * powers, dtype=np.uint64)]), _powers(pow(base, -1, 1 << 64), self.n + 1)

    def window(self, begin: np.ndarray, length: np.ndarray | int, k: int = 0) -> np.ndarray:
        """Hash ``k`` of the words [begin, begin + length)."""
        sums, inverse = self.sums[k]
        return mix((sums[begin + length] - sums[begin]) * inverse[begin] + np.asarray(length).astype(np.uint64))
