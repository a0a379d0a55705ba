"""GF(2^8) arithmetic on byte vectors, generator 2, polynomial 0x11D."""

from __future__ import annotations

import numpy as np

POLY = 0x11D

EXP = np.zeros(510, dtype=np.uint8)
LOG = np.zeros(256, dtype=np.int64)
_x = 1
for _i in range(255):
    EXP[_i] = EXP[_i + 255] = _x
    LOG[_x] = _i
    _x = (_x << 1) ^ (POLY if _x & 0x80 else 0)


def power(i: int) -> int:
    return int(EXP[i % 255])


def scale(coeff: int, block: np.ndarray) -> np.ndarray:
    out = EXP[LOG[block] + LOG[coeff]] if coeff else np.zeros_like(block)
    return np.where(block == 0, np.uint8(0), out)


def inverse(a: int) -> int:
    return int(EXP[255 - LOG[a]])


def p_of(columns: dict[int, np.ndarray]) -> np.ndarray:
    return np.bitwise_xor.reduce(list(columns.values()))


def q_of(columns: dict[int, np.ndarray]) -> np.ndarray:
    return np.bitwise_xor.reduce([scale(power(i), b) for i, b in columns.items()])


def solve(columns: dict[int, np.ndarray], missing: list[int], p: np.ndarray | None, q: np.ndarray | None) -> dict[int, np.ndarray] | None:
    """Missing data columns from the present ones and the parities at hand; None if too many are gone."""
    if not missing:
        return {}
    size = len(next(b for b in [p, q, *columns.values()] if b is not None))
    zero = np.zeros(size, dtype=np.uint8)
    if len(missing) == 1:
        x = missing[0]
        if p is not None:
            return {x: p ^ (p_of(columns) if columns else zero)}
        if q is not None:
            return {x: scale(inverse(power(x)), q ^ (q_of(columns) if columns else zero))}
        return None
    if len(missing) == 2 and p is not None and q is not None:
        x, y = missing
        px = p ^ (p_of(columns) if columns else zero)
        qx = q ^ (q_of(columns) if columns else zero)
        dy = scale(inverse(power(x) ^ power(y)), qx ^ scale(power(x), px))
        return {x: px ^ dy, y: dy}
    return None
