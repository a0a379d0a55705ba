"""Small kernels of the mark index: where structure may begin inside a piece of a medium, and checksums that add up over pieces.

A CRC-32 register that starts at zero is linear: that of a concatenation is the sum of its parts', each multiplied by a power of x for the
bytes behind it. Divided by the power of its own end, a part's value no longer depends on what follows, so values of pieces are combined by
exclusive or in any order, and the checksum of any range follows from the sums at its two ends.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np

#: bytes behind a mark that its rules read, and bytes before it: the checksum of the chunk before
LOOK, BACK = 24, 4
ONES = np.uint32(0xFFFFFFFF)
_POLY, _ORDER = np.uint32(0xEDB88320), (1 << 32) - 1

# fixed values: top-level boxes of media files; those that hold media
BOXES = (b"ftyp", b"moov", b"moof", b"mdat", b"free", b"skip", b"wide", b"uuid", b"sidx", b"styp", b"mfra", b"meta", b"pnot", b"emsg", b"prft", b"ssix")
MEDIA_BOXES = (b"moov", b"mdat", b"moof")
PNG_END_CRC = 0xAE426082


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo that of CRC-32, in its bit order."""
    a, b, out = np.broadcast_to(a, np.broadcast(a, b).shape), b.astype(np.uint32), np.zeros(np.broadcast(a, b).shape, np.uint32)
    for k in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(k) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), _POLY, np.uint32(0))
    return out


def _squares(base: np.ndarray, n: int) -> list[np.ndarray]:
    out = [base]
    for _ in range(n - 1):
        out.append(times(out[-1], out[-1]))
    return out


def _inverse_of_a_byte() -> np.ndarray:
    one, byte = np.uint32([1 << 31]), np.uint32([1 << 23])
    out, powers = one, _squares(byte, 32)
    for k in range(32):
        if (_ORDER - 1) >> k & 1:
            out = times(out, powers[k])
    return out


_BACK_BY = _squares(_inverse_of_a_byte(), 32)


def back(at: np.ndarray) -> np.ndarray:
    """x to the power of -8 ``at``: moves a value that ends at byte ``at`` to the beginning."""
    at = np.asarray(at, np.int64) % _ORDER
    out = np.full(at.shape, 1 << 31, np.uint32)
    for k in range(32):
        bit = at >> k & 1
        if bit.any():
            out = np.where(bit, times(out, _BACK_BY[k]), out)
    return out


def piece(start: np.ndarray, end: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """What the bytes [start, end) with the usual checksum ``crc`` add to the sum of all pieces before their end."""
    return times(back(end), np.asarray(crc, np.uint32) ^ ONES) ^ times(back(start), np.full(np.shape(start), ONES, np.uint32))


def opens(start: np.ndarray, at: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A range begins at ``at``; ``crc`` is that of [start, at). With the sum before ``start`` it equals ``closes`` of the range's true end."""
    return times(back(at), np.asarray(crc, np.uint32)) ^ times(back(start), np.full(np.shape(start), ONES, np.uint32))


def closes(start: np.ndarray, at: np.ndarray, crc: np.ndarray, stored: np.ndarray) -> np.ndarray:
    """A range ends at ``at`` and should have the checksum ``stored``."""
    return opens(start, at, np.asarray(crc, np.uint32) ^ np.asarray(stored, np.uint32))


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_PATTERNS = {"mp4": b"|".join(BOXES), "pdf": rb"%%EOF|startxref|endobj", "zip": rb"PK\x05\x06"}
#: what a mark of each kind of text is: its number in the index
PDF_MARK = {b"%%EOF": 0, b"startxref": 1, b"endobj": 2}


def _be(data: bytes, at: int, n: int) -> int:
    return int.from_bytes(data[at:at + n], "big")


def _le(data: bytes, at: int, n: int) -> int:
    return int.from_bytes(data[at:at + n], "little")


def png_places(data: bytes) -> np.ndarray:
    """Where a chunk may begin: a length below 2 ** 26 and four letters."""
    b = np.frombuffer(data, np.uint8)
    if len(b) < 8:
        return np.zeros(0, np.int64)
    letter = _LETTER[b]
    return np.flatnonzero((b[:-7] <= 3) & letter[4:-3] & letter[5:-2] & letter[6:-1] & letter[7:])


def find(kind: str, data: bytes, low: int, high: int) -> Iterator[tuple[int, int | None, int]]:
    """Marks of a kind that begin in [low, high): place, where the next one is expected (relative), and a flag."""
    if kind == "png":
        for at in png_places(data).tolist():
            if low <= at < high:
                size, end = _be(data, at, 4), data[at + 4:at + 8] == b"IEND"
                if not end:
                    yield at, at + 12 + size, 0
                elif size == 0 and _be(data, at + 8, 4) == PNG_END_CRC:
                    yield at, at + 12, 1
        return
    for m in re.finditer(_PATTERNS[kind], data):
        at = m.start() - (4 if kind == "mp4" else 0)
        if not low <= at < high:
            continue
        if kind == "mp4" and at >= 0:
            size, head = _be(data, at, 4), 8
            if size == 1:
                size, head = _be(data, at + 8, 8), 16
            if head <= size < 1 << 48 and (head == 8 or at + 16 <= len(data)):
                yield at, at + size, int(m[0] in MEDIA_BOXES)
        elif kind == "pdf":
            yield at, None, PDF_MARK[m[0]]
        elif kind == "zip" and at + 22 <= len(data):
            # the directory must lie before its end record; the record ends behind its comment
            yield at, at + 22 + _le(data, at + 20, 2), _le(data, at + 12, 4) + _le(data, at + 16, 4)


def sums(data: bytes, places: list[int], crc: int = 0) -> list[int]:
    """The usual checksum of data[:p] for ascending ``places``, continuing from ``crc``."""
    out, last = [], 0
    for p in places:
        crc = zlib.crc32(data[last:p], crc)
        out.append(crc)
        last = p
    return out
