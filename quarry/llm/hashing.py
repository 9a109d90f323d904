"""Word and window hashes as numpy arrays of unsigned 64-bit numbers."""

from __future__ import annotations

import numpy as np
import xxhash

# odd multipliers of the mixing step (fixed values)
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
S1, S2 = np.uint64(32), np.uint64(29)
WINDOWS_64 = np.uint64(0x632BE59BD9B4E019)


def words(text: str | None) -> list[bytes]:
    """Maximal runs of characters other than space and \\x09-\\x0D, as UTF-8 (bytes.split cuts exactly there)."""
    return text.encode().split() if text else []


def word_hashes(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two, order kept."""
    x = a * M1 + b
    x ^= x >> S1
    x *= M2
    x ^= x >> S2
    x *= M1
    x ^= x >> S1
    return x


def window_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all windows of ``length`` consecutive elements, put together by doubling."""
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, at, size, cur = None, 0, 1, h
    while True:
        if length & size:
            out = cur[at:at + n].copy() if out is None else mix(out, cur[at:at + n])
            at += size
        if size * 2 > length:
            return out
        cur = mix(cur[:-size], cur[size:])
        size *= 2


def _sliding(op, x: np.ndarray, w: int) -> np.ndarray:
    size, cur = 1, x
    while size * 2 <= w:
        cur = op(cur[:-size], cur[size:])
        size *= 2
    return cur if size == w else op(cur[:len(x) - w + 1], cur[w - size:])


def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """Mask of the positions that hold the minimum of some ``w`` consecutive positions (ties all count).

    The choice depends on the ``w`` values alone, so two equal stretches choose the same places."""
    if len(h) <= w:
        return h == h.min() if len(h) else np.zeros(0, bool)
    low = _sliding(np.minimum, h, w)
    padded = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)])
    return _sliding(np.maximum, padded, w) == h
