"""Vectorised hashes of words and of word windows, straight from a UTF-8 buffer."""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240229))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Two lanes: each has a random value for each byte and an odd multiplier with its inverse modulo 2**64.
_LANES = []
for _ in range(2):
    _r = int(_RNG.integers(1 << 62, dtype=np.uint64)) * 8 + 5
    _LANES.append((_RNG.integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1), np.uint64(_r), np.uint64(pow(_r, -1, 1 << 64))))
_PIECE = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and, for each row, its first word (n + 1)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    edge = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]  # a word ends with its row
    begins[edge] = inside[edge + 1]
    ends[edge - 1] = inside[edge]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lanes: int = 1) -> list[np.ndarray]:
    """One 64-bit hash a word and lane; pieces of half a megabyte bound the memory."""
    out = [np.zeros(len(starts), np.uint64) for _ in range(lanes)]
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _PIECE, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        for lane in range(lanes):
            values, r, inverse = _LANES[lane]
            total = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(values[data[lo:hi]] * _cached(lane, 0, hi - lo), out=total[1:])
            s = starts[i:j] - lo
            out[lane][i:j] = mix((total[ends[i:j] - lo] - total[s]) * _cached(lane, 1, hi - lo)[s])
        i = j
    return out


_CACHE: dict = {}


def _cached(lane: int, which: int, n: int) -> np.ndarray:
    if n > _PIECE + 4096:
        return _powers(_LANES[lane][1 + which], n)
    if (lane, which) not in _CACHE:
        _CACHE[lane, which] = _powers(_LANES[lane][1 + which], _PIECE + 4096)
    return _CACHE[lane, which][:n]


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9))


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` word hashes, by doubling; position i covers words i .. i + length - 1."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    level, size, out, done = words, 1, None, 0
    rest = length
    while rest:
        if rest & size:
            part = level[done : done + n]
            out = part if out is None else _pair(out, part)
            done += size
            rest -= size
        if rest:
            level = _pair(level[:-size], level[size:]) if len(level) > size else level[:0]
            size *= 2
    return out if length > 1 else mix(out.copy())
