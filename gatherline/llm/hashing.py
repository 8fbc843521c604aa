"""Vectorised hashing of byte and word sequences: whole blocks of text at once, no loop over words.

A span of a sequence x is hashed as a polynomial modulo 2^64 with an odd base, from prefix sums; the base has an
inverse, so that the same span has the same hash wherever it stands.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Units that one sliding minimum covers; longer sequences are taken in overlapping slices.
_SLICE_BITS = 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1), kept for the next block."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, base, U)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64 bits (a bijection)."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def prefix_sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * _power(_BASE, len(values)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[begin:end] for each pair; position does not matter."""
    return (sums[end] - sums[begin]) * _power(_INVERSE, len(sums))[begin]


def gram_hash(values: np.ndarray, k: int) -> np.ndarray:
    """Mixed hash of every k consecutive values."""
    if len(values) < k:
        return np.zeros(0, U)
    sums = prefix_sums(values)
    return mix((sums[k:] - sums[:-k]) * _power(_INVERSE, len(sums))[: len(values) - k + 1])


def byte_values(buf: np.ndarray) -> np.ndarray:
    return _BYTE_VALUES[buf]


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of some texts: where they stand, their hashes, and the text each is in."""

    def __init__(self, texts: list[bytes]):
        self.data = b" ".join(texts)
        self.buf = np.frombuffer(self.data, np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_begin = np.concatenate(([0], np.cumsum(lengths + 1)))[: len(texts)]
        inside = np.zeros(len(self.buf) + 2, np.int8)
        inside[1:-1] = ~SPACE[self.buf]
        edges = np.flatnonzero(np.diff(inside))
        self.begin, self.end = edges[::2], edges[1::2]
        self.text = np.searchsorted(self.text_begin, self.begin, "right") - 1
        self.counts = np.bincount(self.text, minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.counts)))
        self.hash = mix(span_hash(prefix_sums(byte_values(self.buf)), self.begin, self.end)) if len(self.begin) else np.zeros(0, U)


def anchors(grams: np.ndarray, ok: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window the place of its least k-gram: equal windows have it at the same distance from their start.

    ``grams``: hash of each k-gram; ``ok[s]``: whether a window may start at s. Returns (place, first start, last
    start) of each run of windows with one anchor. About 2 in (window - k + 2) places become anchors, and each
    window has exactly one.
    """
    width, n = window - k + 1, len(ok)
    step = (1 << _SLICE_BITS) - window
    mask = U((1 << _SLICE_BITS) - 1)
    found = []
    for off in range(0, n, step):
        part = grams[off : min(off + step, n) + width - 1]
        low = (part & ~mask) | np.arange(len(part), dtype=U)
        reach = 1
        while reach * 2 <= width:
            low = np.minimum(low[reach:], low[:-reach])
            reach *= 2
        if reach < width:
            low = np.minimum(low[width - reach :], low[: len(low) - (width - reach)])
        starts = np.flatnonzero(ok[off : off + step][: len(low)])
        if not len(starts):
            continue
        place = (low[starts] & mask).astype(np.int64)
        cut = np.flatnonzero((np.diff(place) != 0) | (np.diff(starts) != 1)) + 1
        head, tail = np.concatenate(([0], cut)), np.concatenate((cut, [len(starts)])) - 1
        found.append((place[head] + off, starts[head] + off, starts[tail] + off))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def owner_of(keys: np.ndarray, owners: int) -> np.ndarray:
    """Which of ``owners`` equal ranges of the 64-bit space each key is in (grows with the key)."""
    return (((keys >> U(32)) * U(owners)) >> U(32)).astype(np.int32)


def gather(buf: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """buf[begin:begin+length] of all spans, one after another."""
    out = np.empty(int(length.sum()), buf.dtype)
    at = np.concatenate(([0], np.cumsum(length)))
    for a in range(0, len(begin), 2000):  # bounds the index
        n, b = length[a : a + 2000], begin[a : a + 2000]
        part = at[a : a + len(n) + 1]
        out[part[0] : part[-1]] = buf[np.arange(part[0], part[-1]) + np.repeat(b - part[:-1], n)]
    return out
