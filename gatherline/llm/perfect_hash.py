"""Minimal perfect hash of distinct 64-bit keys: levels of bit arrays, the rank of a key's bit is its slot.

At each level every remaining key hashes to a place in an array of about twice as many bits; places that exactly one
key has are set, and the others' keys go on to the next level. About four bits a key in all.
"""

from __future__ import annotations

import numpy as np

from .hashing import U, mix

#: Bits of a level for each key that is left, and at least.
ROOM, LEAST = 2.0, 64
_STEP = 0x9E3779B97F4A7C15

#: (sizes of the levels in bits, all bits as words, number of set bits before each word)
Levels = tuple[np.ndarray, np.ndarray, np.ndarray]


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    h = mix(keys ^ U((level + 1) * _STEP & 0xFFFFFFFFFFFFFFFF))
    return (((h >> U(32)) * U(size)) >> U(32)).astype(np.int64)


def build(keys: np.ndarray) -> Levels:
    """Levels for distinct keys."""
    sizes, parts, rest = [], [], np.asarray(keys, U)
    while len(rest):
        size = -(-max(LEAST, int(ROOM * len(rest))) // 64) * 64
        place = _places(rest, len(sizes), size)
        alone = np.bincount(place, minlength=size)[place] == 1
        flags = np.zeros(size, np.uint8)
        flags[place[alone]] = 1
        parts.append(np.packbits(flags, bitorder="little").view("<u8"))
        sizes.append(size)
        rest = rest[~alone]
    words = np.concatenate(parts) if parts else np.zeros(0, "<u8")
    before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))[: len(words)]
    return np.array(sizes, np.int64), words, before.astype(np.uint32)


def slots(levels: Levels, keys: np.ndarray) -> np.ndarray:
    """The slot of each key, 0 to n - 1; any slot or -1 for a key that was not built in."""
    sizes, words, before = levels
    out = np.full(len(keys), -1, np.int64)
    rest, base = np.arange(len(keys)), 0
    for level, size in enumerate(sizes.tolist()):
        if not len(rest):
            break
        place = _places(keys[rest], level, size) + base
        word, bit = words[place >> 6], (place & 63).astype(U)
        hit = (word >> bit) & U(1) == U(1)
        below = np.bitwise_count(word[hit] & ((U(1) << bit[hit]) - U(1)))
        out[rest[hit]] = before[place[hit] >> 6].astype(np.int64) + below
        rest, base = rest[~hit], base + size
    return out
