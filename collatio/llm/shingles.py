"""Sets of word shingles of whole texts, as sorted arrays of 64-bit hashes, vectorised over many texts.

Words are runs of bytes other than ``\\x20\\x09-\\x0D``, with A-Z in lower case. A set holds the hashes of all runs
of ``width`` words; a text with fewer words has its whole sequence as the one member, one without words none.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

from .common import slices, utf8

LOWER = np.arange(256, dtype=np.uint64) + 1
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, BASE, np.uint64), np.full(size, INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's words begin (and the end)."""
    blank = BLANK[data]
    left = np.ones(len(data), bool)
    left[1:] = blank[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    left[edges] = True
    starts = np.flatnonzero(~blank & left)
    # a word ends before a blank, at the end of its text, or at the end of the data
    right = np.ones(len(data), bool)
    right[:-1] = blank[1:]
    right[edges[edges > 0] - 1] = True
    ends = np.flatnonzero(~blank & right) + 1
    size = 1 << max(20, int(len(data)).bit_length())
    up, down = powers(size)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(LOWER[data] * up[: len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) << np.uint64(48))), np.searchsorted(starts, offsets)


def sets_of(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(all members, offsets): the sorted set of each text."""
    data, offsets = utf8(column)
    parts: list[np.ndarray] = []
    sizes = np.zeros(len(column), np.int64)
    for i, j in slices(offsets):
        at = offsets[i : j + 1] - offsets[i]
        if not at[-1]:
            continue
        words, first = word_hashes(data[offsets[i] : offsets[j]], at)
        n = max(0, len(words) - width + 1)
        runs = np.full(n, width, np.uint64)
        for k in range(width):
            runs = mix(runs + words[k : k + n] * np.uint64(2 * k + 3))
        for d in range(i, j):
            a, b = first[d - i], first[d - i + 1]
            if b - a >= width:
                x = np.unique(runs[a : b - width + 1])
            elif b > a:
                x = np.full(1, b - a, np.uint64)
                for k in range(b - a):
                    x = mix(x + words[a + k : a + k + 1] * np.uint64(2 * k + 3))
            else:
                continue
            parts.append(x)
            sizes[d] = len(x)
    ends = np.zeros(len(column) + 1, np.int64)
    np.cumsum(sizes, out=ends[1:])
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), ends


def set_ids(members: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes that name each set."""
    out = []
    for salt in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F):
        total = np.zeros(len(members) + 1, np.uint64)
        np.cumsum(mix(members ^ np.uint64(salt)), out=total[1:])
        out.append(mix((total[ends[1:]] - total[ends[:-1]]) ^ np.diff(ends).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def bitmap(x: np.ndarray) -> bytes:
    """A hashed bitmap with at least eight bits a member; a power of two, so larger ones fold onto smaller."""
    bits = np.zeros(1 << max(6, (8 * len(x) - 1).bit_length()), bool)
    bits[(x & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def fold(words: np.ndarray, size: int) -> np.ndarray:
    """A bitmap's 64-bit words as ``size`` words."""
    return np.bitwise_or.reduce(words.reshape(-1, size), axis=0)
