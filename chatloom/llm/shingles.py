"""Hashes of words and word shingles, computed on the bytes of many texts at once."""

import functools

import numpy as np

from chatloom.llm.columns import LOWER, SPACE

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


@functools.lru_cache(maxsize=1)
def _byte_values():
    values = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    values[SPACE] = 0
    return values[LOWER]


@functools.lru_cache(maxsize=4)
def _powers(size, base):
    """1, base, base^2, ... modulo 2^64."""
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mix(x):
    """Spread the bits of 64-bit numbers; a bijection."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def word_hashes(data, ends):
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, and their ends by text.

    ``data`` holds the texts behind one another and ``ends`` where each of them ends.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    word = ~SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = ends[:-1][ends[:-1] < len(data)]
    first[inner] = word[inner]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    size = 1 << int(len(data)).bit_length()
    sums = np.add.reduceat(_byte_values()[data] * _powers(size, _ODD)[:len(data)], starts)
    return mix(sums * _powers(size, _INVERSE)[starts]), np.searchsorted(starts, ends)


def shingle_sets(data, ends, width):
    """Per text the sorted distinct hashes of its runs of ``width`` words.

    A text of fewer words has its whole word sequence as one shingle; without words the set is empty.
    """
    words, stops = word_hashes(data, ends)
    weights = _powers(64, 0xC2B2AE3D27D4EB4F | 1)
    runs = max(0, len(words) - width + 1)
    sums = np.full(runs, width, np.uint64)
    for k in range(width):
        sums += words[k:k + runs] * weights[k + 1]
    sums = mix(sums)
    out, start = [], 0
    for stop in stops.tolist():
        n = stop - start
        if n >= width:
            out.append(np.unique(sums[start:stop - width + 1]))
        elif n:
            short = np.uint64(n) + (words[start:stop] * weights[1:n + 1]).sum(dtype=np.uint64)
            out.append(mix(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        start = stop
    return out
