"""Vectorised words of many texts: hashes of words and of runs of words.

Words are maximal runs of bytes other than ASCII white space, after A-Z became
a-z. A word's 64-bit hash is a polynomial in random values of its bytes, so all
words of a batch are hashed by a few numpy passes over its bytes.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20_240_229)
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[65:91] = _VALUE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {_BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), modulo 2**64, kept from call to call."""
    p = _powers[base]
    while len(p) < n:
        p = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
    _powers[base] = p if len(p) <= 1 << 20 else _powers[base]
    return p[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(texts: list[bytes], segment: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, text after text, and each text's word count.
    Bytes are worked on in segments that end between words."""
    data = np.frombuffer(b"\n".join([b"", *texts, b""]), np.uint8)
    gap = _SPACE[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    words, at = np.empty(len(starts), np.uint64), 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            first = starts[at] - 1
            upto = max(at + 1, int(np.searchsorted(ends, first + segment, side="right")))
            part = data[first : ends[upto - 1]]
            total = np.cumsum(_VALUE[part] * _power(_BASE, len(part)), dtype=np.uint64)
            s, e = starts[at:upto] - first, ends[at:upto] - first
            words[at:upto] = mix((total[e - 1] - total[s - 1]) * _power(_INVERSE, len(part))[s] + (e - s).astype(np.uint64))
            at = upto
    bounds = np.cumsum([len(t) + 1 for t in texts]) + 1 if texts else np.zeros(0, np.int64)
    upto = np.searchsorted(starts, bounds)
    return words, np.diff(np.r_[0, upto])


def shingle_hashes(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``k`` words of each text and their counts (with
    repeats); a text of fewer words, but at least one, has one run: all of it."""
    with np.errstate(over="ignore"):
        n = len(words)
        made = np.maximum(counts - k + 1, (counts > 0).astype(np.int64))
        if not n:
            return np.zeros(0, np.uint64), made
        padded = np.concatenate([words, np.zeros(k, np.uint64)])
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out = out * np.uint64(0xD6E8FEB86659FD93) + padded[j : j + n]
        out = mix(out)
        starts = np.cumsum(counts) - counts
        inside = np.arange(n) - np.repeat(starts, counts)
        keep = inside < np.repeat(made, counts)
        for i in np.flatnonzero((counts > 0) & (counts < k)):
            h = np.uint64(counts[i])
            for w in words[starts[i] : starts[i] + counts[i]]:
                h = mix(np.array([h * np.uint64(0xD6E8FEB86659FD93) + w]))[0]
            out[starts[i]] = h
        return out[keep], made


def distinct(values: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct values of each text."""
    ends = np.cumsum(counts)
    return [np.unique(values[e - c : e]) for e, c in zip(ends.tolist(), counts.tolist())]
