"""Hashed word shingles of whole texts, computed on the bytes of Arrow columns.

Words are runs of bytes outside 0x20 and 0x09-0x0D with A-Z lower-cased. The hash of a word is a
polynomial over random 64-bit values of its bytes, taken from running sums, then mixed; a shingle's hash
mixes the hashes of its words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .arrowio import buffers

_rng = np.random.default_rng(20240607)
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE[65:91] = BYTE[97:123]
GAP = np.zeros(256, bool)
GAP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(int(BASE), -1, 2**64))
PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, UNBASE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def words(texts: pa.Array, gap: np.ndarray = GAP) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, offsets of each text's words)."""
    data, ends = buffers(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    inside = ~gap[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[ends[:-1][ends[:-1] < len(data)]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    last = ends[1:] - 1
    after[last[last >= 0]] = False
    stop = np.flatnonzero(inside & ~after)
    up, down = _power(len(data))
    run = np.cumsum(BYTE[data] * up)
    value = run[stop] - np.where(start > 0, run[np.maximum(start, 1) - 1], np.uint64(0))
    return mix(value * down[start]), np.searchsorted(start, ends).astype(np.int64)


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words has its whole sequence as one."""
    hashes, at = words(texts)
    n = len(hashes)
    if n >= size:
        sums = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            sums += hashes[k : n - size + 1 + k] * PLACE[k]
        sums = mix(sums)
    out = []
    for i in range(len(at) - 1):
        first, end = at[i], at[i + 1]
        if end - first >= size:
            values = np.sort(sums[first : end - size + 1])
            out.append(values[np.concatenate(([True], values[1:] != values[:-1]))])
        elif end > first:
            few = hashes[first:end]
            out.append(mix(np.array([(few * PLACE[: len(few)]).sum() + np.uint64(len(few))], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
