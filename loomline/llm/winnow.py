"""Winnowing: rolling k-gram hashes and the least of every window, rightmost on ties.

Any two sequences that share a span of window + k - 1 items select a common
(hash) in it; the positions are kept, so a hit can be located and extended.
"""

import numpy as np

BASE = 0x9E3779B97F4A7C15
LOW = np.uint64(0xFFFFFFFF)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of polynomial hashes, so that small hashes are random grams."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def gram_hashes(items: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive items (uint64); fewer than k items make one gram."""
    h = items.astype(np.uint64)
    if not len(h):
        return h
    k = min(k, len(h))
    out, done = None, 0
    power, size, square = h, 1, BASE  # power: hashes of `size` items; square: BASE ** size
    while size <= k:
        if k & size:
            n = len(h) - (done + size) + 1
            out = power[:n].copy() if out is None else out[:n] * np.uint64(square) + power[done : done + n]
            done += size
        if 2 * size <= k:
            n = len(power) - size
            power = power[:n] * np.uint64(square) + power[size : size + n]
        square, size = square * square % 2**64, size * 2
    return mixed(out)


def select(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least hash of each window of consecutive hashes, ascending."""
    n = len(hashes)
    if not n:
        return np.empty(0, np.int64)
    window = min(window, n)
    # high half: the hash; low half: smaller to the right, so ties go to the rightmost
    key = (hashes >> np.uint64(32) << np.uint64(32)) | (LOW - np.arange(n, dtype=np.uint64))
    size = 1
    while 2 * size <= window:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    rest = window - size
    if rest:
        key = np.minimum(key[:-rest], key[rest:])
    at = (LOW - (key & LOW)).astype(np.int64)
    return at[np.r_[True, at[1:] != at[:-1]]]
