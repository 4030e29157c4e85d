"""Hashes of many substrings of one text from a running polynomial over its code points."""

from functools import lru_cache

import numpy as np

#: The base of the hash (any odd number).
BASE = 0x2545F4914F6CDD1D


def mixed(x: np.ndarray) -> np.ndarray:
    """Each number spread over 64 bits; zero does not stay zero."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ x >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** k and BASE ** -k modulo 2 ** 64 for k below n."""
    up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Running:
    """Running sums over a text; ``of`` hashes the substrings [low, high) by their content alone."""

    def __init__(self, text: str, least: int = 1 << 16):
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        up, self.down = _powers(1 << max(least, len(chars) + 1).bit_length())
        self.total = np.zeros(len(chars) + 1, np.uint64)
        np.cumsum(mixed(chars) * up[: len(chars)], out=self.total[1:])

    def of(self, low: np.ndarray, high: np.ndarray, seed: np.ndarray | np.uint64) -> np.ndarray:
        return mixed((self.total[high] - self.total[low]) * self.down[low] + seed)
