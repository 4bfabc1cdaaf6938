"""Hashes of sliding windows, over numpy arrays."""

from __future__ import annotations

import numpy as np

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    x = (x + _MULT).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    if n:
        p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


class Windows:
    """Hashes of all windows of a fixed width over sequences of 64-bit values; the powers are kept between calls."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, dtype=np.uint64)

    def _total(self, values: np.ndarray) -> np.ndarray:
        n = len(values)
        if len(self.up) <= n:
            self.up, self.down = _powers(_BASE, 2 * n + 1), _powers(_INVERSE, 2 * n + 1)
        return np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(values) * self.up[:n], dtype=np.uint64)])

    def __call__(self, values: np.ndarray, width: int) -> np.ndarray:
        n = len(values)
        if n < width:
            return np.zeros(0, dtype=np.uint64)
        total = self._total(values)
        return mix((total[width:] - total[:-width]) * self.down[: n - width + 1])

    def spans(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the spans from each start to its end."""
        total = self._total(values)
        return mix((total[ends] - total[starts]) * self.down[starts])


def code_points(text: str) -> np.ndarray:
    """The text's code points, one per character."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


def winnow(hashes: np.ndarray, width: int) -> np.ndarray:
    """Positions of the rightmost smallest hash of every ``width`` consecutive ones, each once; with fewer hashes, of all of them."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    if n <= width:
        return np.array([n - 1 - int(hashes[::-1].argmin())])
    view = np.lib.stride_tricks.sliding_window_view(hashes, width)
    at = width - 1 - view[:, ::-1].argmin(1) + np.arange(n - width + 1)
    return np.unique(at)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` consecutive values, by doubling."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values
