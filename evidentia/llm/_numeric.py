"""Rolling hashes of bytes in numpy, for worker tasks."""

from __future__ import annotations

import numpy as np

#: Bytes that are hashed together.
BLOCK = 2_000_000

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Roller:
    """Hashes of stretches of a buffer, each from the sums up to its ends: sum of byte * base^-place, times base^start."""

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def _grow(self, n: int):
        if len(self.up) < n:
            for name, b in (("up", _BASE), ("down", _INVERSE)):
                powers = np.full(n, b, np.uint64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.down[: len(data)], out=out[1:])
        return out

    def hashes(self, sums: np.ndarray, starts, ends) -> np.ndarray:
        return mix((sums[ends] - sums[starts]) * self.up[starts])


def blocks(items: list[bytes], limit: int = BLOCK):
    """(first, items) of some `limit` bytes together, of one item at least."""
    at = total = 0
    for k, x in enumerate(items):
        total += len(x)
        if total >= limit:
            yield at, items[at : k + 1]
            at, total = k + 1, 0
    if at < len(items):
        yield at, items[at:]
