"""SetSketch of a text's word shingles: truncated minima on an exponential scale."""

from __future__ import annotations

import math

import numpy as np
import xxhash

SHINGLE = 5
REGISTERS = 256
BASE, RATE, TOP = 1.001, 20.0, 65534
BAND_ROWS, BANDS = 4, 32
#: Words whose hashes a task remembers; emptied when full.
REMEMBERED = 1_000_000
_CHUNK = 256
_POWERS = np.cumprod(np.full(SHINGLE, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sketcher:
    """Shingle sets and registers; made once per task."""

    def __init__(self):
        self.hashes = _Hashes()
        draw = np.random.Generator(np.random.PCG64(20240229))
        self.times = draw.integers(0, 1 << 32, REGISTERS, np.uint32) | np.uint32(1)
        self.flip = draw.integers(0, 1 << 32, REGISTERS, np.uint32)

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes of five-word shingles; a shorter text is one, a text without words none."""
        found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        n = len(found)
        if not n:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.hashes.__getitem__, found), np.uint64, n)
        if n < SHINGLE:
            return _mixed((h * _POWERS[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
        count = n - SHINGLE + 1
        sums = np.zeros(count, np.uint64)
        for k in range(SHINGLE):
            sums += h[k:k + count] * _POWERS[k]
        return np.unique(_mixed(sums))

    def registers(self, shingles: np.ndarray) -> np.ndarray:
        """floor(1 - log_b(least exponential value)) of each register, from 0 to TOP + 1; merges by maximum."""
        low, high = shingles.astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
        least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(shingles), _CHUNK):
            values = ((low[i:i + _CHUNK, None] ^ self.flip) * self.times) + high[i:i + _CHUNK, None]
            np.minimum(least, values.min(axis=0), out=least)
        exponential = -np.log1p(-(least + 0.5) / 4294967296.0) / RATE
        return np.clip(np.floor(1 - np.log(exponential) / math.log(BASE)), 0, TOP + 1).astype(np.uint16)


def digest(shingles: np.ndarray) -> bytes:
    """128 bits of a set, equal for equal sets."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


def overlap(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether 100 * intersection >= 75 * union."""
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 75 * (len(a) + len(b) - both)


_GRID = np.linspace(0.0, 1.0, 41)


def _less(x: np.ndarray) -> np.ndarray:
    """-log_b(1 - x (b - 1) / b), the probability scale of register differences."""
    return -np.log1p(-x * (BASE - 1) / BASE) / math.log(BASE)


def plausible(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, level: float = 0.75,
              slack: float = 9.0) -> np.ndarray:
    """Which pairs (rows of registers, set sizes) may have a similarity of `level` or more.

    The likelihood of the similarity J is that of the counts of registers that are larger, smaller and equal. A pair is
    dropped if its best J is below the level and the log-likelihood there is by more than `slack` above the best at or
    over the level: with 9, a similar pair is dropped about once in fifty thousand.
    """
    a, b = a.astype(np.int32), b.astype(np.int32)
    larger, smaller = (a > b).sum(1), (a < b).sum(1)
    equal = a.shape[1] - larger - smaller
    u, v = (n_a / (n_a + n_b))[:, None], (n_b / (n_a + n_b))[:, None]
    j = np.minimum(_GRID[None, :], np.minimum(u / v, v / u))
    p = np.clip(_less(u - v * j), 1e-12, 1)
    q = np.clip(_less(v - u * j), 1e-12, 1)
    same = np.clip(1 - p - q, 1e-12, 1)
    log = larger[:, None] * np.log(p) + smaller[:, None] * np.log(q) + equal[:, None] * np.log(same)
    over = np.where(j >= level - 1e-9, log, -np.inf).max(1)
    return over + slack >= log.max(1)
