"""Vectorised scans over the UTF-8 buffer of an Arrow string array.

Words, lines and n-grams are found and hashed for a whole batch at once with numpy, without
making a Python object per word. A batch is taken in chunks of at most ``max_bytes`` (a longer
text forms a chunk of its own), so memory follows the chunk and not the batch.

A byte range ``[a, b)`` hashes to ``sum(R[byte_j] * B**(j - a))`` modulo 2**64 with random 64-bit
``R`` and odd ``B``, then through a mixer, so prefix sums give the hash of any range.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def separator_table(spaces_only: bool = True) -> np.ndarray:
    """Which bytes end a word: space and 0x09-0x0D, or every ASCII byte but letters and digits."""
    table = np.zeros(256, bool)
    if spaces_only:
        table[[0x20, 9, 10, 11, 12, 13]] = True
    else:
        table[:128] = True
        for low, high in ((48, 58), (65, 91), (97, 123)):
            table[low:high] = False
    return table


SPACES = separator_table()
NON_ALNUM = separator_table(spaces_only=False)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    return np.random.default_rng(20240607).integers(0, 1 << 64, 256, dtype=U64)


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        steps = np.full(size, base, U64)
        steps[0] = 1
        have = _POWERS[base] = np.cumprod(steps, dtype=U64)
    return have[:n]


_INVERSE = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@lru_cache(maxsize=16)
def _gram_factors(n: int) -> np.ndarray:
    return np.random.default_rng(77 + n).integers(0, 1 << 63, n, dtype=U64) * U64(2) + U64(1)


@lru_cache(maxsize=2)
def _second_symbols() -> np.ndarray:
    return np.random.default_rng(90210).integers(0, 1 << 64, 256, dtype=U64)


def range_sums(data: np.ndarray, variant: int = 0):
    """A function of byte ranges of ``data`` to their hashes; variants are independent of one another."""
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((_second_symbols() if variant else _symbols())[data] * _powers(_BASE, len(data)), out=sums[1:])
    back = _powers(_INVERSE, len(data) + 1)
    return lambda start, end: mix64((sums[end] - sums[start]) * back[start])


class Chunk:
    """Rows ``lo`` to ``hi`` of a batch with their words; ``word_at[i]`` is the first word of row i."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lo: int, hi: int, seps: np.ndarray, fold: np.ndarray):
        self.lo, self.hi, self.bounds = lo, hi, bounds
        self.data = fold[data] if fold is not SAME else data
        solid = ~seps[self.data]
        n = len(data)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        if n:
            before[1:] = solid[:-1]
            after[:-1] = solid[1:]
            firsts = bounds[:-1][bounds[:-1] < n]
            before[firsts] = False
            lasts = bounds[1:][bounds[1:] > 0] - 1
            after[lasts] = False
        self.start = np.flatnonzero(solid & ~before)
        self.end = np.flatnonzero(solid & ~after) + 1
        self.solid = solid
        self.word_at = np.searchsorted(self.start, bounds)
        self._sums = None

    @property
    def rows(self) -> int:
        return self.hi - self.lo

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.word_at)

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a per-byte array over each row."""
        sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return sums[self.bounds[1:]] - sums[self.bounds[:-1]]

    def hash_ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if self._sums is None:
            self._sums = range_sums(self.data)
        return self._sums(start, end)

    def word_hashes(self) -> np.ndarray:
        return self.hash_ranges(self.start, self.end)

    def grams(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every n consecutive words inside a row, and where each row's grams begin."""
        counts = np.maximum(self.n_words - (n - 1), 0)
        at = np.concatenate(([0], np.cumsum(counts)))
        total = len(hashes) - (n - 1)
        if total <= 0:
            return np.zeros(0, U64), at
        mixed = np.zeros(total, U64)
        for k, factor in enumerate(_gram_factors(n)):
            mixed += hashes[k : k + total] * factor
        inside = np.zeros(len(hashes) + 1, np.int64)
        rows = np.flatnonzero(counts)
        np.add.at(inside, self.word_at[rows], 1)
        np.add.at(inside, self.word_at[rows] + counts[rows], -1)
        return mix64(mixed[np.cumsum(inside)[:total] > 0]), at


def chunks(texts: pa.Array, seps: np.ndarray = SPACES, fold: np.ndarray = SAME, max_bytes: int = 1 << 20) -> Iterator[Chunk]:
    """Chunks of a string array in row order; null and empty texts have no words."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_large_string(texts.type):
        wide = np.int64
    else:
        texts, wide = texts.cast(pa.string()), np.int32
    n = len(texts)
    if not n:
        return
    buffers = texts.buffers()
    at = np.frombuffer(buffers[1], wide)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(at, at[lo] + max_bytes, "right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield Chunk(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], lo, hi, seps, fold)
        lo = hi


def list_array(values: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32), pa.int32()), pa.array(values, kind))
