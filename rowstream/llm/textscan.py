"""Array-at-a-time text scanning over Arrow batches.

A batch of texts is taken as one byte buffer. Words, their hashes and the hashes of runs of words come from
whole-array arithmetic, so no Python statement runs per word. Slices bound the working memory: a slice holds
at most ``SLICE_BYTES`` of text or one text.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Large freed arrays go back to the system at once; Spark keeps idle workers, which else would hold on to them.
with contextlib.suppress(OSError, AttributeError):
    ctypes.CDLL(None).mallopt(-3, 8 << 20)  # the threshold above which the C library maps memory

SLICE_BYTES = 1 << 19

_ROOT = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (splitmix64), so that every bit depends on all of the input's."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ROOT))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the odd hash root modulo 2^64, and their inverses; what a slice needs is kept."""
    global _powers, _inverses
    if n <= len(_powers):
        return _powers[:n], _inverses[:n]
    size = max(n, SLICE_BYTES + 1)
    base = np.full(size, _ROOT, np.uint64)
    back = np.full(size, pow(_ROOT, -1, 1 << 64), np.uint64)
    base[0] = back[0] = 1
    np.cumprod(base, out=base)
    np.cumprod(back, out=back)
    if size <= SLICE_BYTES + 1:
        _powers, _inverses = base, back
    return base[:n], back[:n]


class Prefix:
    """Hashes of byte ranges of ``data`` from running sums, made for stretches of at most a slice or one range."""

    def __init__(self, data: np.ndarray) -> None:
        self.data = data

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """``start`` and ``end`` ascend."""
        out = np.empty(len(start), np.uint64)
        i = 0
        while i < len(start):
            low = int(start[i])
            j = max(i + 1, int(np.searchsorted(end, low + SLICE_BYTES, "right")))
            p, back = powers(int(end[j - 1]) - low + 1)
            sums = np.zeros(len(p), np.uint64)
            np.cumsum(BYTE_CODE[self.data[low : end[j - 1]]] * p[:-1], out=sums[1:])
            a, b = start[i:j] - low, end[i:j] - low
            out[i:j] = mix((sums[b] - sums[a]) * back[a] + (b - a).astype(np.uint64))
            i = j
        return out


class Slice:
    """Some texts of a batch: ``first`` is the row of its first text; ``data`` their bytes; ``bounds`` where each begins."""

    def __init__(self, first: int, data: np.ndarray, bounds: np.ndarray, valid: np.ndarray) -> None:
        self.first, self.data, self.bounds, self.valid = first, data, bounds, valid
        self.n = len(bounds) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts and ends of all words, and for each text the number of its first word (one more at the end)."""
        blank = IS_SPACE[self.data]
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.bounds] = True
        begins = ~blank
        begins[1:] &= blank[:-1] | edge[1:-1]
        ends = ~blank
        ends[:-1] &= blank[1:] | edge[1:-1]
        start = np.flatnonzero(begins)
        return start, np.flatnonzero(ends) + 1, np.searchsorted(start, self.bounds)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string column into slices of at most ``limit`` bytes or one text; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    valid = np.asarray(column.is_valid())
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield Slice(i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], valid[i:j])
        i = j


#: Odd multipliers that keep the order of a run's words.
_TURN = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def runs(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each position on (fewer than ``k`` words: an empty array); any k."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total = (total ^ mix(words[j : j + n] + _TURN[j % 64])) * _TURN[(j + 7) % 64]
    return mix(total)
