"""Vectorised words and 64-bit word hashes of Arrow string columns.

A batch's texts lie in one byte buffer. Words are found and hashed with a few numpy passes
over that buffer, so the cost is some nanoseconds a byte and no Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE_VALUE = np.random.default_rng(20_011).integers(0, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_POWERS = {"up": np.ones(1, _U), "down": np.ones(1, _U)}


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every bit of the input reaches every bit of the output."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            x = np.full(size, base, dtype=_U)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"], _POWERS["down"]


def texts(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of slices of at most ``most`` bytes or one text; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.string()).fill_null("")
    if not len(column):
        return
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset:][:len(column) + 1]
    bounds = bounds.astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
        to = min(to, len(column))
        yield at, data[bounds[at]:bounds[to]], bounds[at:to + 1] - bounds[at]
        at = to


def spans(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACES
          ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; bytes marked in ``breaks`` and text ends part words."""
    word = ~breaks[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last[:-1] &= ~word[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of ``data``, the same wherever the span lies."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE_VALUE[data] * up[:len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(_U))


def shingles(words: np.ndarray, row: np.ndarray, rows: int, width: int
             ) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words and the bounds of each row's runs.

    A row with fewer words has its whole sequence as one run; a row without words has none.
    """
    count = np.bincount(row, minlength=rows)
    first = np.concatenate(([0], np.cumsum(count)))
    mult = mix(np.arange(1, width + 1, dtype=_U) * _U(_BASE)) | _U(1)
    n = len(words)
    acc = np.zeros(n, _U)
    for j in range(min(n, width)):
        acc[:n - j] += words[j:] * mult[j]
    runs = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    bounds = np.concatenate(([0], np.cumsum(runs)))
    which = np.repeat(np.arange(rows), runs)
    out = acc[first[which] + np.arange(bounds[-1]) - bounds[which]]
    for r in np.flatnonzero((count > 0) & (count < width)):
        k = int(count[r])
        whole = int((words[first[r]:first[r] + k] * mult[:k]).sum(dtype=_U)) + k * _BASE
        out[bounds[r]] = whole % 2**64
    return mix(out), bounds


def ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Positions first[i], first[i] + 1, ... (count[i] of them) for every i, in one array."""
    stop = np.cumsum(count)
    total = int(stop[-1]) if len(stop) else 0
    return np.arange(total) + np.repeat(first - (stop - count), count)
