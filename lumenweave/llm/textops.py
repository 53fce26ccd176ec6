"""Vectorised tokenising and hashing of Arrow string columns with NumPy.

A block of documents is one byte buffer with offsets. Token boundaries come from a
256-entry class table; token hashes from differences of one running polynomial sum,
so no Python loop runs per token.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_rng = np.random.Generator(np.random.PCG64(20240613))
_LUT = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Odd multipliers of the members of a word sequence.
SEQ = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Bytes handled at once: the 64-bit work arrays of a block then stay in cache.
BLOCK_BYTES = 1 << 19
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public SplitMix64 constants)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def give_back() -> None:
    """Return freed memory of this worker to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = max(n, BLOCK_BYTES + 1)
        with np.errstate(over="ignore"):
            for key, base in (("up", _P), ("down", _P_INV)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _powers[key] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def string_blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (first row, bytes, offsets) for runs of rows of about ``block_bytes``; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + block_bytes, side="right")) - 1
        stop = min(n, max(stop, row + 1))
        yield row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def tokens(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased (A-Z) tokens of a block, and the number of tokens of each row."""
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(rows, np.int64)
    word = ~separators[data]
    first = np.zeros(len(data), bool)
    inner = offsets[:-1]
    first[inner[inner < len(data)]] = True
    starts_mask = word.copy()
    starts_mask[1:] &= ~word[:-1] | first[1:]
    ends_mask = word
    ends_mask[:-1] &= ~word[1:] | first[1:]
    starts, ends = np.flatnonzero(starts_mask), np.flatnonzero(ends_mask) + 1
    up, down = _pow(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.empty(len(data) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_LUT[LOWER[data]] * up[: len(data)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * down[starts]
        h = mix(h + (ends - starts).astype(np.uint64) * SEQ[63])
    edges = np.searchsorted(starts, offsets)
    return h, np.diff(edges)


def run_hashes(units: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` consecutive bytes (uint8) or word hashes (uint64) from each of ``starts``."""
    up, down = _pow(len(units) + 1)
    with np.errstate(over="ignore"):
        sums = np.empty(len(units) + 1, np.uint64)
        sums[0] = 0
        np.cumsum((_LUT[units] if units.dtype == np.uint8 else units) * up[: len(units)], out=sums[1:])
        return mix((sums[starts + size] - sums[starts]) * down[starts])


def sequences(h: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``n`` tokens inside each row, and their number per row."""
    per_row = np.maximum(counts - n + 1, 0)
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(len(counts), np.int64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            out += h[k : len(h) - n + 1 + k] * SEQ[k]
        out = mix(out)
    last = np.repeat(np.cumsum(counts), counts)[: len(out)]
    return out[np.arange(len(out)) + n <= last], per_row
