"""Content-defined anchor positions for suffixes of byte or word sequences, with NumPy.

A block holds the sequences of several texts one after the other, with offsets, as bytes
(uint8) or as word hashes (uint64); no Python loop runs per text.
"""

from __future__ import annotations

import numpy as np

from lumenweave.llm import textops as X

_POS_BITS = 31
_POS = np.uint64((1 << _POS_BITS) - 1)


def gram(units: np.ndarray) -> int:
    """Units whose hash orders a position: 8 bytes or 2 words."""
    return 8 if units.dtype == np.uint8 else 2


def reach(length: int, size: int) -> int:
    """Positions among which a window's anchor is sought: half a window, less a gram of ``size``."""
    return max(1, length // 2 - size + 1)


def sliding_min(v: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every ``n`` consecutive values: prefix and suffix minima of blocks of ``n``."""
    m = len(v) - n + 1
    if m <= 0:
        return v[:0]
    pad = -len(v) % n
    blocks = np.concatenate([v, np.full(pad, np.iinfo(v.dtype).max, v.dtype)]).reshape(-1, n)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:m], ahead[n - 1 : n - 1 + m])


def gram_order(units: np.ndarray) -> np.ndarray:
    """A hash of the gram at each position, made unique by the position in its low bits (left first)."""
    m = len(units) - gram(units) + 1
    if units.dtype == np.uint8:
        g = np.ndarray((m,), "<u8", np.ascontiguousarray(units).data, 0, (1,)).astype(np.uint64)
    else:
        with np.errstate(over="ignore"):
            g = units[:-1] * X.SEQ[0] + units[1:] * X.SEQ[1]
    return (X.mix(g) & ~_POS) | (np.arange(m, dtype=np.uint64) & _POS)


def anchors(units: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all runs of ``length`` units inside the texts of a block.

    The anchor of the run that starts at s is the position of the least gram hash among
    s .. s + reach - 1, so equal runs have their anchor at an equal offset. Returns (text,
    anchor position in the block, lowest, highest offset anchor - s); each start belongs to
    exactly one anchor.
    """
    starts = len(units) - length + 1
    none = np.zeros(0, np.int64)
    if starts <= 0:
        return none, none, none, none
    assert len(units) <= int(_POS)
    inside = np.zeros(len(units) + 1, np.int32)
    long_enough = np.diff(offsets) >= length
    np.add.at(inside, offsets[:-1][long_enough], 1)
    np.add.at(inside, offsets[1:][long_enough] - length + 1, -1)
    s = np.flatnonzero(np.cumsum(inside[:starts]) > 0)
    if not len(s):
        return none, none, none, none
    at = (sliding_min(gram_order(units), reach(length, gram(units)))[s] & _POS).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [len(s)]]) - 1
    pos = at[first]
    return np.searchsorted(offsets, pos, side="right") - 1, pos, pos - s[last], pos - s[first]


def digests(units: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of the runs of ``size`` units at ``starts``, from one running polynomial sum."""
    return X.run_hashes(units, starts, size).view(np.int64)
