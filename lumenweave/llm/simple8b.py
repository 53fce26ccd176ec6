"""Simple-8b words: a selector of 4 bits tells how many values of how many bits the other 60 hold.

Values are cut into blocks of ``BLOCK``; a block starts with a word of its own, so blocks decode
independently and all at once. A slot of 4 to 30 bits that holds ones alone is an escape: its
value stands in a list of 32-bit values, in order. So one large value doesn't thin out its word.
Each word takes the selector of the fewest bits a value, escapes included.
"""

from __future__ import annotations

import numpy as np

COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
BLOCK = 256
_LIMITS = np.where((WIDTHS >= 4) & (WIDTHS <= 30), (1 << WIDTHS) - 1, 1 << WIDTHS)
_NO_ESCAPE = (WIDTHS < 4) | (WIDTHS > 30)
#: Blocks priced at once, so that their work arrays stay in cache.
_SLAB = 256


def _choose(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and selector of every word of the rows of ``v``, each a block: the fewest bits a value, first selector on ties."""
    rows, top = len(v), int(v.max())
    best, least = np.full((rows, BLOCK), len(COUNTS) - 1, np.int8), np.full((rows, BLOCK), 64, np.float32)
    for s, (count, limit) in enumerate(zip(COUNTS[:-1].tolist(), _LIMITS[:-1].tolist())):
        fits = v < np.uint32(limit)
        # a selector is tried in blocks of which a quarter fits into it
        mine = np.flatnonzero(np.count_nonzero(fits, axis=1) >= BLOCK // 4)
        if not len(mine):
            continue
        over, cut = np.zeros((len(mine), BLOCK + 1), np.int16), max(BLOCK - count, 0)
        np.cumsum(~fits[mine], axis=1, dtype=np.int16, out=over[:, 1:])
        escapes = -over[:, :-1]
        escapes[:, :cut] += over[:, count : count + cut]
        escapes[:, cut:] += over[:, -1:]
        price = escapes.astype(np.float32) * 32 + 64 if not _NO_ESCAPE[s] else np.where(escapes > 0, np.float32(np.inf), np.float32(64))
        price *= (1 / np.minimum(count, BLOCK - np.arange(BLOCK))).astype(np.float32)
        few = least[mine]
        better = price < few
        least[mine] = np.where(better, price, few)
        best[mine] = np.where(better, np.int8(s), best[mine])
        if top < limit:
            break  # all fit, and later selectors hold fewer
    at, live = np.zeros(rows, np.int64), np.arange(rows)
    starts, chosen = [], []
    while len(live):
        pick = best[live, at[live]]
        starts.append(live * BLOCK + at[live])
        chosen.append(pick)
        at[live] += COUNTS[pick]
        live = live[at[live] < BLOCK]
    start = np.concatenate(starts)
    order = np.argsort(start)
    return start[order], np.concatenate(chosen)[order]


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (uint64), escapes (uint32), and each block's first word and first escape (uint32)."""
    v = np.asarray(values)
    n = len(v)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    if v.min() < 0 or int(v.max()) >> 32:
        raise ValueError("values must be unsigned integers of 32 bits")
    v = v.astype(np.uint32)
    first = np.arange(0, n, BLOCK)
    full = np.zeros(len(first) * BLOCK, np.uint32)
    full[:n] = v
    full = full.reshape(-1, BLOCK)
    parts = [_choose(full[k : k + _SLAB]) for k in range(0, len(full), _SLAB)]
    start = np.concatenate([a + k * _SLAB * BLOCK for k, (a, _) in enumerate(parts)])
    selector = np.concatenate([b for _, b in parts]).astype(np.int64)[start < n]
    start = start[start < n]
    size = np.diff(np.append(start, n))
    limit = np.repeat(np.minimum(_LIMITS, (1 << 32) - 1)[selector].astype(np.uint32), size)
    escaped = (v >= limit) & ~np.repeat(_NO_ESCAPE[selector], size)
    shift = (np.arange(n) - np.repeat(start, size)) * np.repeat(WIDTHS[selector], size)
    value = np.where(escaped, limit, v).astype(np.uint64) << shift.astype(np.uint64)
    words = np.bitwise_or.reduceat(value, start) | (selector.astype(np.uint64) << np.uint64(60))
    return words, v[escaped], np.searchsorted(start, first).astype(np.uint32), np.concatenate([[0], np.cumsum(escaped)])[first].astype(np.uint32)


def unpack(words: np.ndarray, escapes: np.ndarray, first_word: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values (uint32) of whole blocks whose first words stand at ``first_word``."""
    out = np.zeros(n, np.int64)
    if not n:
        return out.astype(np.uint32)
    selector = (words >> np.uint64(60)).astype(np.int64)
    before = np.concatenate([[0], np.cumsum(COUNTS[selector])])
    first_word = first_word.astype(np.int64)
    block = np.repeat(np.arange(len(first_word)), np.diff(np.append(first_word, len(words))))
    start = block * BLOCK + before[:-1] - before[first_word][block]
    stop = np.minimum(np.minimum(start + COUNTS[selector], (block + 1) * BLOCK), n)
    escaped = np.zeros(n, bool)
    for s in np.unique(selector):
        width, mine = int(WIDTHS[s]), np.flatnonzero(selector == s)
        for k in range(int(COUNTS[s]) if width else 0):
            some = mine[start[mine] + k < stop[mine]]
            if not len(some):
                break
            x = ((words[some] >> np.uint64(k * width)) & np.uint64((1 << width) - 1)).astype(np.int64)
            out[start[some] + k] = x
            if not _NO_ESCAPE[s]:
                escaped[start[some] + k] = x == _LIMITS[s]
    out[escaped] = escapes
    return out.astype(np.uint32)
