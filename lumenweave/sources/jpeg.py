"""Baseline JPEG of 8-bit images in NumPy: full colour resolution, Huffman codes made for each image."""

from __future__ import annotations

import heapq
import struct

import numpy as np

# fixed values: the standard's example quantisation tables, row by row
LUMINANCE = [
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]
CHROMINANCE = [
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
]
#: Colour transform to luminance and two differences; fixed values.
YCC = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])
#: Places of a block by diagonals, each second one upwards.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


def _tables(quality: int) -> list[np.ndarray]:
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    return [np.clip((np.array(t) * scale + 50) // 100, 1, 255).astype(int) for t in (LUMINANCE, CHROMINANCE)]


def code_lengths(counts: dict[int, int]) -> list[tuple[int, int]]:
    """(symbol, bits) of a Huffman code of at most 16 bits, shortest first, whose last code is left free."""
    while True:
        heap = [(n, i, [s]) for i, (s, n) in enumerate([*counts.items(), (-1, 0)])]
        heapq.heapify(heap)
        bits, fresh = dict.fromkeys([*counts, -1], 0), len(heap)
        while len(heap) > 1:
            (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            for s in x + y:
                bits[s] += 1
            heapq.heappush(heap, (a + b, fresh, x + y))
            fresh += 1
        if max(bits.values()) <= 16:
            return [(s, n) for s, n in sorted(bits.items(), key=lambda e: (e[1], e[0] == -1, e[0])) if s != -1]
        counts = {s: n // 2 + 1 for s, n in counts.items()}  # a flatter distribution has shorter codes


def _size(v: np.ndarray) -> np.ndarray:
    """Bits of |v|."""
    return np.ceil(np.log2(np.abs(v) + 1)).astype(np.int64)


def _events(z: np.ndarray, dc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all blocks in turn (those of AC from 256 on), their extra bits and how many."""
    rows, at = np.nonzero(z[:, 1:])
    at = at + 1
    before = np.concatenate([[0], at[:-1]])
    before[np.concatenate([[True], rows[1:] != rows[:-1]])[: len(rows)]] = 0
    run, v = at - before - 1, z[rows, at]
    last = np.zeros(len(z), np.int64)
    np.maximum.at(last, rows, at)
    long = np.repeat(np.arange(len(rows)), run // 16)
    nth = np.arange(len(long)) - np.repeat(np.cumsum(run // 16) - run // 16, run // 16)
    ends = np.flatnonzero(last < 63)
    key = [np.arange(len(z)) * 8192, rows * 8192 + at * 64 + 63, rows[long] * 8192 + at[long] * 64 + nth, ends * 8192 + 64 * 64]
    symbol = [_size(dc), 256 + (run % 16) * 16 + _size(v), np.full(len(long), 256 + 0xF0), np.full(len(ends), 256)]
    none = lambda x: np.zeros(len(x), np.int64)
    value, many = [dc, v, none(long), none(ends)], [_size(dc), _size(v), none(long), none(ends)]
    order = np.argsort(np.concatenate(key), kind="stable")
    value, many = np.concatenate(value)[order], np.concatenate(many)[order]
    return np.concatenate(symbol)[order], np.where(value < 0, value + (1 << many) - 1, value), many


def encode_jpeg(channels: np.ndarray, quality: int = 95) -> bytes:
    """JPEG bytes of an (h, w, c) array of 8-bit values; c is 1 or 3."""
    h, w, c = channels.shape
    planes = channels.astype(float)
    if c == 3:
        planes = planes @ YCC.T + np.array([0, 128, 128])
    planes = np.pad(planes, ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge") - 128
    d = np.cos((2 * np.arange(8) + 1)[None, :] * np.arange(8)[:, None] * np.pi / 16) / 2
    d[0] /= np.sqrt(2)
    quant = _tables(quality)
    blocks = planes.reshape(planes.shape[0] // 8, 8, -1, 8, c).transpose(0, 2, 4, 1, 3).reshape(-1, c, 8, 8)
    found = d @ blocks @ d.T
    z = np.stack([np.rint(found[:, k].reshape(-1, 64) / quant[min(k, 1)])[:, ZIGZAG] for k in range(c)], 1).astype(np.int64)
    dc = np.diff(z[:, :, 0], axis=0, prepend=0)
    symbol, extra, many = _events(z.reshape(-1, 64), dc.reshape(-1))
    code, bits, codes = np.zeros(512, np.int64), np.zeros(512, np.int64), []
    for kind in (0, 1):
        kinds, n = np.unique(symbol[(symbol >= 256) == kind] & 255, return_counts=True)
        made = code_lengths(dict(zip(kinds.tolist(), n.tolist())))
        now, before = 0, 0
        for s, length in made:
            now <<= length - before
            code[kind * 256 + s], bits[kind * 256 + s], before = now, length, length
            now += 1
        codes.append(bytes([kind << 4]) + bytes(sum(b == k for _, b in made) for k in range(1, 17)) + bytes(s for s, _ in made))
    length = bits[symbol] + many
    value = (code[symbol] << many) | extra
    place = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    stream = ((np.repeat(value, length) >> (np.repeat(length, length) - 1 - place)) & 1).astype(np.uint8)
    stream = np.packbits(np.concatenate([stream, np.ones(-len(stream) % 8, np.uint8)])).tobytes().replace(b"\xff", b"\xff\x00")

    def part(mark: int, body: bytes) -> bytes:
        return struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body

    ids = range(1, c + 1)
    head = [part(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")] + [part(0xDB, bytes([k]) + bytes(quant[k][ZIGZAG].tolist())) for k in range(min(c, 2))]
    head.append(part(0xC0, struct.pack(">BHHB", 8, h, w, c) + b"".join(bytes([i, 0x11, min(i - 1, 1)]) for i in ids)))
    head += [part(0xC4, t) for t in codes]
    head.append(part(0xDA, bytes([c]) + b"".join(bytes([i, 0]) for i in ids) + b"\0\x3f\0"))
    return b"\xff\xd8" + b"".join(head) + stream + b"\xff\xd9"
