"""Information flow of a small image inside a task: the same terms as ``affinity.information_flow_system``."""

from __future__ import annotations

import numpy as np
import pandas as pd

from lumenweave.functions.pixel import sym3_cofactors
from lumenweave.operators import kernels
from lumenweave.operators.grid import NINE
from lumenweave.operators.neighbors import nearest_in_memory, rebuilding_weights

_PAIRS = [(a, b) for a in range(3) for b in range(a, 3)]
Entries = tuple[np.ndarray, np.ndarray, np.ndarray]


def _open(t: np.ndarray) -> np.ndarray:
    return ~((t > 0.8) | (t < 0.2))


def _features(frame: pd.DataFrame, xy: float) -> np.ndarray:
    x, y, w, h = (frame[c].to_numpy() for c in "xywh")
    return np.column_stack([frame[["r", "g", "b"]].to_numpy(), xy * (x + 1) / w, xy * (y + 1) / h])


def _inverse(c: np.ndarray, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Cofactors (n, 3, 3) and determinants of symmetric matrices (n, 3, 3) plus ``ridge`` on the diagonal."""
    cells, det = sym3_cofactors({"rgb"[a] + "rgb"[b]: c[:, a, b] + (ridge if a == b else 0.0) for a, b in _PAIRS})
    out = np.empty(c.shape)
    for a, b in _PAIRS:
        out[:, a, b] = out[:, b, a] = cells["rgb"[a] + "rgb"[b]]
    return out, det


def _moments(v: np.ndarray, w: int, h: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Taps (n, 9) of the clamped 3x3 windows with exact integer sums (n, 3) and 9 * products - product of sums (n, 3, 3)."""
    y, x = np.divmod(np.arange(w * h), w)
    tap = np.stack([np.clip(x + dx, 0, w - 1) + np.clip(y + dy, 0, h - 1) * w for dx, dy in NINE], 1)
    near = v[tap]
    s = near.sum(1)
    return tap, s, 9 * np.einsum("npa,npb->nab", near, near) - s[:, :, None] * s[:, None, :]


def _laplacian(i: np.ndarray, j: np.ndarray, v: np.ndarray, n: int, k: float = 1.0) -> Entries:
    d, some = np.bincount(i, weights=v, minlength=n), np.flatnonzero(np.bincount(i, minlength=n))
    d = np.where(np.abs(d) < 1e-10, 1e-10, d)
    return np.concatenate([some, i]), np.concatenate([some, j]), k * np.concatenate([d[some], -v])


def _mixture(frame: pd.DataFrame, unknown: np.ndarray, k: int = 20) -> Entries:
    """Terms of M'M, M the Laplacian of the weights that rebuild unknown colours."""
    f = _features(frame, 1.0)
    near, q = nearest_in_memory(f[unknown], f, k), np.flatnonzero(unknown)
    w = rebuilding_weights(f[near, :3] - f[q, None, :3])
    at, v = np.column_stack([q, near]), np.column_stack([w.sum(1), -w])
    shape = (len(q), at.shape[1], at.shape[1])
    return np.broadcast_to(at[:, :, None], shape).ravel(), np.broadcast_to(at[:, None, :], shape).ravel(), (v[:, :, None] * v[:, None, :]).ravel()


def _local(moments: tuple[np.ndarray, np.ndarray, np.ndarray], v: np.ndarray, unknown: np.ndarray, w: int, h: int, epsilon: float = 1e-6) -> Entries:
    """Laplacian of the closed-form weights over inner windows near unknown pixels, row-normalised."""
    tap, s, c = moments
    y, x = np.divmod(np.arange(w * h), w)
    some = unknown[tap].any(1) & (x >= 1) & (x < w - 1) & (y >= 1) & (y < h - 1)
    if not some.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    tap, (inverse, det) = tap[some], _inverse(c[some].astype(np.float64), 9.0 * 255.0 * 255.0 * epsilon)
    d = (9 * v[tap] - s[some][:, None, :]).astype(np.float64)
    pair = 1 + d @ (inverse / det[:, None, None]) @ d.transpose(0, 2, 1)
    i, j, pair = np.repeat(tap, 9, 1).ravel(), np.tile(tap, (1, 9)).ravel(), pair.ravel()
    total = np.bincount(i, weights=pair, minlength=w * h)
    return _laplacian(i, j, pair * (1 / np.where(total < 0.05, 1.0, total))[i], w * h)


def _similarity(frame: pd.DataFrame, unknown: np.ndarray, weight: float, k: int = 5, xy: float = 0.05, scale: float = 100.0) -> Entries:
    q, f = np.flatnonzero(unknown), [_features(frame, s)[unknown] for s in (xy, xy / scale)]
    near = np.column_stack([nearest_in_memory(own, own, some) for own, some in zip(f, (k, -(-k // 5)), strict=True)])
    v = np.maximum(0.0, 1 - np.abs(f[1][:, None, :] - f[1][near]).sum(2) / 5.0).ravel() / 2
    i, j = np.repeat(q, near.shape[1]), q[near].ravel()
    return _laplacian(np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([v, v]), len(frame), weight)


def _trim_patches(moments: tuple[np.ndarray, np.ndarray, np.ndarray], t: np.ndarray, low: float = 0.25, high: float = 0.9, k: int = 5, epsilon: float = 1e-8 / 9) -> np.ndarray:
    _, s, c = moments
    m, c, q, out = s / (9.0 * 255.0), c / (9.0 * 9.0 * 255.0 * 255.0) + epsilon * np.eye(3), np.flatnonzero(_open(t)), t.copy()
    sides = [np.flatnonzero(t > 0.8), np.flatnonzero(t < 0.2)]
    if not len(q) or not all(map(len, sides)):
        return out
    det, least = _inverse(c, 0.0)[1], []
    for side in sides:
        near = side[nearest_in_memory(m[q], m[side], k)]
        i, j = np.repeat(q, near.shape[1]), near.ravel()
        inverse, both = _inverse((c[i] + c[j]) / 2, 0.0)
        gap = m[i] - m[j]
        with np.errstate(invalid="ignore", divide="ignore"):
            ratio = both / np.sqrt(det[i] * det[j])
            d = np.einsum("na,nab,nb->n", gap, inverse / both[:, None, None], gap) / 8 + 0.5 * np.log(ratio)
        d = np.where(ratio <= 0, np.nan, np.where(np.isnan(d), np.inf, d)).reshape(near.shape)  # as in tables: no logarithm counts as none, else what is no number as the largest
        least.append(np.fmin.reduce(d, axis=1))
    fg, bg = least
    out[q] = np.where((fg < low) & (bg > high), 1.0, np.where((bg < low) & (fg > high), 0.0, t[q]))
    return out


def _estimate(frame: pd.DataFrame, t: np.ndarray, k: int = 7, xy: float = 10.0) -> tuple[np.ndarray, np.ndarray]:
    """Alphas and confidences of unknown pixels from known ones; zero elsewhere."""
    f, q, out = _features(frame, xy), np.flatnonzero(_open(t)), np.zeros((2, len(t)))
    sides = [np.flatnonzero(t > 0.8), np.flatnonzero(t < 0.2)]
    near = np.column_stack([side[nearest_in_memory(f[q], f[side], k)] for side in sides])
    if near.size:
        w, colour, is_fg = rebuilding_weights(f[near, :3] - f[q, None, :3]), f[near, :3], t[near] > 0.8
        gap = ((np.where(is_fg, w, 0.0) - np.where(is_fg, 0.0, w))[:, :, None] * colour).sum(1)
        out[:, q] = np.where(is_fg, w, 0.0).sum(1), (gap**2).sum(1) / 3
    return out[0], out[1]


def trim_edges(frame: pd.DataFrame) -> np.ndarray:
    """Trimap of images of one size, rows by image and i, after all passes of edge trimming."""
    w, h = int(frame.w.iloc[0]), int(frame.h.iloc[0])
    t, colours = frame.t.to_numpy().reshape(-1, w), frame[["r", "g", "b"]].to_numpy().reshape(-1, w, 3)
    for r, threshold in kernels.trim_steps():
        t = kernels.expand_labels(colours, t, r, threshold, h)
    return t.ravel()


def system(frame: pd.DataFrame, edge: np.ndarray, known_weight: float = 100.0, to_unknown: float = 0.05, similarity: float = 0.01) -> tuple[kernels.Csr, np.ndarray]:
    """A and b of one whole image, rows by i, and its trimmed ``edge``; memory grows with the square of its pixels."""
    w, h, n, t = int(frame.w.iloc[0]), int(frame.h.iloc[0]), len(frame), frame.t.to_numpy()
    v, unknown = frame[["r8", "g8", "b8"]].to_numpy().astype(np.int64), _open(t)
    moments = _moments(v, w, h)
    patch = _trim_patches(moments, t)
    alpha, confidence = _estimate(frame, patch)
    label = lambda c: np.where(c > 0.8, 1.0, 0.0)
    guess = np.where(~_open(edge), label(edge), np.where(~_open(patch), patch, alpha))
    sure = np.where(~unknown, 0.0, np.where(~_open(edge) | ~_open(patch), 1.0, confidence))
    weight = np.where(unknown, 0.0, known_weight) + to_unknown * sure
    terms = [_local(moments, v, unknown, w, h), (np.arange(n), np.arange(n), weight)]
    if unknown.any():
        terms += [_mixture(frame, unknown), _similarity(frame, unknown, similarity)]
    at = np.concatenate([i * n + j for i, j, _ in terms])
    key, sums = np.flatnonzero(np.bincount(at, minlength=n * n)), np.bincount(at, weights=np.concatenate([x for _, _, x in terms]), minlength=n * n)
    return kernels.Csr(key // n, key % n, sums[key], n, n), weight * guess
