"""Per-image linear solvers in NumPy: conjugate gradients, Jacobi, multigrid and incomplete Cholesky."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


@dataclass
class Csr:
    """Rows sorted, duplicates summed."""

    i: np.ndarray
    j: np.ndarray
    v: np.ndarray
    n: int
    m: int

    def __matmul__(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.i, weights=self.v * x[self.j], minlength=self.n)

    def diagonal(self) -> np.ndarray:
        on = self.i == self.j
        return np.bincount(self.i[on], weights=self.v[on], minlength=self.n)

    def dense(self) -> np.ndarray:
        out = np.zeros((self.n, self.m))
        out[self.i, self.j] = self.v
        return out


def csr(i: np.ndarray, j: np.ndarray, v: np.ndarray, n: int, m: int | None = None) -> Csr:
    m = m or n
    key, at = np.unique(i.astype(np.int64) * m + j, return_inverse=True)
    return Csr(key // m, key % m, np.bincount(at, weights=v, minlength=len(key)), n, m)


@dataclass
class Solved:
    x: np.ndarray
    steps: int
    residual: float


def conjugate_gradients(a: Csr, b: np.ndarray, rtol: float, max_iter: int, atol: float = 0.0, x0: np.ndarray | None = None, precondition: Callable | None = None, callback: Callable | None = None) -> Solved:
    """Stops at |r| < atol or |r| < rtol * |b|; ``callback(A, x, b)`` runs before the first and after every step."""
    x = np.zeros_like(b) if x0 is None else x0.copy()
    r = b - a @ x
    m = precondition or (lambda y: y)
    goal = max(atol, rtol * float(np.sqrt(b @ b)))
    if callback:
        callback(a, x, b)
    z = m(r)
    p, rz, steps = z.copy(), float(r @ z), 0
    while (size := float(np.sqrt(r @ r))) >= goal and size > 0 and steps < max_iter:
        ap = a @ p
        step = rz / float(p @ ap)
        x = x + step * p
        r = r - step * ap
        z = m(r)
        rz, old = float(r @ z), rz
        p = z + (rz / old) * p
        steps += 1
        if callback:
            callback(a, x, b)
    return Solved(x, steps, float(np.sqrt(r @ r)))


def least_squares(a: Csr, b: np.ndarray, max_iter: int = 1000, tolerance: float = 1e-10) -> np.ndarray:
    """CG on the normal equations."""
    at = csr(a.j, a.i, a.v, a.m, a.n)
    normal = csr(*_product(at, a), a.m)
    return conjugate_gradients(normal, at @ b, 0.0, max_iter, tolerance).x


def _product(a: Csr, b: Csr) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unsummed triples of a @ b."""
    starts = np.searchsorted(b.i, np.arange(b.n + 1))
    many = np.diff(starts)[a.j]
    left = np.repeat(np.arange(len(a.v)), many)
    right = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(starts[a.j], many)
    return a.i[left], b.j[right], a.v[left] * b.v[right]


def restriction(w: int, h: int) -> Csr:
    """[1 2 1] x [1 2 1] / 16 around every second pixel; taps outside are dropped."""
    w2, h2 = w // 2, h // 2
    k = np.arange(w2 * h2)
    i, j, v = [], [], []
    for dx, a in ((-1, 1), (0, 2), (1, 1)):
        for dy, b in ((-1, 1), (0, 2), (1, 1)):
            x, y = 2 * (k % w2) + dx, 2 * (k // w2) + dy
            ok = (x >= 0) & (x < w) & (y >= 0) & (y < h)
            i.append(k[ok])
            j.append((x + y * w)[ok])
            v.append(np.full(ok.sum(), a * b / 16.0))
    return csr(np.concatenate(i), np.concatenate(j), np.concatenate(v), w2 * h2, w * h)


def jacobi(a: Csr, diagonal: np.ndarray, b: np.ndarray, x: np.ndarray, steps: int, omega: float) -> np.ndarray:
    for _ in range(steps):
        x = x + omega * (b - a @ x) / diagonal
    return x


def gauss_seidel(a: Csr, b: np.ndarray, x: np.ndarray, steps: int) -> np.ndarray:
    starts, x = np.searchsorted(a.i, np.arange(a.n + 1)), x.copy()
    d = a.diagonal()
    for _ in range(steps):
        for i in range(a.n):
            s = slice(starts[i], starts[i + 1])
            x[i] += (b[i] - a.v[s] @ x[a.j[s]]) / d[i]
    return x


class Multigrid:
    """V-cycles with Galerkin coarse matrices, built once per grid shape; dense below 33 unknowns."""

    def __init__(self, a: Csr, w: int, h: int, pre: int = 1, post: int = 1, omega: float = 0.8, smoothing: str = "jacobi"):
        self.pre, self.post, self.omega, self.smoothing, self.levels = pre, post, omega, smoothing, []
        while True:
            small = a.n <= 32 or w < 2 or h < 2
            self.levels.append((a, a.diagonal(), None if small else restriction(w, h), a.dense() if small and a.n <= 4096 else None))
            if small:
                return
            r = self.levels[-1][2]
            p = csr(r.j, r.i, r.v, r.m, r.n)
            ra = csr(*_product(r, a), r.n, a.m)
            a = csr(*_product(ra, p), r.n)
            w, h = w // 2, h // 2

    def _smooth(self, a: Csr, d: np.ndarray, b: np.ndarray, x: np.ndarray, steps: int) -> np.ndarray:
        return gauss_seidel(a, b, x, steps) if self.smoothing == "gauss-seidel" else jacobi(a, d, b, x, steps, self.omega)

    def cycle(self, b: np.ndarray, level: int = 0) -> np.ndarray:
        a, d, r, full = self.levels[level]
        if r is None:
            return np.linalg.lstsq(full, b, rcond=None)[0] if full is not None else self._smooth(a, d, b, np.zeros_like(b), 8)
        x = self._smooth(a, d, b, np.zeros_like(b), self.pre)
        coarse = self.cycle(r @ (b - a @ x), level + 1)
        x = x + np.bincount(r.j, weights=r.v * coarse[r.i], minlength=r.m)
        return self._smooth(a, d, b, x, self.post)


class FactorError(ArithmeticError):
    pass


class ColumnFactor:
    """Thresholded incomplete Cholesky factor by columns; entries below the threshold (after division by the pivot's root) go, the diagonal stays.

    ``pattern_only`` also drops what fills in where the matrix itself has no entry.
    Each column is one sparse update from the earlier columns that reach its row. The
    triangular solves run level by level, so NumPy handles whole levels at once.
    """

    def __init__(self, a: Csr, threshold: float = 1e-4, regularization: float = 0.0, pattern_only: bool = False):
        n = a.n
        low = a.i >= a.j
        order = np.lexsort((a.i[low], a.j[low]))
        ai, aj, av = a.i[low][order], a.j[low][order], a.v[low][order]
        starts = np.searchsorted(aj, np.arange(n + 1))
        rows, vals = [], []
        reach: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        work = np.zeros(n)
        for j in range(n):
            s = slice(starts[j], starts[j + 1])
            used = [ai[s]]
            work[ai[s]] = av[s]
            work[j] += regularization
            for k, at in reach[j]:
                r, v = rows[k][at:], vals[k][at:]
                work[r] -= v * v[0]
                used.append(r)
                if at + 1 < len(rows[k]):
                    reach[rows[k][at + 1]].append((k, at + 1))
            reach[j] = []
            r = np.unique(np.concatenate(used))
            v = work[r].copy()
            work[r] = 0
            if pattern_only:
                own = np.isin(r, used[0])
                r, v = r[own], v[own]
            if not v[0] > 0:
                raise FactorError(f"pivot {j} is not positive")
            v /= np.sqrt(v[0])
            keep = np.abs(v) >= threshold
            keep[0] = True
            r, v = r[keep], v[keep]
            rows.append(r)
            vals.append(v)
            if len(r) > 1:
                reach[r[1]].append((j, 1))
        self.n = n
        self.i, self.v = np.concatenate(rows), np.concatenate(vals)
        self.j = np.repeat(np.arange(n), [len(r) for r in rows])
        self.diag = np.array([v[0] for v in vals])
        off = self.i != self.j
        self._lower = self._levels(self.i[off], self.j[off], self.v[off], range(n))
        self._upper = self._levels(self.j[off], self.i[off], self.v[off], range(n - 1, -1, -1))

    def _levels(self, i: np.ndarray, j: np.ndarray, v: np.ndarray, order) -> list[tuple]:
        """Unknowns grouped so that each depends on earlier groups only: (unknowns, local row, column, value)."""
        by_row = np.argsort(i, kind="stable")
        i, j, v = i[by_row], j[by_row], v[by_row]
        starts, depth = np.searchsorted(i, np.arange(self.n + 1)), np.zeros(self.n, np.int64)
        for x in order:
            if starts[x] < starts[x + 1]:
                depth[x] = depth[j[starts[x] : starts[x + 1]]].max() + 1
        out = []
        unknowns = np.argsort(depth, kind="stable")
        edges = np.searchsorted(depth[unknowns], np.arange(depth.max(initial=0) + 2))
        entry = np.argsort(depth[i], kind="stable")
        entry_edges = np.searchsorted(depth[i][entry], np.arange(depth.max(initial=0) + 2))
        local = np.empty(self.n, np.int64)
        for d in range(len(edges) - 1):
            u, e = unknowns[edges[d] : edges[d + 1]], entry[entry_edges[d] : entry_edges[d + 1]]
            local[u] = np.arange(len(u))
            out.append((u, local[i[e]], j[e], v[e]))
        return out

    def _substitute(self, levels: list[tuple], b: np.ndarray) -> np.ndarray:
        x = np.zeros_like(b)
        for u, row, col, v in levels:
            x[u] = (b[u] - np.bincount(row, weights=v * x[col], minlength=len(u))) / self.diag[u]
        return x

    def forward(self, b: np.ndarray) -> np.ndarray:
        return self._substitute(self._lower, b)

    def backward(self, b: np.ndarray) -> np.ndarray:
        return self._substitute(self._upper, b)

    def solve(self, b: np.ndarray) -> np.ndarray:
        return self.backward(self.forward(b))


#: Factorisations tried after the given one, (regularisation, threshold); fixed values. The last is complete.
RETRIES = [(1e-4, 1e-4), (0.0, 1e-5), (1e-4, 1e-5), (0.0, 0.0)]


def factor_with_retries(a: Csr, threshold: float = 1e-4, regularization: float = 0.0, pattern_only: bool = False) -> ColumnFactor:
    for shift, t in [(regularization, threshold), *RETRIES]:
        try:
            return ColumnFactor(a, t, shift, pattern_only)
        except FactorError as e:
            warnings.warn(f"no factor with regularization {shift} and threshold {t}: {e}", stacklevel=2)
    raise FactorError("no attempt gave a factor")


def _clamped(v: np.ndarray, dx: int, dy: int) -> np.ndarray:
    """v at (y + dy, x + dx), with coordinates clamped to the image."""
    h, w = v.shape[:2]
    return v[np.clip(np.arange(h) + dy, 0, h - 1)][:, np.clip(np.arange(w) + dx, 0, w - 1)]


def colour_pass(image: np.ndarray, alpha: np.ndarray, fg: np.ndarray, bg: np.ndarray, neighbours: list[tuple[int, int]], regularization: float) -> tuple[np.ndarray, np.ndarray]:
    """One update of both colours from the pixel's own and its neighbours', for (h, w, 3) arrays."""
    total, sums = np.zeros(alpha.shape), [np.zeros(fg.shape), np.zeros(bg.shape)]
    for dx, dy in neighbours:
        d = regularization + np.abs(alpha - _clamped(alpha, dx, dy))
        total += d
        for s, v in zip(sums, (fg, bg), strict=True):
            s += d[..., None] * _clamped(v, dx, dy)
    a, b = alpha, 1 - alpha
    p, q, t = a * a + total, a * b, b * b + total
    det = p * t - q * q
    u, v = a[..., None] * image + sums[0], b[..., None] * image + sums[1]
    return np.clip((t[..., None] * u - q[..., None] * v) / det[..., None], 0, 1), np.clip((p[..., None] * v - q[..., None] * u) / det[..., None], 0, 1)


def nearest_indices(old: int, new: int) -> np.ndarray:
    return np.minimum(old - 1, np.floor(np.arange(new) * old / float(new)).astype(np.int64))


def trim_steps(passes: int = 9, high: float = 8.11 / 256, low: float = 1 / 256) -> list[tuple[int, float]]:
    """Radius and colour threshold of each pass of edge trimming."""
    return [(n + 1, high + (low - high) * n / max(1, passes - 1)) for n in range(passes)]


def expand_labels(image: np.ndarray, t: np.ndarray, r: int, threshold: float, tall: int | None = None) -> np.ndarray:
    """Unknown pixels take the trimap value of the nearest known pixel within r whose colour is closer than ``threshold``; ties go by row, then column.

    Several images of ``tall`` rows may lie one below another; none sees the next.
    """
    h, w = t.shape
    tall = tall or h
    known, out = (t > 0.8) | (t < 0.2), t.copy()
    open_y, open_x = np.nonzero(~known)
    for dx, dy in sorted(((dx, dy) for dy in range(-r, r + 1) for dx in range(-r, r + 1)), key=lambda o: o[0] ** 2 + o[1] ** 2):
        x, y = open_x + dx, open_y + dy
        ok = (x >= 0) & (x < w) & (y >= 0) & (y < h) & (y // tall == open_y // tall)
        ok[ok] = known[y[ok], x[ok]]
        gap = image[open_y[ok], open_x[ok]] - image[y[ok], x[ok]]
        ok[ok] = (gap[:, 1] ** 2 + gap[:, 0] ** 2) + gap[:, 2] ** 2 < threshold * threshold
        out[open_y[ok], open_x[ok]] = t[y[ok], x[ok]]
        open_y, open_x = open_y[~ok], open_x[~ok]
    return out
