"""Foreground and background colours, compositing, and edge-preserving filters."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenweave.functions.pixel import clip, dot, inv2, mat_vec, sym3_cofactors
from lumenweave.operators import krylov, linalg
from lumenweave.operators.grid import FOUR, box_sums, resize_bilinear, resize_nearest, windows
from lumenweave.plans.lineage import dealt, keep, small
from lumenweave.operators.kernels import ColumnFactor, colour_pass, conjugate_gradients, csr, nearest_indices

RGB = ["r", "g", "b"]
_PAIRS = [(a, b) for k, a in enumerate("rgb") for b in "rgb"[k:]]
#: Pixels of an image that one task holds.
KERNEL_PIXELS = 1 << 23
_FB = [f"{s}_{c}" for s in "fb" for c in RGB]


def blend(rows: DataFrame, fg: list[str], bg: list[str], alpha: str, out: list[str] = RGB) -> DataFrame:
    return rows.withColumns({o: F.col(f) * F.col(alpha) + (1 - F.col(alpha)) * F.col(b) for f, b, o in zip(fg, bg, out, strict=True)})


def stack(*images: DataFrame) -> DataFrame:
    """Channels of several pixel tables side by side, by pixel; clashing names get a number."""
    named = []
    for k, image in enumerate(images):
        own = [c for c in image.columns if c not in ("image_id", "i")]
        named.append(image.select("image_id", "i", *[F.col(c).alias(f"{c}_{k}") for c in own]))
    return reduce(lambda a, b: a.join(b, ["image_id", "i"]), named)


def level_sizes(w: int, h: int, min_size: int = 2, growth: float = 2.0) -> list[tuple[int, int]]:
    """Sizes from coarse to full; none exceeds the input."""
    if w < h:
        a, b = min_size, math.ceil(min_size * h / w)
    else:
        a, b = math.ceil(min_size * w / h), min_size
    a, b = min(a, w), min(b, h)
    out = [(a, b)]
    while a < w or b < h:
        a, b = min(w, math.ceil(a * growth)), min(h, math.ceil(b * growth))
        out.append((a, b))
    return out


def color_pass(level: DataFrame, regularization: float = 1e-5, where: Column | None = None) -> DataFrame:
    """One update of f_* and b_*: a 2x2 system per pixel from its colour, alpha and four clamped neighbours. Rows not ``where`` stay.

    Neighbours come from windows over a row and over a column of the image, so the input is
    named once and no join is needed.
    """
    rows, columns = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    held = F.struct("alpha", *_FB)
    step = lambda f, w: F.coalesce(f(held).over(w), held)
    out = level.withColumns({"n0": step(F.lag, rows), "n1": step(F.lead, rows)}).withColumns({"n2": step(F.lag, columns), "n3": step(F.lead, columns)})
    out = out.withColumns({f"d{k}": regularization + F.abs(F.col("alpha") - F.col(f"n{k}.alpha")) for k in range(4)})
    d = F.col("d0") + F.col("d1") + F.col("d2") + F.col("d3")
    a, b = F.col("alpha"), 1 - F.col("alpha")
    p, q, _, t = inv2(a * a + d, a * b, a * b, b * b + d)
    values = {}
    for c in RGB:
        u, v = (own * F.col(c) + sum((F.col(f"d{k}") * F.col(f"n{k}.{s}_{c}") for k in range(1, 4)), F.col("d0") * F.col(f"n0.{s}_{c}")) for own, s in ((a, "f"), (b, "b")))
        values[f"f_{c}"], values[f"b_{c}"] = clip(p * u + q * v), clip(q * u + t * v)
    if where is not None:
        values = {k: F.when(where, v).otherwise(F.col(k)) for k, v in values.items()}
    return out.withColumns(values).select(*level.columns)


def level_schedule(sizes: DataFrame, min_size: int = 2, growth: float = 2.0, n_iter: int | Callable[[int, int], int] = 2, levels: int | None = None) -> DataFrame:
    """(image_id, level, nw, nh, passes, final) of images ``sizes`` (image_id, w, h), level 0 the coarsest."""

    def shapes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for w, h in zip(frame.w.tolist(), frame.h.tolist(), strict=True):
                steps = level_sizes(w, h, min_size, growth)[:levels]
                rows += [(w, h, k, a, b, n_iter(a, b) if callable(n_iter) else n_iter, k + 1 == len(steps)) for k, (a, b) in enumerate(steps)]
            yield pd.DataFrame(rows, columns=["w", "h", "level", "nw", "nh", "passes", "final"])

    plan = sizes.select("w", "h").distinct().mapInPandas(shapes, "w int, h int, level int, nw int, nh int, passes int, final boolean")
    return sizes.select("image_id", "w", "h").distinct().join(small(plan), ["w", "h"]).drop("w", "h")


def estimate_multilevel(pixels: DataFrame, min_size: int = 2, growth: float = 2.0, regularization: float = 1e-5, n_iter: int | Callable[[int, int], int] = 2, levels: int | None = None, in_tasks: bool | None = None) -> DataFrame:
    """pixels: (image_id, i, x, y, w, h, r, g, b, alpha) of images of any sizes. Adds f_* and b_*.

    Coarse to fine with a fixed number of passes. Images of up to KERNEL_PIXELS (all or none by
    ``in_tasks``) run one per task. Larger ones run as tables: ``level_schedule`` tells each image's
    size at each level, and all images that are at a level share one plan. ``levels`` stops early at
    a coarse size.
    """
    n = F.col("w").cast("long") * F.col("h")
    if in_tasks is None:
        small_ones, large = pixels.filter(n <= KERNEL_PIXELS), pixels.filter(n > KERNEL_PIXELS)
        out = _multilevel_in_tasks(small_ones, min_size, growth, n_iter, levels, regularization)
        return out if large.isEmpty() else out.unionByName(estimate_multilevel(large, min_size, growth, regularization, n_iter, levels, False))
    if in_tasks:
        return _multilevel_in_tasks(pixels, min_size, growth, n_iter, levels, regularization)
    schedule = keep(level_schedule(pixels.select("image_id", "w", "h").distinct(), min_size, growth, n_iter, levels))
    state, done, names = None, [], ["image_id", "i", "x", "y", "w", "h", *RGB, "alpha", *_FB]
    for k in range((schedule.agg(F.max("level")).first()[0] or 0) + 1):
        now = schedule.filter(F.col("level") == k)
        sizes = now.select("image_id", "nw", "nh")
        level = resize_nearest(pixels, None, None, [*RGB, "alpha"], sizes)
        if state is None:
            level = level.withColumns({f"{s}_{c}": F.col(c) for s in "fb" for c in RGB})
        else:
            level = level.join(resize_nearest(state, None, None, _FB, sizes).select("image_id", "i", *_FB), ["image_id", "i"])
        passes = now.select("image_id", "passes", "final")
        level = level.join(small(passes), "image_id")
        for n in range(now.agg(F.max("passes")).first()[0] or 0):
            level = color_pass(level, regularization, F.col("passes") > n)
        level = keep(level)
        done.append(level.filter("final").select(*names))
        state = level.filter("NOT final")
    return reduce(DataFrame.unionByName, done)


def _multilevel_in_tasks(pixels: DataFrame, min_size: int, growth: float, n_iter: int | Callable[[int, int], int], levels: int | None, regularization: float) -> DataFrame:
    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("i")
        w, h = int(frame.w.iloc[0]), int(frame.h.iloc[0])
        image, alpha, state = frame[RGB].to_numpy().reshape(h, w, 3), frame.alpha.to_numpy().reshape(h, w), None
        for a, b in level_sizes(w, h, min_size, growth)[:levels]:
            y, x = nearest_indices(h, b), nearest_indices(w, a)
            small, at = image[y][:, x], alpha[y][:, x]
            if state is None:
                state = (small, small)
            else:
                y, x = nearest_indices(state[0].shape[0], b), nearest_indices(state[0].shape[1], a)
                state = tuple(v[y][:, x] for v in state)
            for _ in range(n_iter(a, b) if callable(n_iter) else n_iter):
                state = colour_pass(small, at, *state, FOUR, regularization)
        i = np.arange(a * b)
        out = {"image_id": frame.image_id.iloc[0], "i": i, "x": i % a, "y": i // a, "w": a, "h": b, "alpha": at.ravel()}
        planes = [("", small), ("f_", state[0]), ("b_", state[1])]
        return pd.DataFrame(out | {f"{s}{c}": v[:, :, k].ravel() for s, v in planes for k, c in enumerate(RGB)})

    names = ["r", "g", "b", *_FB]
    schema = "image_id long, i long, x int, y int, w int, h int, alpha double, " + ", ".join(f"{c} double" for c in names)
    return pixels.select("image_id", "i", "w", "h", *RGB, "alpha").groupBy("image_id").applyInPandas(one, schema)


def closed_form_system(pixels: DataFrame, regularization: float = 1e-5, neighbors: list[tuple[int, int]] = FOUR) -> tuple[DataFrame, DataFrame]:
    """A (image_id, i, j, v) and b (image_id, i, r, g, b) of both colours' smoothness system: unknown i is the foreground of
    pixel i, i + w h its background; the right sides of the three channels share A."""
    n, many = F.col("w").cast("long") * F.col("h"), pixels.count()
    own = pixels.select("image_id", "i", n.alias("n"), F.col("alpha").alias("a"), *RGB)
    rows = windows(pixels.withColumn("n", n), neighbors, ["alpha"], ["alpha", "n"], rows=many).select("image_id", F.col("c").alias("i"), "j", "n", (regularization + F.abs(F.col("alpha") - F.col("n_alpha"))).alias("k"))
    entry = lambda i, j, v: F.struct(i.alias("i"), j.alias("j"), v.alias("v"))
    i, j, k, a = F.col("i"), F.col("j"), F.col("k"), F.col("a")
    near = [entry(p + half, q + half, v) for half in (F.lit(0), F.col("n")) for p, q, v in ((i, i, k), (j, j, k), (i, j, -k), (j, i, -k))]  # k (v_i - v_j)^2
    m = i + F.col("n")
    mine = [entry(i, i, a * a), entry(m, m, (1 - a) * (1 - a)), entry(i, m, a * (1 - a)), entry(m, i, a * (1 - a))]
    cells = rows.select("image_id", F.inline(F.array(*near))).unionByName(own.select("image_id", F.inline(F.array(*mine))))
    side = lambda at, k: F.struct(at.alias("i"), *[(k * F.col(c)).alias(c) for c in RGB])
    b = own.select("image_id", F.array(side(i, a), side(m, 1 - a)).alias("s")).select("image_id", F.inline("s"))
    return dealt(cells, 8 * many, "image_id", "i").groupBy("image_id", "i", "j").agg(F.sum("v").alias("v")), b


def _closed_form_tables(pixels: DataFrame, regularization: float, neighbors: list[tuple[int, int]], max_iter: int, atol: float, rtol: float) -> DataFrame:
    a, b = (keep(x) for x in closed_form_system(pixels, regularization, neighbors))
    goals = b.groupBy("image_id").agg(*[F.greatest(F.lit(float(atol)), rtol * F.sqrt(F.sum(F.col(c) * F.col(c)))).alias(f"goal_{c}") for c in RGB])
    many = b.count()
    apply = krylov.product(a, RGB, many)
    out = krylov.solve(apply, b, goals, max_iter, RGB, diagonal=linalg.diagonal_of(a))
    apply.close()
    n = F.col("w").cast("long") * F.col("h")
    out = out.join(small(pixels.select("image_id", n.alias("n")).distinct()), "image_id")
    parts = [F.max(F.when((F.col("i") < F.col("n")) == (s == "f"), clip(F.col(f"x_{c}")))).alias(f"{s}_{c}") for s in "fb" for c in RGB]
    return dealt(out.withColumn("at", F.col("i") % F.col("n")), many, "image_id", "at").groupBy("image_id", "at").agg(*parts).withColumnRenamed("at", "i")


#: Pixels of an image whose two-colour matrix (some 12 entries a pixel) one task holds.
CLOSED_FORM_PIXELS = 1 << 20


def estimate_closed_form(pixels: DataFrame, regularization: float = 1e-5, neighbors: list[tuple[int, int]] = FOUR, max_iter: int = 1000, atol: float = 0.0, rtol: float = 1e-5, threshold: float = 1e-4, in_tasks: bool | None = None) -> DataFrame:
    """(image_id, i, f_*, b_*): smoothness system over both colours; each channel of an image stops by itself.

    Images of up to CLOSED_FORM_PIXELS (all or none by ``in_tasks``) run one per task with an
    incomplete factor; larger ones by CG over tables, all three channels in one state, with the diagonal.
    """
    if in_tasks is None:
        n = F.col("w").cast("long") * F.col("h")
        how = (regularization, neighbors, max_iter, atol, rtol, threshold)
        out, large = estimate_closed_form(pixels.filter(n <= CLOSED_FORM_PIXELS), *how, True), pixels.filter(n > CLOSED_FORM_PIXELS)
        return out if large.isEmpty() else out.unionByName(estimate_closed_form(large, *how, False))
    if not in_tasks:
        return _closed_form_tables(pixels, regularization, neighbors, max_iter, atol, rtol)

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("i")
        w, h, n = int(frame.w.iloc[0]), int(frame.h.iloc[0]), len(frame)
        a, x, y = frame.alpha.to_numpy(), frame.x.to_numpy(), frame.y.to_numpy()
        i, rows, cols, vals = np.arange(n), [], [], []
        for dx, dy in neighbors:
            j = np.clip(x + dx, 0, w - 1) + np.clip(y + dy, 0, h - 1) * w
            k = regularization + np.abs(a - a[j])
            for half in (0, n):  # k * (v_i - v_j)^2
                rows += [i + half, j + half, i + half, j + half]
                cols += [i + half, j + half, j + half, i + half]
                vals += [k, k, -k, -k]
        rows += [i, i + n, i, i + n]
        cols += [i, i + n, i + n, i]
        vals += [a * a, (1 - a) ** 2, a * (1 - a), a * (1 - a)]
        m = csr(np.concatenate(rows), np.concatenate(cols), np.concatenate(vals), 2 * n)
        factor = ColumnFactor(m, threshold)
        out = {"image_id": frame.image_id, "i": frame.i}
        for c in RGB:
            v = frame[c].to_numpy()
            s = np.clip(conjugate_gradients(m, np.concatenate([a * v, (1 - a) * v]), rtol, max_iter, atol, precondition=factor.solve).x, 0, 1)
            out[f"f_{c}"], out[f"b_{c}"] = s[:n], s[n:]
        return pd.DataFrame(out)

    columns = ["image_id", "i", "x", "y", "w", "h", "alpha", *RGB]
    return pixels.select(*columns).groupBy("image_id").applyInPandas(one, "image_id long, i long, " + ", ".join(f"{c} double" for c in ("f_r", "b_r", "f_g", "b_g", "f_b", "b_b")))


def estimate_foreground_background(pixels: DataFrame, method: str = "ml", **how) -> DataFrame:
    """Colours of images of any sizes, each as if it were alone."""
    if method == "ml":
        return estimate_multilevel(pixels, **how)
    if method == "cf":
        return estimate_closed_form(pixels, **how)
    raise ValueError(f"method must be ml or cf, not {method}")


def local_model(pixels: DataFrame, p: str, r: int, eps: float = 1e-4) -> DataFrame:
    """(image_id, x, y, w, h, a_r, a_g, a_b, a_0): linear colour model of ``p`` per window that lies inside."""
    n = float((2 * r + 1) ** 2)
    rows = pixels.withColumns({**{f"p_{a}{b}": F.col(a) * F.col(b) for a, b in _PAIRS}, **{f"q_{a}": F.col(p) * F.col(a) for a in "rgb"}, "q": F.col(p)})
    names = ["r", "g", "b", "q", *[f"p_{a}{b}" for a, b in _PAIRS], *[f"q_{a}" for a in "rgb"]]
    s = box_sums(rows, r, names, "valid").withColumns({c: F.col(c) / n for c in names})
    cov = {a + b: F.col(f"p_{a}{b}") - F.col(a) * F.col(b) + (eps if a == b else 0.0) for a, b in _PAIRS}
    c, det = sym3_cofactors(cov)
    at = lambda a, b: (c[a + b] if a + b in c else c[b + a]) / det
    v = [F.col(f"q_{a}") - F.col(a) * F.col("q") for a in "rgb"]
    k = mat_vec([[at(a, b) for b in "rgb"] for a in "rgb"], v)
    s = s.withColumns({f"a_{a}": x for a, x in zip("rgb", k, strict=True)})
    return s.withColumn("a_0", F.col("q") - dot([F.col(f"a_{a}") for a in "rgb"], [F.col(a) for a in "rgb"])).select("image_id", "x", "y", "w", "h", "a_r", "a_g", "a_b", "a_0")


_MODEL = ["a_r", "a_g", "a_b", "a_0", "one"]


def _spread(pixels: DataFrame, model: DataFrame, r: int) -> DataFrame:
    """Sums of the window models around each pixel."""
    full = pixels.select("image_id", "i", "x", "y", "w", "h").join(model.withColumn("one", F.lit(1.0)).drop("w", "h"), ["image_id", "x", "y"], "left").fillna(0.0, _MODEL)
    return box_sums(full, r, _MODEL, "same").select("image_id", "x", "y", *_MODEL)


def guided_filter(pixels: DataFrame, p: str, r: int, eps: float = 1e-4) -> DataFrame:
    """(image_id, i, v): ``p`` filtered along the edges of r, g, b; both sides at least 2r + 1."""
    rows = pixels.join(_spread(pixels, local_model(pixels, p, r, eps), r), ["image_id", "x", "y"])
    return rows.select("image_id", "i", ((dot([F.col(f"a_{a}") for a in "rgb"], [F.col(a) for a in "rgb"]) + F.col("a_0")) / F.col("one")).alias("v"))


def fast_guided_filter(pixels: DataFrame, p: str, r: int, eps: float = 1e-4, scale: float = 0.125) -> DataFrame:
    """The model of ``guided_filter`` at ``scale`` of each image's size, enlarged bilinearly."""
    reach = max(1, int(r * scale))
    sizes = keep(pixels.select("image_id", "w", "h").distinct())
    side = lambda c: F.greatest(F.lit(2 * reach + 1), F.floor(F.col(c) * scale).cast("int"))
    low = resize_nearest(pixels, None, None, [*RGB, p], sizes.select("image_id", side("w").alias("nw"), side("h").alias("nh")))
    model = low.select("image_id", "i", "x", "y", "w", "h").join(_spread(low, local_model(low, p, reach, eps), reach), ["image_id", "x", "y"])
    up = resize_bilinear(model, None, None, _MODEL, sizes.select("image_id", F.col("w").alias("nw"), F.col("h").alias("nh"))).select("image_id", "i", *_MODEL)
    rows = pixels.join(up, ["image_id", "i"])
    return rows.select("image_id", "i", ((dot([F.col(f"a_{a}") for a in "rgb"], [F.col(a) for a in "rgb"]) + F.col("a_0")) / F.col("one")).alias("v"))
