"""Alpha mattes: builds a method's system as DataFrames and solves it image by image."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenweave.functions.pixel import trimap_flags
from lumenweave.operators import affinity, flow, krylov, linalg, multigrid, tiles
from lumenweave.plans import lineage
from lumenweave.plans.lineage import cut
from lumenweave.operators.kernels import Csr, Multigrid, Solved, conjugate_gradients, csr, factor_with_retries

#: Preconditioners that each method accepts.
METHODS = {"cf": [None, "jacobi", "vcycle", "ichol"], "knn": [None, "jacobi", "vcycle", "ichol"], "ifm": [None, "jacobi", "vcycle"], "lkm": [None, "jacobi"]}
PRECONDITIONERS = [None, "jacobi", "vcycle", "ichol"]
MAX_ITERATIONS = 2000
#: Pixels of an image whose matrix (some 25 to 100 entries a pixel) one task holds.
KERNEL_PIXELS = 1 << 21
#: Pixels of an image whose information flow one task builds as well (its memory grows with their square); and of such images that a task takes.
FLOW_PIXELS, FLOW_BATCH = 1 << 11, 1 << 13


def validate(pixels: DataFrame) -> DataFrame:
    """Per image what makes it unusable (problem), empty if nothing does."""
    t = trimap_flags(F.col("t"))
    bad = F.count_if(F.least("r", "g", "b") < 0) + F.count_if(F.greatest("r", "g", "b") > 1) + F.count_if((F.col("t") < 0) | (F.col("t") > 1))
    return (
        pixels.groupBy("image_id")
        .agg(bad.alias("bad"), F.count_if(t["is_fg"]).alias("fg"), F.count_if(t["is_bg"]).alias("bg"), F.count("*").alias("n"), F.max(F.col("w") * F.col("h")).alias("size"))
        .select("image_id", F.when(F.col("n") != F.col("size"), "pixels are missing").when(F.col("bad") > 0, "values lie outside 0 to 1").when(F.col("fg") == 0, "the trimap has no foreground").when(F.col("bg") == 0, "the trimap has no background").alias("problem"))
        .filter("problem IS NOT NULL")
    )


def build_system(pixels: DataFrame, method: str, weight: float = 100.0, epsilon: float = 1e-7) -> tuple[DataFrame, DataFrame]:
    if method == "cf":
        return linalg.system(affinity.closed_form_laplacian(pixels, epsilon), pixels, weight)
    if method == "knn":
        return linalg.system(affinity.knn_laplacian(pixels), pixels, weight)
    if method == "ifm":
        return affinity.information_flow_system(pixels, weight)
    raise ValueError(f"no matrix is formed for method {method}")


def solve(a: DataFrame, b: DataFrame, sizes: DataFrame, preconditioner: str | None = None, rtol: float = 0.0, atol: float | None = None, max_iterations: int = MAX_ITERATIONS, threshold: float = 1e-4, regularization: float = 0.0, callback: Callable | None = None, x0: DataFrame | None = None) -> DataFrame:
    """(image_id, i, x, steps, residual) of A x = b from ``x0`` (image_id, i, v; zero by default). atol defaults to 0.1 / (w h).

    Images of up to KERNEL_PIXELS are solved one per task; larger ones by CG over tables with the
    preconditioner asked for: the diagonal, a hierarchy of tables, or factors of overlapping tiles.
    ``callback`` is for the former only.
    """
    shapes = cut(sizes.select("image_id", "w", "h").distinct())
    large = shapes.filter(F.col("w").cast("long") * F.col("h") > KERNEL_PIXELS).select("image_id")
    if large.isEmpty():
        return _solve_in_tasks(a, b, shapes, preconditioner, rtol, atol, max_iterations, threshold, regularization, callback, x0)
    a, b, large = cut(a), cut(b), lineage.small(large)
    few, big = (lambda df: df.join(large, "image_id", "left_anti")), (lambda df: df.join(large, "image_id", "left_semi"))
    out = solve_tables(big(a), big(b), big(shapes), preconditioner, rtol, atol, max_iterations, threshold, regularization, big(x0) if x0 is not None else None)
    return out.unionByName(_solve_in_tasks(few(a), few(b), shapes, preconditioner, rtol, atol, max_iterations, threshold, regularization, callback, few(x0) if x0 is not None else None))


def _goals(b: DataFrame, shapes: DataFrame, rtol: float, atol: float | None) -> DataFrame:
    norms = b.groupBy("image_id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm")).join(lineage.small(shapes), "image_id")
    least = F.lit(0.1) / (F.col("w").cast("long") * F.col("h")) if atol is None else F.lit(float(atol))
    return cut(norms.select("image_id", F.greatest(least, rtol * F.col("norm")).alias("goal_v")))


def solve_tables(a: DataFrame, b: DataFrame, shapes: DataFrame, preconditioner: str | None = None, rtol: float = 0.0, atol: float | None = None, max_iterations: int = MAX_ITERATIONS, threshold: float = 1e-4, regularization: float = 0.0, x0: DataFrame | None = None) -> DataFrame:
    """``solve`` for images that no task holds: CG with vectors as tables. shapes: (image_id, w, h)."""
    how: dict = {}
    close = lambda: None
    if preconditioner == "jacobi":
        how["diagonal"] = linalg.diagonal_of(a)
    elif preconditioner == "vcycle":
        levels = multigrid.Hierarchy(a, shapes)
        how["precondition"], close = levels.cycle, levels.close
    elif preconditioner == "ichol":
        factors = tiles.TileFactors(a, shapes, threshold, regularization)
        how["precondition"], close = factors.solve, factors.close
    apply = krylov.product(a, rows=b.count())
    out = krylov.solve(apply, b, _goals(b, shapes, rtol, atol), max_iterations, x0=x0, **how)
    apply.close()
    close()
    return out.select("image_id", "i", F.col("x_v").alias("x"), "steps", F.col("residual_v").alias("residual"))


def solve_large_kernel_tables(pixels: DataFrame, radius: int = 10, epsilon: float = 1e-7, weight: float = 100.0, preconditioner: str | None = None, rtol: float = 0.0, atol: float | None = None, max_iterations: int = MAX_ITERATIONS, x0: DataFrame | None = None) -> DataFrame:
    """(image_id, i, x, steps, residual) of the large-kernel system by CG over tables: window sums take the matrix' place."""
    apply, diagonal, close = affinity.large_kernel_operator(pixels, radius, epsilon, weight)
    b = pixels.select("image_id", "i", F.when(F.col("t") == 1.0, float(weight)).otherwise(0.0).alias("v"))
    shapes = pixels.select("image_id", "w", "h").distinct()
    out = krylov.solve(apply, b, _goals(b, shapes, rtol, atol), max_iterations, x0=x0, diagonal=diagonal if preconditioner == "jacobi" else None)
    close()
    return out.select("image_id", "i", F.col("x_v").alias("x"), "steps", F.col("residual_v").alias("residual"))


def _solved(matrix: Csr, b: np.ndarray, x0: np.ndarray, w: int, h: int, preconditioner: str | None, rtol: float, atol: float | None, max_iterations: int, threshold: float, regularization: float, callback: Callable | None) -> Solved:
    precondition = None
    if preconditioner == "jacobi":
        d = matrix.diagonal()
        precondition = lambda r: r / d
    elif preconditioner == "vcycle":
        precondition = Multigrid(matrix, w, h).cycle
    elif preconditioner == "ichol":
        precondition = factor_with_retries(matrix, threshold, regularization).solve
    return conjugate_gradients(matrix, b, rtol, max_iterations, 0.1 / (w * h) if atol is None else atol, x0, precondition, callback)


def _solve_in_tasks(a: DataFrame, b: DataFrame, shapes: DataFrame, preconditioner: str | None, rtol: float, atol: float | None, max_iterations: int, threshold: float, regularization: float, callback: Callable | None, x0: DataFrame | None) -> DataFrame:
    sides = b.withColumnRenamed("v", "b").join(shapes, "image_id")
    sides = sides.withColumn("x0", F.lit(0.0)) if x0 is None else sides.join(x0.select("image_id", "i", F.col("v").alias("x0")), ["image_id", "i"], "left").fillna(0.0, ["x0"])
    sides = sides.select(F.col("image_id").alias("side_id"), F.col("i").alias("at"), "b", "w", "h", "x0")
    a = a.toDF(*a.columns)

    def one(m: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        side = side.sort_values("at")
        n, w, h = len(side), int(side.w.iloc[0]), int(side.h.iloc[0])
        matrix = csr(m["i"].to_numpy(), m["j"].to_numpy(), m["v"].to_numpy(), n)
        done = _solved(matrix, side.b.to_numpy(), side.x0.to_numpy(), w, h, preconditioner, rtol, atol, max_iterations, threshold, regularization, callback)
        return pd.DataFrame({"image_id": side.side_id, "i": side["at"], "x": done.x, "steps": done.steps, "residual": done.residual})

    return a.groupBy("image_id").cogroup(sides.groupBy("side_id")).applyInPandas(one, "image_id long, i long, x double, steps int, residual double")


def _solve_flow(pixels: DataFrame, weight: float, *how, x0: DataFrame | None = None) -> DataFrame:
    """Information flow: whole images of up to FLOW_PIXELS are built and solved in tasks, some at a time; others by tables of their entries."""
    size = pixels.groupBy("image_id").agg(F.count("*").alias("n"), F.max(F.col("w").cast("long") * F.col("h")).alias("full"))
    size = cut(size.withColumn("small", (F.col("n") == F.col("full")) & (F.col("n") <= FLOW_PIXELS)))
    few, big = (lambda df, ids: df.join(lineage.wide(ids), "image_id", "left_semi")), size.filter("NOT small")
    if big.isEmpty():
        return _solve_flow_in_tasks(pixels, weight, *how, x0=x0)
    image = cut(few(pixels, big))
    start = few(x0, big) if x0 is not None else None
    out = solve(*affinity.information_flow_system(image, weight), image, *how, x0=start)
    ids = size.filter("small")
    return out if ids.isEmpty() else out.unionByName(_solve_flow_in_tasks(few(pixels, ids), weight, *how, x0=x0))


def _solve_flow_in_tasks(pixels: DataFrame, weight: float, *how, x0: DataFrame | None = None) -> DataFrame:
    def some(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (w, h), images in frame.sort_values(["image_id", "i"]).groupby(["w", "h"]):
            for _, image in images.assign(edge=flow.trim_edges(images)).groupby("image_id"):
                done = _solved(*flow.system(image, image.edge.to_numpy(), weight), image.x0.to_numpy(), int(w), int(h), *how)
                out.append(pd.DataFrame({"image_id": image.image_id, "i": image.i, "x": done.x, "steps": done.steps, "residual": done.residual}))
        return pd.concat(out)

    rows = pixels.select("image_id", "i", "x", "y", "w", "h", *"rgb", "r8", "g8", "b8", "t")
    rows = rows.withColumn("x0", F.lit(0.0)) if x0 is None else rows.join(lineage.wide(x0.select("image_id", "i", F.col("v").alias("x0"))), ["image_id", "i"], "left").fillna(0.0, ["x0"])
    tasks = -(-pixels.count() // FLOW_BATCH) or 1
    batch = F.pmod(F.xxhash64("image_id"), F.lit(4 * tasks)).alias("batch")
    return rows.select("*", batch).repartition(tasks, "batch").groupBy("batch").applyInPandas(some, "image_id long, i long, x double, steps int, residual double")


def _solve_large_kernel(pixels: DataFrame, radius: int, epsilon: float, weight: float, preconditioner: str | None, rtol: float, atol: float | None, max_iterations: int, x0: DataFrame | None = None) -> DataFrame:
    """The large-kernel operator applied matrix-free: one image per task up to KERNEL_PIXELS, by tables beyond."""
    size = F.col("w").cast("long") * F.col("h")
    large = pixels.filter(size > KERNEL_PIXELS)
    if not large.isEmpty():
        how = (radius, epsilon, weight, preconditioner, rtol, atol, max_iterations, x0)
        return solve_large_kernel_tables(large, *how).unionByName(_solve_large_kernel(pixels.filter(size <= KERNEL_PIXELS), *how))

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("i")
        w, h = int(frame.w.iloc[0]), int(frame.h.iloc[0])
        if min(w, h) < 2 * radius + 1:
            raise ValueError("both sides must be at least 2 * radius + 1")
        image, n = frame[["r", "g", "b"]].to_numpy().reshape(h, w, 3), float((2 * radius + 1) ** 2)

        def inside(v: np.ndarray) -> np.ndarray:
            s = np.pad(v.cumsum(0).cumsum(1), ((1, 0), (1, 0), *[(0, 0)] * (v.ndim - 2)))
            k = 2 * radius + 1
            return s[k:, k:] - s[:-k, k:] - s[k:, :-k] + s[:-k, :-k]

        def around(v: np.ndarray) -> np.ndarray:
            return inside(np.pad(v, ((2 * radius, 2 * radius), (2 * radius, 2 * radius), *[(0, 0)] * (v.ndim - 2))))

        mean = inside(image) / n
        cov = inside(image[..., :, None] * image[..., None, :]) / n - mean[..., :, None] * mean[..., None, :]
        inverse = np.linalg.inv(cov + epsilon / n * np.eye(3))
        cover = around(np.ones(mean.shape[:2]))

        def apply(p: np.ndarray) -> np.ndarray:
            p = p.reshape(h, w)
            pm = inside(p) / n
            a = np.einsum("hwij,hwj->hwi", inverse, inside(image * p[..., None]) / n - mean * pm[..., None])
            return (cover * p - (around(a) * image).sum(2) - around(pm - (a * mean).sum(2))).ravel()

        km = np.einsum("hwij,hwj->hwi", inverse, mean)
        far = around((km * mean).sum(2)) - 2 * (around(km) * image).sum(2) + np.einsum("hwij,hwi,hwj->hw", around(inverse), image, image)
        t = frame.t.to_numpy()
        known = weight * ((t == 0) | (t == 1))

        class Operator:
            def __matmul__(self, p: np.ndarray) -> np.ndarray:
                return apply(p) + known * p

        diagonal = (cover - (cover + far) / n).ravel() + known
        precondition = (lambda r: r / diagonal) if preconditioner == "jacobi" else None
        done = conjugate_gradients(Operator(), weight * (t == 1), rtol, max_iterations, 0.1 / (w * h) if atol is None else atol, frame.x0.to_numpy(), precondition)
        return pd.DataFrame({"image_id": frame.image_id, "i": frame.i, "x": done.x, "steps": done.steps, "residual": done.residual})

    pixels = pixels.select("image_id", "i", "w", "h", "r", "g", "b", "t")
    pixels = pixels.withColumn("x0", F.lit(0.0)) if x0 is None else pixels.join(x0.select("image_id", "i", F.col("v").alias("x0")), ["image_id", "i"], "left").fillna(0.0, ["x0"])
    return pixels.groupBy("image_id").applyInPandas(one, "image_id long, i long, x double, steps int, residual double")


def alpha(pixels: DataFrame, method: str = "cf", preconditioner: str | None = "vcycle", weight: float = 100.0, epsilon: float = 1e-7, radius: int = 10, max_iterations: int = MAX_ITERATIONS, relative_tolerance: float | None = None, absolute_tolerance: float | None = None, threshold: float = 1e-4, regularization: float = 0.0, callback: Callable | None = None, x0: DataFrame | None = None) -> DataFrame:
    """(image_id, i, alpha) of every image of ``pixels`` (channels, trimap ``t``).

    ``x0``: (image_id, i, v) to start from. Without tolerances the residual must fall below 0.1 / (w h); with one, the other is 0.
    """
    if method not in METHODS or preconditioner not in METHODS[method]:
        raise ValueError(f"method {method} with preconditioner {preconditioner} is not available; choose from {METHODS}")
    problems = validate(pixels).limit(5).collect()
    if problems:
        raise ValueError("; ".join(f"image {p['image_id']}: {p['problem']}" for p in problems))
    rtol = relative_tolerance or 0.0
    atol = absolute_tolerance if absolute_tolerance is not None else (None if relative_tolerance is None else 0.0)
    if method == "lkm":
        x = _solve_large_kernel(pixels, radius, epsilon, weight, preconditioner, rtol, atol, max_iterations, x0)
    elif method == "ifm":
        x = _solve_flow(pixels, weight, preconditioner, rtol, atol, max_iterations, threshold, regularization, callback, x0=x0)
    else:
        a, b = build_system(pixels, method, weight, epsilon)
        x = solve(a, b, pixels, preconditioner, rtol, atol, max_iterations, threshold, regularization, callback, x0)
    return x.select("image_id", "i", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("x"))).alias("alpha"))
