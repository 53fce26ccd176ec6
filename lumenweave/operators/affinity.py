"""Pixel graphs and their Laplacians: closed form, nearest neighbours, large kernel, information flow."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweave.functions.pixel import dot, mat_vec, quadratic, sym3_cofactors
from lumenweave.operators import kernels, linalg
from lumenweave.operators.grid import NINE, box_sums, dilate, taps, window_moments, windows
from lumenweave.operators.neighbors import lle_weights, nearest
from lumenweave.plans.lineage import cut, drop, keep, wide

_PAIRS = [(a, b) for k, a in enumerate("rgb") for b in "rgb"[k:]]
#: Rows of a task where neighbours' values are looked up: partitions that go by compressed bytes would grow.
TASK_ROWS = 1 << 17


def _matrix(m: dict[str, Column]) -> list[list[Column]]:
    at = lambda a, b: m[a + b] if a + b in m else m[b + a]
    return [[at(a, b) for b in "rgb"] for a in "rgb"]


def closed_form_affinity(pixels: DataFrame, epsilon: float = 1e-7, inside: DataFrame | None = None) -> DataFrame:
    """COO of 1 + (a - m)'(Cov + eps/9 I)^-1 (b - m), summed over the clamped 3x3 windows.

    Moments are exact integers: with d = 9 I - S and C = 9 SII' - SS', a pair weighs
    1 + da' (C + 9 * 255^2 * eps * I)^-1 db. ``inside`` (image_id, i) keeps some windows only.
    """
    m = window_moments(pixels)
    if inside is not None:
        m = m.join(wide(inside), ["image_id", "i"], "left_semi")
    ridge = F.lit(9.0 * 255.0 * 255.0 * epsilon)
    c, det = sym3_cofactors({a + b: F.col(f"c_{a}{b}").cast("double") + (ridge if a == b else 0.0) for a, b in _PAIRS})
    m = m.select("image_id", F.col("i").alias("c"), *[f"s_{a}" for a in "rgb"], *[(c[a + b] / det).alias(f"k_{a}{b}") for a, b in _PAIRS])
    rows = windows(pixels, NINE, ["r8", "g8", "b8"]).join(wide(m), ["image_id", "c"])
    rows = rows.select("image_id", "c", "off", "j", *[(9 * F.col(f"n_{a}8") - F.col(f"s_{a}")).cast("double").alias(f"d_{a}") for a in "rgb"], *[f"k_{a}{b}" for a, b in _PAIRS])
    left = rows.withColumns({f"e_{a}": v for a, v in zip("rgb", mat_vec(_matrix({a + b: F.col(f"k_{a}{b}") for a, b in _PAIRS}), [F.col(f"d_{a}") for a in "rgb"]), strict=True)})
    left = left.select("image_id", "c", F.col("j").alias("i"), *[f"e_{a}" for a in "rgb"])
    right = rows.select("image_id", "c", "j", *[f"d_{a}" for a in "rgb"])
    w = 1 + dot([F.col(f"e_{a}") for a in "rgb"], [F.col(f"d_{a}") for a in "rgb"])
    return left.join(wide(right), ["image_id", "c"]).groupBy("image_id", "i", "j").agg(F.sum(w).alias("v"))


def closed_form_laplacian(pixels: DataFrame, epsilon: float = 1e-7) -> DataFrame:
    """I - W/81: with clamped windows every row of W sums to 81, so no normalising join is needed."""
    w = closed_form_affinity(pixels, epsilon)
    one = pixels.select("image_id", "i", F.lit(1.0).alias("v"))
    return linalg.add(linalg.diagonal(one), w.withColumn("v", -F.col("v") / 81.0))


def knn_features(pixels: DataFrame, decay: float = 1.0) -> DataFrame:
    w, h = (F.col(c).cast("long") for c in "wh")  # an image of 46,341 rows overflows integers
    d = F.sqrt((w * w + h * h).cast("double")) / 2.0
    return pixels.select("image_id", "i", "r", "g", "b", (decay * (F.col("x") + 1) / d).alias("fx"), (decay * (F.col("y") + 1) / d).alias("fy"))


def knn_graph(pixels: DataFrame, k: tuple[int, ...] = (10, 2), decay: float = 0.01) -> DataFrame:
    """COO of the unweighted symmetric neighbour graph; each round counts positions ``decay`` times the last."""
    edges, scale, pixels = None, 1.0, cut(pixels.select("image_id", "i", "x", "y", "w", "h", "r", "g", "b"))
    for n in k:
        f = knn_features(pixels, scale)
        found = nearest(f, f, ["r", "g", "b", "fx", "fy"], n, apart=scale > 0).select("image_id", F.least("q", "j").alias("a"), F.greatest("q", "j").alias("b"))
        edges = found if edges is None else edges.unionAll(found)
        scale *= decay
    entry = lambda i, j, v: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), F.lit(v).alias("v"))
    both = F.when(F.col("a") == F.col("b"), F.array(entry("a", "b", 2.0))).otherwise(F.array(entry("a", "b", 1.0), entry("b", "a", 1.0)))
    return cut(edges.distinct()).select("image_id", F.inline(both))  # distinct pairs need no adding up


def knn_laplacian(pixels: DataFrame, k: tuple[int, ...] = (10, 2), decay: float = 0.01, normalise: bool = False) -> DataFrame:
    return linalg.laplacian(knn_graph(pixels, k, decay), normalise, distinct=True)


def _local_inverse(pixels: DataFrame, r: int, epsilon: float) -> DataFrame:
    """Per window centre (valid windows only): mean m_c and inverse covariance k_cd."""
    rows = pixels.withColumns({f"p_{a}{b}": F.col(a) * F.col(b) for a, b in _PAIRS})
    n = float((2 * r + 1) ** 2)
    s = box_sums(rows, r, ["r", "g", "b", *[f"p_{a}{b}" for a, b in _PAIRS]], "valid")
    cov = {a + b: F.col(f"p_{a}{b}") / n - F.col(a) / n * F.col(b) / n + (epsilon / n if a == b else 0.0) for a, b in _PAIRS}
    c, det = sym3_cofactors(cov)
    return s.select("image_id", "x", "y", "w", "h", *[(F.col(a) / n).alias(f"m_{a}") for a in "rgb"], *[(c[a + b] / det).alias(f"k_{a}{b}") for a, b in _PAIRS])


def large_kernel_apply(pixels: DataFrame, p: DataFrame, r: int = 2, epsilon: float = 1e-4) -> DataFrame:
    """L p without forming L: windows of radius r that lie inside. p: (image_id, i, v)."""
    return _kernel_product(pixels, _local_inverse(pixels, r, epsilon), r)(p)


def large_kernel_operator(pixels: DataFrame, r: int = 10, epsilon: float = 1e-7, weight: float = 0.0) -> tuple[Callable[[DataFrame], DataFrame], DataFrame, Callable[[], None]]:
    """The operator L + ``weight`` diag(known) as a function of (image_id, i, v), its diagonal, and what deletes its tables.

    The windows' means and inverses are made once; one application is two sweeps of window sums.
    """
    if not pixels.filter(F.least("w", "h") < 2 * r + 1).isEmpty():
        raise ValueError("both sides must be at least 2 * radius + 1")
    known = F.when((F.col("t") == 0.0) | (F.col("t") == 1.0), float(weight)).otherwise(0.0)
    base = keep(pixels.select("image_id", "i", "x", "y", "w", "h", "r", "g", "b", known.alias("known")))
    local = keep(_local_inverse(base, r, epsilon))
    d = large_kernel_diagonal(base, r, epsilon).join(base.select("image_id", "i", "known"), ["image_id", "i"])
    return _kernel_product(base, local, r), d.select("image_id", "i", (F.col("v") + F.col("known")).alias("v")), lambda: drop(base, local)


def _kernel_product(pixels: DataFrame, local: DataFrame, r: int) -> Callable[[DataFrame], DataFrame]:
    """``pixels`` may hold ``known``, a diagonal that is added."""
    n = float((2 * r + 1) ** 2)

    def apply(p: DataFrame) -> DataFrame:
        rows = pixels.join(p.select("image_id", "i", F.col("v").alias("p")), ["image_id", "i"])
        sums = box_sums(rows.withColumns({f"p{a}": F.col(a) * F.col("p") for a in "rgb"}), r, ["p", "pr", "pg", "pb"], "valid").select("image_id", "x", "y", *[c for c in ("p", "pr", "pg", "pb")])
        inner = local.join(sums, ["image_id", "x", "y"])
        shift = [F.col(f"p{a}") - F.col(f"m_{a}") * F.col("p") for a in "rgb"]
        k = _matrix({a + b: F.col(f"k_{a}{b}") for a, b in _PAIRS})
        inner = inner.withColumns({f"a_{a}": v for a, v in zip("rgb", mat_vec(k, shift), strict=True)})
        inner = inner.withColumn("a_0", F.col("p") - dot([F.col(f"a_{a}") for a in "rgb"], [F.col(f"m_{a}") for a in "rgb"])).withColumn("one", F.lit(1.0))
        # each pixel gathers what the valid windows around it say; zero elsewhere
        full = pixels.select("image_id", "x", "y", "w", "h").join(inner.select("image_id", "x", "y", "one", "a_0", "a_r", "a_g", "a_b"), ["image_id", "x", "y"], "left").fillna(0.0)
        back = box_sums(full, r, ["one", "a_0", "a_r", "a_g", "a_b"], "same").select("image_id", "x", "y", "one", "a_0", "a_r", "a_g", "a_b")
        out = rows.join(back, ["image_id", "x", "y"])
        # windows share their mass evenly, so L p is coverage * p less the local models' values over n
        value = F.col("one") * F.col("p") - (F.col("a_0") + F.col("a_r") * F.col("r") + F.col("a_g") * F.col("g") + F.col("a_b") * F.col("b")) / n
        return out.select("image_id", "i", (value + F.col("known") * F.col("p") if "known" in pixels.columns else value).alias("v"))

    return apply


def large_kernel_diagonal(pixels: DataFrame, r: int = 2, epsilon: float = 1e-4) -> DataFrame:
    """The diagonal of the same operator, from the windows' means and inverses."""
    n = float((2 * r + 1) ** 2)
    k = _matrix({a + b: F.col(f"k_{a}{b}") for a, b in _PAIRS})
    local = _local_inverse(pixels, r, epsilon)
    m = [F.col(f"m_{a}") for a in "rgb"]
    km = mat_vec(k, m)
    local = local.withColumns({"one": F.lit(1.0), "q0": dot(m, km), **{f"q_{a}": v for a, v in zip("rgb", km, strict=True)}})
    cols = ["one", "q0", "q_r", "q_g", "q_b", *[f"k_{a}{b}" for a, b in _PAIRS]]
    full = pixels.select("image_id", "x", "y", "w", "h").join(local.select("image_id", "x", "y", *cols), ["image_id", "x", "y"], "left").fillna(0.0)
    back = box_sums(full, r, cols, "same").select("image_id", "x", "y", *cols)
    v = [F.col(a) for a in "rgb"]
    far = F.col("q0") - 2 * dot([F.col(f"q_{a}") for a in "rgb"], v) + dot(v, mat_vec(k, v))
    return pixels.join(back, ["image_id", "x", "y"]).select("image_id", "i", (F.col("one") - (F.col("one") + far) / n).alias("v"))


# information flow


def nonlocal_features(pixels: DataFrame, xy: float) -> DataFrame:
    f = pixels.select("*", (xy * (F.col("x") + 1) / F.col("w")).alias("fx"), (xy * (F.col("y") + 1) / F.col("h")).alias("fy"))
    return f


def nonlocal_neighbours(pixels: DataFrame, k: int, xy: float = 1.0, queries: Column | None = None, candidates: Column | None = None) -> DataFrame:
    f = nonlocal_features(pixels, xy)
    names = ["r", "g", "b", "fx", "fy"] if xy > 0 else ["r", "g", "b"]
    return nearest(f.filter(queries) if queries is not None else f, f.filter(candidates) if candidates is not None else f, names, k, apart=xy > 0)


def color_mixture(pixels: DataFrame, k: int, xy: float = 1.0, queries: Column | None = None, candidates: Column | None = None, use_xy: bool = False) -> DataFrame:
    """COO of weights that rebuild each pixel's colour from its neighbours'."""
    found = nonlocal_neighbours(pixels, k, xy, queries, candidates)
    return lle_weights(found, nonlocal_features(pixels, xy), ["r", "g", "b", *(["fx", "fy"] if use_xy else [])]).select("image_id", F.col("q").alias("i"), "j", "v")


def local_affinity(pixels: DataFrame, epsilon: float = 1e-6) -> DataFrame:
    """Closed-form weights over interior windows that touch an unknown pixel, row-normalised."""
    soft = pixels.withColumn("u", ~((F.col("t") > 0.8) | (F.col("t") < 0.2)))
    near = dilate(soft, F.col("u"), 1).filter("grown").select("image_id", "x", "y")
    inner = soft.filter((F.col("x") >= 1) & (F.col("x") < F.col("w") - 1) & (F.col("y") >= 1) & (F.col("y") < F.col("h") - 1)).join(wide(near), ["image_id", "x", "y"], "left_semi").select("image_id", "i")
    w = closed_form_affinity(pixels, epsilon, inner)
    d = linalg.row_sums(w).withColumn("v", 1 / F.when(F.col("v") < 0.05, 1.0).otherwise(F.col("v")))
    return linalg.scale_rows(w, d)


def color_similarity(pixels: DataFrame, k: int = 5, xy: float = 0.05, queries: Column | None = None, candidates: Column | None = None, scale: float = 100.0) -> DataFrame:
    """COO of max(0, 1 - mean absolute feature difference), halves of both directions.

    Neighbours are the k nearest, and the ceil(k / 5) nearest by positions that count
    1 / ``scale`` of that; the weights use the latter features. A pair found twice adds up.
    """
    near, far = nonlocal_neighbours(pixels, k, xy, queries, candidates), nonlocal_neighbours(pixels, -(-k // 5), xy / scale, queries, candidates)
    found = near.select("image_id", "q", "j").unionAll(far.select("image_id", "q", "j"))
    names = ["r", "g", "b", "fx", "fy"]
    f = nonlocal_features(pixels, xy / scale).select("image_id", "i", *names)
    rows = found.join(wide(f.select("image_id", F.col("i").alias("q"), *[F.col(c).alias(f"q_{c}") for c in names])), ["image_id", "q"]).join(wide(f.select("image_id", F.col("i").alias("j"), *names)), ["image_id", "j"])
    gap = sum((F.abs(F.col(f"q_{c}") - F.col(c)) for c in names[1:]), F.abs(F.col("q_r") - F.col("r"))) / 5.0
    w = rows.select("image_id", F.col("q").alias("i"), "j", (F.greatest(F.lit(0.0), 1 - gap) / 2).alias("v"))
    return linalg.symmetrise(w)


def expand_labels(pixels: DataFrame, r: int, threshold: float) -> DataFrame:
    """(image_id, i, t): unknown pixels take the trimap value of the nearest known pixel within r whose colour is close."""
    known = pixels.filter("t > 0.8 OR t < 0.2").select("image_id", F.col("i").alias("j"), *[F.col(c).alias(f"k_{c}") for c in ("r", "g", "b", "t")])
    around = [(dx, dy) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]
    rows = taps(pixels.filter("NOT (t > 0.8 OR t < 0.2)"), around, ["r", "g", "b"], clamp=False).join(known, ["image_id", "j"])
    gap2 = sum(((F.col(c) - F.col(f"k_{c}")) * (F.col(c) - F.col(f"k_{c}")) for c in "gb"), (F.col("r") - F.col("k_r")) * (F.col("r") - F.col("k_r")))
    size = 2 * r + 1
    dx, dy = F.col("off") % size - r, F.floor(F.col("off") / size) - r
    near = rows.filter(gap2 < threshold * threshold).withColumn("o", F.struct((dx * dx + dy * dy).alias("d2"), "off", F.col("k_t").alias("label")))
    best = near.groupBy("image_id", F.col("c").alias("i")).agg(F.min("o").alias("o")).select("image_id", "i", F.col("o.label").alias("label"))
    return pixels.join(best, ["image_id", "i"], "left").select("image_id", "i", F.coalesce("label", "t").alias("t"))


#: Pixels of an image that one task holds; and of small images of one size that it takes at once.
KERNEL_PIXELS, BATCH_PIXELS = 1 << 23, 1 << 14
#: Pixels of a strip of rows of a larger image.
STRIP_PIXELS = 1 << 16


def trim_edges(pixels: DataFrame, passes: int = 9, high: float = 8.11 / 256, low: float = 1 / 256, in_tasks: bool | None = None) -> DataFrame:
    """Label expansion with radius 1..passes and falling colour thresholds; each pass reads the last.

    Images of up to KERNEL_PIXELS (``in_tasks``) run in tasks, small ones of one size some at a time, larger ones
    strip by strip with as many rows around as all passes reach; beyond that pass by pass as tables.
    """
    steps = kernels.trim_steps(passes, high, low)
    names = ["image_id", "i", "x", "y", "w", "h", "r", "g", "b"]
    halo = sum(r for r, _ in steps)
    rows = F.greatest(F.floor(F.lit(STRIP_PIXELS) / F.col("w")), F.lit(4 * halo)).cast("int")
    tall = F.col("h") > rows
    size = pixels.agg(F.max(F.col("w").cast("long") * F.col("h")).alias("largest"), F.count("*").alias("n"), F.max(tall).alias("tall")).first()
    if in_tasks is None:
        in_tasks = (size["largest"] or 0) <= KERNEL_PIXELS
    if in_tasks:

        def some(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(["image_id", "i"])
            w, h = int(frame.w.iloc[0]), int(frame.h.iloc[0])
            image, t = frame[["r", "g", "b"]].to_numpy().reshape(-1, w, 3), frame.t.to_numpy().reshape(-1, w)
            for r, threshold in steps:
                t = kernels.expand_labels(image, t, r, threshold, h)
            return pd.DataFrame({"image_id": frame.image_id, "i": frame.i, "t": t.ravel()})

        batch = F.pmod(F.xxhash64("image_id"), F.lit(-(-size["n"] // BATCH_PIXELS) or 1)).alias("batch")
        if not size["tall"]:
            return pixels.select(*names, "t", batch).groupBy("w", "h", "batch").applyInPandas(some, "image_id long, i long, t double")

        def strip(frame: pd.DataFrame) -> pd.DataFrame:
            out = some(frame.assign(h=len(frame) // int(frame.w.iloc[0])))
            frame = frame.sort_values(["image_id", "i"])
            return out[(frame.y // frame["rows"] == frame.strip).to_numpy()]

        at = lambda y: F.floor(y / F.col("rows")).cast("int")
        strips = F.sequence(at(F.greatest(F.lit(0), F.col("y") - halo)), at(F.least(F.col("h") - 1, F.col("y") + halo)))
        large = pixels.filter(tall).select(*names, "t", rows.alias("rows")).withColumn("strip", F.explode(strips)).groupBy("image_id", "strip").applyInPandas(strip, "image_id long, i long, t double")
        return pixels.filter(~tall).select(*names, "t", batch).groupBy("w", "h", "batch").applyInPandas(some, "image_id long, i long, t double").unionByName(large)
    still, base = pixels.select(*names, "t"), pixels.select(*names)
    for r, threshold in steps:
        t = cut(expand_labels(still, r, threshold))
        still = base.join(wide(t), ["image_id", "i"]).select(*names, "t")
    return still.select("image_id", "i", "t")


def _patch_moments(pixels: DataFrame, epsilon: float) -> DataFrame:
    m = window_moments(pixels)
    scale = 9.0 * 9.0 * 255.0 * 255.0
    return m.select("image_id", "i", *[(F.col(f"s_{a}") / (9.0 * 255.0)).alias(f"m_{a}") for a in "rgb"], *[(F.col(f"c_{a}{b}") / scale + (epsilon if a == b else 0.0)).alias(f"v_{a}{b}") for a, b in _PAIRS])


def patch_distances(pixels: DataFrame, k: int = 5, epsilon: float = 1e-8 / 9) -> DataFrame:
    """(image_id, i, fg, bg): smallest Bhattacharyya distance of an unknown pixel's patch to its k nearest known patches."""
    m = cut(_patch_moments(pixels, epsilon).join(wide(pixels.select("image_id", "i", "t")), ["image_id", "i"]))
    unknown, sides = m.filter("NOT (t > 0.8 OR t < 0.2)"), {"fg": F.col("t") > 0.8, "bg": F.col("t") < 0.2}
    found = [nearest(unknown, m.filter(cond), ["m_r", "m_g", "m_b"], k).select("image_id", F.col("q").alias("i"), "j", F.lit(name).alias("side")) for name, cond in sides.items()]
    other = m.select("image_id", F.col("i").alias("j"), *[F.col(c).alias(f"o_{c}") for c in m.columns if c[:2] in ("m_", "v_")])
    tasks = -(-len(sides) * k * unknown.count() // TASK_ROWS) or 1
    dealt = lambda df, at: df.repartition(tasks, "image_id", at)
    rows = dealt(dealt(found[0].unionByName(found[1]), "j").join(wide(dealt(other, "j")), ["image_id", "j"]), "i").join(wide(dealt(m.drop("t"), "i")), ["image_id", "i"])
    # step by step, so that no value is an expression that repeats all others
    rows = rows.withColumns({f"mean_{a}{b}": (F.col(f"v_{a}{b}") + F.col(f"o_v_{a}{b}")) / 2 for a, b in _PAIRS} | {f"gap_{a}": F.col(f"m_{a}") - F.col(f"o_m_{a}") for a in "rgb"})
    for to, of in (("", "mean_"), ("1", "v_"), ("2", "o_v_")):
        c, det = sym3_cofactors({a + b: F.col(f"{of}{a}{b}") for a, b in _PAIRS})
        rows = rows.withColumns({f"det{to}": det} | ({} if to else {f"c_{p}": v for p, v in c.items()}))
    gap = [F.col(f"gap_{a}") for a in "rgb"]
    rows = rows.withColumn("dist", quadratic(gap, _matrix({p: F.col(f"c_{p}") / F.col("det") for p in c}), gap) / 8 + 0.5 * F.log(F.col("det") / F.sqrt(F.col("det1") * F.col("det2"))))
    of = {name: F.col("side") == name for name in sides}
    best = rows.groupBy("image_id", "i").agg(*[F.min(F.when(s, F.col("dist"))).alias(name) for name, s in of.items()], *[F.count_if(s).alias(f"n_{name}") for name, s in of.items()])
    return best.filter("n_fg > 0 AND n_bg > 0").select("image_id", "i", *sides)


def trim_patches(pixels: DataFrame, low: float = 0.25, high: float = 0.9, k: int = 5) -> DataFrame:
    d = patch_distances(pixels, k)
    label = F.when((F.col("fg") < low) & (F.col("bg") > high), 1.0).when((F.col("bg") < low) & (F.col("fg") > high), 0.0)
    return pixels.select("image_id", "i", "t").join(wide(d), ["image_id", "i"], "left").select("image_id", "i", F.coalesce(label, "t").alias("t"))


def known_to_unknown(pixels: DataFrame, k: int = 7, xy: float = 10.0) -> DataFrame:
    """(image_id, i, alpha, confidence) of unknown pixels, from weights over k foreground and k background neighbours."""
    unknown = ~((F.col("t") > 0.8) | (F.col("t") < 0.2))
    fg, bg = (nonlocal_neighbours(pixels, k, xy, unknown, c) for c in (F.col("t") > 0.8, F.col("t") < 0.2))
    found = fg.unionAll(bg.withColumn("rank", F.col("rank") + k))
    w = lle_weights(found, pixels, ["r", "g", "b"])
    near = pixels.select("image_id", F.col("i").alias("j"), "r", "g", "b", (F.col("t") > 0.8).alias("is_fg"))
    rows = w.join(wide(near), ["image_id", "j"])
    side = lambda c, f: F.sum(F.when(F.col("is_fg") if f else ~F.col("is_fg"), F.col("v") * F.col(c)).otherwise(0.0))
    s = rows.groupBy("image_id", F.col("q").alias("i")).agg(F.sum(F.when(F.col("is_fg"), F.col("v")).otherwise(0.0)).alias("alpha"), *[side(c, f).alias(f"{'f' if f else 'b'}_{c}") for c in "rgb" for f in (True, False)])
    gap = sum(((F.col(f"f_{c}") - F.col(f"b_{c}")) ** 2 for c in "gb"), (F.col("f_r") - F.col("b_r")) ** 2)
    return s.select("image_id", "i", "alpha", (gap / 3).alias("confidence"))


def information_flow_system(pixels: DataFrame, known_weight: float = 100.0, to_unknown: float = 0.05, similarity: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """A and b: squared mixture Laplacian, local and similarity Laplacians, known and estimated alphas.

    Alphas of unknown pixels are estimated from the trimap after patch trimming, whose own
    labels are sure; those of edge trimming (both read the given trimap) take precedence.
    """
    pixels = cut(pixels)
    known = (F.col("t") > 0.8) | (F.col("t") < 0.2)
    mix = cut(color_mixture(pixels, 20, 1.0, ~known))
    m = cut(linalg.add(linalg.diagonal(linalg.row_sums(mix)), linalg.scale(mix, -1.0)))
    local, alike = cut(local_affinity(pixels)), cut(color_similarity(pixels, 5, 0.05, ~known, ~known))
    terms = [linalg.laplacian(local, False), linalg.scale(linalg.laplacian(alike, False), similarity)]
    edge, patch = trim_edges(pixels), cut(trim_patches(pixels))
    ku = known_to_unknown(cut(pixels.drop("t").join(wide(patch), ["image_id", "i"]).select(*pixels.columns)))
    rows = pixels.select("image_id", "i", "t").join(wide(edge.withColumnRenamed("t", "e")), ["image_id", "i"]).join(wide(patch.withColumnRenamed("t", "p")), ["image_id", "i"]).join(wide(ku), ["image_id", "i"], "left")
    label = lambda c: F.when(F.col(c) > 0.8, 1.0).when(F.col(c) < 0.2, 0.0)
    labelled = lambda c: label(c).isNotNull()
    guess = F.coalesce(label("e"), F.when(labelled("p"), F.col("p")), F.col("alpha"), F.lit(0.0))
    sure = F.when(known, 0.0).when(labelled("e") | labelled("p"), 1.0).otherwise(F.coalesce("confidence", F.lit(0.0)))
    weight = F.when(known, known_weight).otherwise(0.0) + to_unknown * sure
    rows = cut(rows.select("image_id", "i", weight.alias("weight"), (weight * guess).alias("v")))
    return linalg.add_to_symmetric(linalg.gram(m), *terms, linalg.diagonal(rows.select("image_id", "i", F.col("weight").alias("v")))), rows.select("image_id", "i", "v")
