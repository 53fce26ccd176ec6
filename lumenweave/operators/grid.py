"""Operators on pixel grids: stencils, sliding sums, resizing.

A stencil is an explode of literal offsets and an equi-join on the computed pixel, hash
partitioned by (image_id, i); no band or cross join appears.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenweave.plans.lineage import dealt, small, wide

#: The offsets of a 3x3 window, x outside and y inside; number 4 is the centre.
NINE = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
FOUR = [(-1, 0), (1, 0), (0, -1), (0, 1)]


def grid(spark: SparkSession, w: int, h: int) -> DataFrame:
    i = F.col("id")
    return spark.range(w * h).select(i.alias("i"), (i % w).cast("int").alias("x"), F.floor(i / w).cast("int").alias("y"))


def taps(pixels: DataFrame, offsets: list[tuple[int, int]], keep: list[str] | None = None, weights: list[float] | None = None, clamp: bool = True) -> DataFrame:
    """(image_id, c, off, j[, weight], kept columns): each centre ``c`` with its taps ``j``; outside is clamped or dropped."""
    weights = weights or [1.0] * len(offsets)
    table = F.array(*[F.struct(F.lit(k).alias("off"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(float(v)).alias("weight")) for k, ((dx, dy), v) in enumerate(zip(offsets, weights, strict=True))])
    rows = pixels.select("image_id", F.col("i").alias("c"), "x", "y", "w", "h", *(keep or []), F.explode(table).alias("o"))
    x, y = F.col("x") + F.col("o.dx"), F.col("y") + F.col("o.dy")
    if clamp:
        x, y = F.greatest(F.lit(0), F.least(F.col("w") - 1, x)), F.greatest(F.lit(0), F.least(F.col("h") - 1, y))
    else:
        rows = rows.filter((x >= 0) & (x < F.col("w")) & (y >= 0) & (y < F.col("h")))
    return rows.select("image_id", "c", F.col("o.off").alias("off"), (x + y * F.col("w")).cast("long").alias("j"), F.col("o.weight").alias("weight"), *(keep or []))


def windows(pixels: DataFrame, offsets: list[tuple[int, int]], values: list[str], keep: list[str] | None = None, clamp: bool = True, rows: int | None = None) -> DataFrame:
    """``taps`` with the tap's own ``values``; in tasks dealt by the number of taps, if the pixels' (``rows``) is given."""
    own = pixels.select("image_id", F.col("i").alias("j"), *[F.col(v).alias(f"n_{v}") for v in values])
    near = taps(pixels, offsets, keep, clamp=clamp)
    if rows is not None:
        near, own = (dealt(df, rows * len(offsets), "image_id", "j") for df in (near, own))
    return near.join(wide(own), ["image_id", "j"]).drop("weight")


def stencil_matrix(pixels: DataFrame, offsets: list[tuple[int, int]], weights: list[float]) -> DataFrame:
    """COO (image_id, i, j, v) of a clamped stencil; duplicates, which only pixels at an edge have, add up."""
    at: dict[tuple[int, int], float] = {}
    for o, weight in zip(offsets, weights, strict=True):
        at[o] = at.get(o, 0.0) + weight
    dx, dy = [o[0] for o in at], [o[1] for o in at]
    inside = (F.col("x") + min(dx) >= 0) & (F.col("x") + max(dx) < F.col("w")) & (F.col("y") + min(dy) >= 0) & (F.col("y") + max(dy) < F.col("h"))
    rows = lambda some: taps(pixels.filter(some), list(at), weights=list(at.values())).select("image_id", F.col("c").alias("i"), "j", F.col("weight").alias("v"))
    return rows(inside).unionByName(rows(~inside).groupBy("image_id", "i", "j").agg(F.sum("v").alias("v")))


def window_moments(pixels: DataFrame) -> DataFrame:
    """Exact integer moments of each clamped 3x3 window: s_c = sum, c_cd = 9 * sum of products - product of sums.

    A pixel goes to the centres around it, as often as their clamped windows take it, so no join is needed, and
    where a task's pixels are close together most sums are made before the shuffle.
    """
    pairs = [(a, b) for k, a in enumerate("rgb") for b in "rgb"[k:]]
    rows = pixels.select("image_id", "x", "y", "w", "h", *[F.col(f"{c}8").alias(c) for c in "rgb"], F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in NINE])).alias("o"))
    x, y, still = F.col("x") + F.col("o.dx"), F.col("y") + F.col("o.dy"), lambda d: F.col(f"o.{d}") == 0
    twice = lambda c, d, last: F.when(still(d), 1 + (F.col(c) == 0).cast("long") + (F.col(c) == last - 1).cast("long")).otherwise(1)
    rows = rows.filter((x >= 0) & (x < F.col("w")) & (y >= 0) & (y < F.col("h"))).select(
        "image_id", (x + y.cast("long") * F.col("w")).alias("i"), (still("dx") & still("dy")).alias("own"), (twice("x", "dx", F.col("w")) * twice("y", "dy", F.col("h"))).alias("k"), *"rgb"
    )
    sums = [F.sum(F.col("k") * F.col(c)).alias(f"s_{c}") for c in "rgb"] + [F.sum(F.col("k") * F.col(a) * F.col(b)).alias(f"p_{a}{b}") for a, b in pairs]
    out = rows.groupBy("image_id", "i").agg(F.max("own").alias("own"), *sums).filter("own")
    return out.select("image_id", "i", *[f"s_{c}" for c in "rgb"], *[(9 * F.col(f"p_{a}{b}") - F.col(f"s_{a}") * F.col(f"s_{b}")).alias(f"c_{a}{b}") for a, b in pairs])


def box_sums(pixels: DataFrame, r: int, values: list[str], mode: str = "same", fill_value: float = 0) -> DataFrame:
    """Sums over (2r+1) x (2r+1) windows, ``fill_value`` outside. (image_id, x, y, w, h, values).

    Two bounded window frames, first along rows, then along columns. ``valid`` keeps
    centres whose window lies inside; ``full`` also has centres outside the image.
    """
    if r < 1 or mode not in ("valid", "same", "full"):
        raise ValueError("r >= 1 and mode valid, same or full are required")
    rows = pixels.select("image_id", "x", "y", "w", "h", *values)
    reach = (r if mode == "full" else 0) + (r if fill_value and mode != "valid" else 0)
    if reach:
        size = rows.select("image_id", "w", "h").distinct()
        around = size.select("image_id", "w", "h", F.explode(F.sequence(F.lit(-reach), F.col("w") - 1 + reach)).alias("x")).select("*", F.explode(F.sequence(F.lit(-reach), F.col("h") - 1 + reach)).alias("y"))
        around = around.filter((F.col("x") < 0) | (F.col("x") >= F.col("w")) | (F.col("y") < 0) | (F.col("y") >= F.col("h")))
        kinds = dict(pixels.dtypes)
        rows = rows.unionByName(around.select("image_id", "x", "y", "w", "h", *[F.lit(fill_value).cast(kinds[v]).alias(v) for v in values]))
    for along, across in (("x", "y"), ("y", "x")):
        frame = Window.partitionBy("image_id", across).orderBy(along).rangeBetween(-r, r)
        rows = rows.withColumns({v: F.sum(v).over(frame) for v in values})
    edge = {"valid": r, "same": 0, "full": -r}[mode]
    if mode == "valid" or reach:
        rows = rows.filter((F.col("x") >= edge) & (F.col("x") < F.col("w") - edge) & (F.col("y") >= edge) & (F.col("y") < F.col("h") - edge))
    return rows


def running_sums(pixels: DataFrame, values: list[str]) -> DataFrame:
    """(image_id, x, y, values): sums over all pixels at most as far right and down, rows first."""
    rows = pixels.select("image_id", "x", "y", *values)
    for along, across in (("x", "y"), ("y", "x")):
        frame = Window.partitionBy("image_id", across).orderBy(along).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumns({v: F.sum(v).over(frame) for v in values})
    return rows


def windows_at(pixels: DataFrame, centres: DataFrame, r: int, values: list[str]) -> DataFrame:
    """``windows`` of radius r, rows outside and columns inside, around ``centres`` (image_id, x, y) only; taps outside the image are dropped."""
    around = [(dx, dy) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]
    own = pixels.select("image_id", F.col("i").alias("j"), *[F.col(v).alias(f"n_{v}") for v in values])
    return taps(pixels.join(wide(centres.select("image_id", "x", "y").distinct()), ["image_id", "x", "y"], "left_semi"), around, clamp=False).join(wide(own), ["image_id", "j"]).drop("weight")


def box_mean(pixels: DataFrame, r: int, values: list[str], mode: str = "same") -> DataFrame:
    """``box_sums`` over (2r+1)^2, zero outside."""
    return box_sums(pixels, r, values, mode).withColumns({v: F.col(v) / float((2 * r + 1) ** 2) for v in values})


def dilate(pixels: DataFrame, mask: Column, r: int) -> DataFrame:
    """(image_id, x, y, grown): whether any masked pixel lies within r."""
    marked = pixels.withColumn("m", mask.cast("long"))
    return box_sums(marked, r, ["m"]).select("image_id", "x", "y", (F.col("m") > 0).alias("grown"))


def _target(pixels: DataFrame, w: int | None, h: int | None, to: DataFrame | None) -> DataFrame:
    """Every pixel of the new sizes: ``w`` x ``h``, or those of ``to`` (image_id, nw, nh), whose images alone are kept."""
    size = pixels.select("image_id", F.col("w").alias("ow"), F.col("h").alias("oh")).distinct()
    size = size.withColumns({"nw": F.lit(w), "nh": F.lit(h)}) if to is None else size.join(small(to), "image_id")
    last = F.col("nw").cast("long") * F.col("nh") - 1
    rows = size.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return rows.select("image_id", "ow", "oh", "nw", "nh", "i", (F.col("i") % F.col("nw")).cast("int").alias("x"), F.floor(F.col("i") / F.col("nw")).cast("int").alias("y"))


def resize_nearest(pixels: DataFrame, w: int | None, h: int | None, values: list[str], to: DataFrame | None = None) -> DataFrame:
    """Images at ``w`` x ``h``, or each at its size of ``to`` (image_id, nw, nh)."""
    x = F.least(F.col("ow") - 1, F.floor(F.col("x") * F.col("ow") / F.col("nw").cast("double")).cast("int"))
    y = F.least(F.col("oh") - 1, F.floor(F.col("y") * F.col("oh") / F.col("nh").cast("double")).cast("int"))
    rows = _target(pixels, w, h, to).withColumn("j", (x + y * F.col("ow")).cast("long"))
    return rows.join(wide(pixels.select("image_id", F.col("i").alias("j"), *values)), ["image_id", "j"]).select("image_id", "i", "x", "y", F.col("nw").alias("w"), F.col("nh").alias("h"), *values)


def resize_bilinear(pixels: DataFrame, w: int | None, h: int | None, values: list[str], to: DataFrame | None = None) -> DataFrame:
    """Half-pixel centres, four clamped taps; sizes as in ``resize_nearest``."""
    fx = (F.col("x") + 0.5) * F.col("ow") / F.col("nw").cast("double") - 0.5
    fy = (F.col("y") + 0.5) * F.col("oh") / F.col("nh").cast("double") - 0.5
    rows = _target(pixels, w, h, to).withColumns({"fx": fx, "fy": fy}).withColumns({"x0": F.floor("fx").cast("int"), "y0": F.floor("fy").cast("int")})
    tap = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a in (0, 1) for b in (0, 1)])
    rows = rows.withColumn("o", F.explode(tap))
    wx = F.when(F.col("o.dx") == 1, F.col("fx") - F.col("x0")).otherwise(1 - (F.col("fx") - F.col("x0")))
    wy = F.when(F.col("o.dy") == 1, F.col("fy") - F.col("y0")).otherwise(1 - (F.col("fy") - F.col("y0")))
    sx = F.greatest(F.lit(0), F.least(F.col("ow") - 1, F.col("x0") + F.col("o.dx")))
    sy = F.greatest(F.lit(0), F.least(F.col("oh") - 1, F.col("y0") + F.col("o.dy")))
    rows = rows.select("image_id", "i", "x", "y", "nw", "nh", (sx + sy * F.col("ow")).cast("long").alias("j"), (wx * wy).alias("k"))
    rows = rows.join(wide(pixels.select("image_id", F.col("i").alias("j"), *values)), ["image_id", "j"])
    return rows.groupBy("image_id", "i", "x", "y", F.col("nw").alias("w"), F.col("nh").alias("h")).agg(*[F.sum(F.col("k") * F.col(v)).alias(v) for v in values])
