"""V-cycles and many-colour sweeps over matrices as tables.

A V-cycle with one damped Jacobi pass before and one after is linear, so each level of its hierarchy
is three sparse tables, built once: with A the level's matrix, D its diagonal and R the restriction,

    down  R (I - w A D^-1)             what the coarser level gets of the right side
    own   w D^-1 (2 I - w A D^-1)      what both passes make of the right side
    up    (I - w D^-1 A) R'            what the coarser level's answer adds

and A' = R A R' is the coarser matrix. A cycle is then one product down and two up a level. Images
leave the hierarchy where they have few unknowns, and are solved exactly there, one task each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenweave.operators import linalg
from lumenweave.operators.krylov import product
from lumenweave.plans.lineage import drop, keep, small

#: Unknowns of an image that are solved exactly.
COARSE = 256


def restriction(sizes: DataFrame) -> DataFrame:
    """COO of [1 2 1] x [1 2 1] / 16 around every second pixel of images (image_id, w, h); taps outside are dropped."""
    w2 = F.floor(F.col("w") / 2)
    taps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit((2 - abs(dx)) * (2 - abs(dy)) / 16.0).alias("k")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    rows = sizes.select("image_id", "w", "h", w2.alias("w2"), F.explode(F.sequence(F.lit(0).cast("long"), w2 * F.floor(F.col("h") / 2) - 1)).alias("i"))
    rows = rows.withColumn("o", F.explode(taps)).select("image_id", "i", "w", "h", (2 * (F.col("i") % F.col("w2")) + F.col("o.dx")).alias("x"), (2 * F.floor(F.col("i") / F.col("w2")) + F.col("o.dy")).alias("y"), F.col("o.k").alias("v"))
    rows = rows.filter((F.col("x") >= 0) & (F.col("x") < F.col("w")) & (F.col("y") >= 0) & (F.col("y") < F.col("h")))
    return rows.select("image_id", "i", (F.col("x") + F.col("y") * F.col("w")).cast("long").alias("j"), "v")


def _exact(a: DataFrame, b: DataFrame) -> DataFrame:
    """(image_id, i, v): least-norm answers of small systems, an image a task."""

    def one(m: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        side = side.sort_values("at")
        at = {int(i): k for k, i in enumerate(side["at"])}
        full = np.zeros((len(side), len(side)))
        for i, j, v in zip(m["i"], m["j"], m["v"], strict=True):
            full[at[int(i)], at[int(j)]] += v
        x = np.linalg.lstsq(full, side["b"].to_numpy(), rcond=None)[0] if len(side) else np.zeros(0)
        return pd.DataFrame({"image_id": side["side_id"], "i": side["at"], "v": x})

    side = b.select(F.col("image_id").alias("side_id"), F.col("i").alias("at"), F.col("v").alias("b"))
    return a.groupBy("image_id").cogroup(side.groupBy("side_id")).applyInPandas(one, "image_id long, i long, v double")


class Hierarchy:
    """Levels of ``a`` (image_id, i, j, v) on images ``sizes`` (image_id, w, h); ``cycle`` applies one V-cycle from zero."""

    def __init__(self, a: DataFrame, sizes: DataFrame, omega: float = 0.8, coarse: int = COARSE) -> None:
        self._levels: list[tuple] = []
        sizes = keep(sizes.select("image_id", "w", "h").distinct())
        self._kept = [sizes]
        a = self._keep(a)
        while True:
            n = F.col("w").cast("long") * F.col("h")
            deeper = (n > coarse) & (F.least("w", "h") >= 2)
            big, rest = sizes.filter(deeper).select("image_id"), sizes.filter(~deeper).select("image_id")
            last = None if rest.isEmpty() else self._keep(a.join(small(rest), "image_id", "left_semi"))
            if big.isEmpty():
                self._levels.append((last, None, None, None, None, None))
                return
            big, rest = small(big), small(rest)
            a = a.join(big, "image_id", "left_semi")
            d = self._keep(linalg.diagonal_of(a).withColumn("v", omega / F.col("v")))
            one = linalg.diagonal(d.withColumn("v", F.lit(1.0)))
            columns = a.join(d.select("image_id", F.col("i").alias("j"), F.col("v").alias("k")), ["image_id", "j"]).select("image_id", "i", "j", (-F.col("v") * F.col("k")).alias("v"))
            after = self._keep(linalg.add(one, columns))  # I - w A D^-1
            r = self._keep(restriction(sizes.join(big, "image_id", "left_semi")))
            down = self._keep(linalg.matmat(r, after))
            own = self._keep(linalg.scale_rows(linalg.add(one, after), d))
            up = self._keep(linalg.matmat(linalg.add(one, linalg.scale(linalg.scale_rows(a, d), -1.0)), linalg.transpose(r)))
            self._levels.append((last, down, own, up, big, rest))
            a = self._keep(linalg.matmat(linalg.matmat(r, a), linalg.transpose(r)))
            sizes = self._keep(sizes.join(big, "image_id", "left_semi").select("image_id", F.floor(F.col("w") / 2).cast("int").alias("w"), F.floor(F.col("h") / 2).cast("int").alias("h")))

    def _keep(self, df: DataFrame) -> DataFrame:
        self._kept.append(keep(df))
        return self._kept[-1]

    def cycle(self, b: DataFrame, level: int = 0) -> DataFrame:
        """(image_id, i, v) of one cycle for the right side ``b`` (image_id, i, v)."""
        last, down, own, up, big, rest = self._levels[level]
        if down is None:
            return _exact(last, b)
        mine = b.join(big, "image_id", "left_semi") if last is not None else b
        coarse = self.cycle(product(down)(mine), level + 1)
        out = product(own)(mine).unionByName(product(up)(coarse)).groupBy("image_id", "i").agg(F.sum("v").alias("v"))
        return out if last is None else out.unionByName(_exact(last, b.join(rest, "image_id", "left_semi")))

    def close(self) -> None:
        """Delete the hierarchy's tables."""
        drop(*self._kept)


def colours(pixels: DataFrame, reach: int = 2) -> DataFrame:
    """(image_id, i, colour): pixels of one colour lie more than ``reach`` apart, row by row."""
    period = reach + 1
    return pixels.select("image_id", "i", ((F.col("y") % period) * period + F.col("x") % period).alias("colour"))


def gauss_seidel(a: DataFrame, b: DataFrame, classes: DataFrame, x: DataFrame | None = None, sweeps: int = 1) -> DataFrame:
    """(image_id, i, v): sweeps over all colour classes in turn, each updated at once from the newest values of the others.

    ``classes``: (image_id, i, colour), such that ``a`` couples no two unknowns of a colour. A class
    is one product with a table whose other rows are the identity, so a sweep is a chain of joins.
    """
    d = linalg.diagonal_of(a).withColumnRenamed("v", "d")
    rows = keep(a.join(classes, ["image_id", "i"]).join(d, ["image_id", "i"]).filter("i <> j").select("image_id", "i", "j", "colour", (-F.col("v") / F.col("d")).alias("v")))
    base = keep(b.join(classes, ["image_id", "i"]).join(d, ["image_id", "i"]).select("image_id", "i", "colour", (F.col("v") / F.col("d")).alias("v")))
    x = base.select("image_id", "i", F.lit(0.0).alias("v")) if x is None else x
    held = None
    for sweep in range(sweeps):
        for colour in [r.colour for r in classes.select("colour").distinct().orderBy("colour").collect()]:
            of = F.col("colour") == colour
            same = base.filter(~of).select("image_id", "i", F.col("i").alias("j"), F.lit(1.0).alias("v"))
            moved = product(rows.filter(of).drop("colour").unionByName(same))(x)
            x = moved.unionByName(base.filter(of).select("image_id", "i", "v")).groupBy("image_id", "i").agg(F.sum("v").alias("v"))
        if sweep + 1 < sweeps:
            x = keep(x)
            drop(held)
            held = x
    return x
