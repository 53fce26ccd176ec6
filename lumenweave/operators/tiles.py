"""Incomplete factors of overlapping tiles, as a preconditioner for images that no task holds."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenweave.operators.kernels import csr, factor_with_retries
from lumenweave.plans.lineage import drop, keep, small

#: Side of a tile without its overlap, and pixels that it shares with each neighbour's inside.
SIDE, OVERLAP = 48, 4


class TileFactors:
    """Thresholded incomplete Cholesky factors of the matrix ``a`` restricted to each tile and its overlap.

    ``solve`` sends a vector's entries to their tiles, solves there and adds up what comes back
    (additive Schwarz): a sum of symmetric positive terms, so CG may use it. A tile is a group of its own,
    factored once; its factor is kept as a row.
    """

    def __init__(self, a: DataFrame, sizes: DataFrame, threshold: float = 1e-4, regularization: float = 0.0, pattern_only: bool = False, side: int = SIDE, overlap: int = OVERLAP) -> None:
        spots = a.filter("i = j").select("image_id", "i").join(small(sizes.select("image_id", "w", "h").distinct()), "image_id")
        near = lambda c, n: F.sequence(F.greatest(F.lit(0).cast("long"), F.floor((c - overlap) / side)), F.least(F.floor((n - 1) / side), F.floor((c + overlap) / side)))
        x, y = F.col("i") % F.col("w"), F.floor(F.col("i") / F.col("w"))
        members = spots.withColumn("tx", F.explode(near(x, F.col("w")))).withColumn("ty", F.explode(near(y, F.col("h"))))
        self._members = keep(members.select("image_id", "i", (F.col("ty") * F.ceil(F.col("w") / side) + F.col("tx")).alias("tile")))
        inside = a.join(self._members, ["image_id", "i"]).join(self._members.withColumnRenamed("i", "j"), ["image_id", "tile", "j"])

        def factor(m: pd.DataFrame) -> pd.DataFrame:
            ids, i = np.unique(m["i"].to_numpy(), return_inverse=True)
            made = factor_with_retries(csr(i, np.searchsorted(ids, m["j"].to_numpy()), m["v"].to_numpy(), len(ids)), threshold, regularization, pattern_only)
            return pd.DataFrame({"image_id": [m["image_id"].iloc[0]], "tile": [m["tile"].iloc[0]], "factor": [pickle.dumps((ids, made))]})

        self._factors = keep(inside.groupBy("image_id", "tile").applyInPandas(factor, "image_id long, tile long, factor binary"))

    def solve(self, r: DataFrame) -> DataFrame:
        """(image_id, i, v) of a vector (image_id, i, v)."""
        there = r.join(self._members, ["image_id", "i"]).select(F.col("image_id").alias("own_id"), F.col("tile").alias("own_tile"), "i", "v")

        def one(held: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            if not len(held) or not len(rows):
                return pd.DataFrame({"image_id": [], "i": [], "v": []})
            ids, factor = pickle.loads(held["factor"].iloc[0])
            b = np.zeros(len(ids))
            b[np.searchsorted(ids, rows["i"].to_numpy())] = rows["v"].to_numpy()
            return pd.DataFrame({"image_id": held["image_id"].iloc[0], "i": ids, "v": factor.solve(b)})

        answers = self._factors.groupBy("image_id", "tile").cogroup(there.groupBy("own_id", "own_tile")).applyInPandas(one, "image_id long, i long, v double")
        return answers.groupBy("image_id", "i").agg(F.sum("v").alias("v"))

    def close(self) -> None:
        """Delete the factors."""
        drop(self._members, self._factors)
