"""Conjugate gradients with vectors as tables, for images that no task holds.

A vector is a table (image_id, i, one column for each right side); an operator is any function
from such a table to another, a sparse product or a chain of window sums. All images and all right
sides run side by side; each stops by itself. A step writes one table (two with a preconditioner
that is an operator), reads it back for the inner products, and deletes the one before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweave.plans.lineage import dealt, drop, keep, small, wide

Operator = Callable[[DataFrame], DataFrame]
#: Steps between looks at the residuals; a finished image keeps its answer meanwhile.
CHECK = 5


def product(a: DataFrame, columns: list[str] | None = None, rows: int | None = None) -> Operator:
    """The sparse product with ``a`` (image_id, i, j, v), for all ``columns`` of a vector at once.

    With the number of unknowns (``rows``), columns of ``a`` are packed once into a table that ``close`` deletes, and
    both shuffles are dealt by rows: entries compress so well that tasks of some bytes would hold too many.
    """
    columns = columns or ["v"]
    if rows is None:
        left, back, closing = a.withColumnRenamed("v", "__a"), lambda df: df, lambda: None
    else:
        packed = keep(dealt(a, rows, "image_id", "j").groupBy("image_id", "j").agg(F.collect_list(F.struct("i", F.col("v").alias("__a"))).alias("cells")))
        left, back, closing = dealt(packed, rows, "image_id", "j"), lambda df: dealt(df, rows, "image_id", "i"), lambda: drop(packed)

    def apply(x: DataFrame) -> DataFrame:
        x = x.select("image_id", F.col("i").alias("j"), *columns)
        terms = left.join(wide(x if rows is None else dealt(x, rows, "image_id", "j")), ["image_id", "j"])
        if rows is not None:
            terms = terms.select("image_id", *columns, F.inline("cells"))
        terms = back(terms.select("image_id", "i", *[(F.col("__a") * F.col(c)).alias(c) for c in columns]))
        return terms.groupBy("image_id", "i").agg(*[F.sum(c).alias(c) for c in columns])

    apply.close = closing
    return apply


def _try(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def solve(apply: Operator, b: DataFrame, goals: DataFrame, max_iterations: int, columns: list[str] | None = None, x0: DataFrame | None = None, diagonal: DataFrame | None = None, precondition: Operator | None = None) -> DataFrame:
    """(image_id, i, x_c of each column c, steps, residual_c): ``apply``(x) = b for each column.

    ``goals``: (image_id, goal_c), the residual below which column c of an image is done.
    ``diagonal`` (image_id, i, v) divides the residual (Jacobi); ``precondition`` is an operator
    instead. A residual of zero counts as done.
    """
    columns = columns or ["v"]
    per = lambda f: {c: f(c) for c in columns}
    vector = lambda df, kind: df.select("image_id", "i", *[F.col(f"{kind}_{c}").alias(c) for c in columns])
    own = lambda df, kind: df.select("image_id", "i", *[F.col(c).alias(f"{kind}_{c}") for c in columns])
    names = ["image_id", "i", "d", "n", *[f"{k}_{c}" for c in columns for k in ("x", "r", "p", "rz")]]
    many = b.count()
    deal = lambda df: dealt(df, many, "image_id", "i")
    rows = own(b, "b")
    if diagonal is not None:
        rows = deal(rows).join(wide(deal(diagonal.select("image_id", "i", F.col("v").alias("d")))), ["image_id", "i"], "left").fillna(1.0, ["d"])
    else:
        rows = rows.withColumn("d", F.lit(1.0))
    if x0 is None:
        rows = rows.withColumns({f"x_{c}": F.lit(0.0) for c in columns} | {f"r_{c}": F.col(f"b_{c}") for c in columns})
    else:
        rows = rows.join(wide(own(x0, "x")), ["image_id", "i"], "left").join(wide(own(apply(x0), "ax")), ["image_id", "i"], "left").fillna(0.0)
        rows = rows.withColumns({f"r_{c}": F.col(f"b_{c}") - F.col(f"ax_{c}") for c in columns})
    rows = rows.withColumns({"n": F.lit(0), **{f"{k}_{c}": F.lit(0.0) for c in columns for k in ("p", "rz")}})

    def directed(updated: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """x, r, the next direction p and rz from x, r and the last p and rz; and what was kept for it."""
        held = None
        if precondition is None:
            updated = updated.withColumns({f"z_{c}": F.col(f"r_{c}") / F.col("d") for c in columns})
        else:
            updated = held = keep(updated.join(wide(own(precondition(vector(updated, "r")), "z")), ["image_id", "i"], "left").fillna(0.0))
        sums = updated.groupBy("image_id").agg(*[F.sum(F.col(f"r_{c}") * F.col(f"z_{c}")).alias(f"new_{c}") for c in columns])
        updated = updated.join(F.broadcast(sums) if few else sums, "image_id")
        return updated.withColumns({f"p_{c}": F.col(f"z_{c}") + _try(F.col(f"new_{c}"), F.col(f"rz_{c}")) * F.col(f"p_{c}") for c in columns} | {f"rz_{c}": F.col(f"new_{c}") for c in columns}).select(*names), held

    goals = small(goals)
    few = goals.count() <= 200_000
    state, held = directed(rows)
    last, steps = None, 0
    while True:
        full = keep(deal(state).join(wide(own(apply(vector(state, "p")), "q")), ["image_id", "i"], "left").fillna(0.0))
        drop(last, held)
        last, held = full, None
        sums = [F.sum(F.col(f"p_{c}") * F.col(f"q_{c}")).alias(f"pq_{c}") for c in columns] + [F.sqrt(F.sum(F.col(f"r_{c}") * F.col(f"r_{c}"))).alias(f"residual_{c}") for c in columns] + [F.max(f"rz_{c}").alias(f"top_{c}") for c in columns]
        size = full.groupBy("image_id").agg(*sums).join(goals, "image_id")
        live = per(lambda c: (F.col(f"residual_{c}") >= F.col(f"goal_{c}")) & (F.col(f"residual_{c}") > 0))
        some = live[columns[0]]
        for c in columns[1:]:
            some = some | live[c]
        if steps >= max_iterations or (steps % CHECK == 0 and size.filter(some).isEmpty()):
            out = full.join(F.broadcast(size) if few else size, "image_id")
            return out.select("image_id", "i", *[f"x_{c}" for c in columns], F.col("n").alias("steps"), *[f"residual_{c}" for c in columns])
        step = size.select("image_id", some.cast("int").alias("more"), *[F.when(live[c], _try(F.col(f"top_{c}"), F.col(f"pq_{c}"))).otherwise(0.0).alias(f"k_{c}") for c in columns])
        moved = full.join(F.broadcast(step) if few else step, "image_id")
        moved = moved.withColumns({"n": F.col("n") + F.col("more")} | {f"x_{c}": F.col(f"x_{c}") + F.col(f"k_{c}") * F.col(f"p_{c}") for c in columns} | {f"r_{c}": F.col(f"r_{c}") - F.col(f"k_{c}") * F.col(f"q_{c}") for c in columns})
        state, held = directed(moved)
        steps += 1


def least_squares(a: DataFrame, b: DataFrame, columns: list[str] | None = None, max_iterations: int = 1000, tolerance: float = 1e-10) -> DataFrame:
    """(image_id, i, x_c, steps, residual_c) of least |A x - b| for rectangular ``a``: CG on the normal equations by two products a step.

    The residual is that of the normal equations, A'(A x - b).
    """
    columns = columns or ["v"]
    turned = a.select("image_id", F.col("j").alias("i"), F.col("i").alias("j"), "v")
    many = b.count()
    forth, back = product(a, columns, many), product(turned, columns, many)
    side = keep(back(b))
    goals = side.select("image_id").distinct().select("image_id", *[F.lit(float(tolerance)).alias(f"goal_{c}") for c in columns])
    out = solve(lambda x: back(forth(x)), side, goals, max_iterations, columns)
    forth.close()
    back.close()
    return out
