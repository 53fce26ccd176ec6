"""Column functions on channels, trimaps and small matrices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(v: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def gray(r: Column, g: Column, b: Column) -> Column:
    return (299 * r + 587 * g + 114 * b) / 1000


def to_byte(v: Column) -> Column:
    """0..255, truncated."""
    return clip(v * 255, 0.0, 255.0).cast("int")


def dot(a: list[Column], b: list[Column]) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + x * y
    return out


def mat_vec(m: list[list[Column]], v: list[Column]) -> list[Column]:
    return [dot(row, v) for row in m]


def outer(a: list[Column], b: list[Column]) -> list[list[Column]]:
    return [[x * y for y in b] for x in a]


def quadratic(v: list[Column], m: list[list[Column]], w: list[Column]) -> Column:
    return dot(v, mat_vec(m, w))


def inv2(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column, Column, Column]:
    """Inverse of [[a, b], [c, d]]; null when singular."""
    det = F.nullif(a * d - b * c, F.lit(0.0))
    return d / det, -b / det, -c / det, a / det


def sym3_cofactors(m: dict[str, Column]) -> tuple[dict[str, Column], Column]:
    """Cofactors (rr, rg, rb, gg, gb, bb) and determinant of a symmetric 3x3 matrix."""
    c = {
        "rr": m["gg"] * m["bb"] - m["gb"] * m["gb"],
        "rg": m["rb"] * m["gb"] - m["rg"] * m["bb"],
        "rb": m["rg"] * m["gb"] - m["rb"] * m["gg"],
        "gg": m["rr"] * m["bb"] - m["rb"] * m["rb"],
        "gb": m["rg"] * m["rb"] - m["rr"] * m["gb"],
        "bb": m["rr"] * m["gg"] - m["rg"] * m["rg"],
    }
    return c, m["rr"] * c["rr"] + m["rg"] * c["rg"] + m["rb"] * c["rb"]


def trimap_flags(t: Column, soft: bool = False) -> dict[str, Column]:
    """is_fg, is_bg, is_known, is_unknown. soft: above 0.8 and below 0.2 count as known."""
    fg, bg = (t > 0.8, t < 0.2) if soft else (t == 1.0, t == 0.0)
    return {"is_fg": fg, "is_bg": bg, "is_known": fg | bg, "is_unknown": ~(fg | bg)}
