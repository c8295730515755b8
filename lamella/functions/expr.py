"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def f32(x: Column | float) -> Column:
    """Single precision. A threshold must be so wide too, else 51/255 passes 0.2."""
    return (x if isinstance(x, Column) else F.lit(float(x))).cast("float")


def unit(p: str | Column) -> Column:
    """Grey level 0 to 255 as single-precision 0 to 1."""
    return f32(col(p) / 255)


def clamp(x: str | Column, lo: float | Column, hi: float | Column) -> Column:
    wide = lambda b: b if isinstance(b, Column) else F.lit(b)
    return F.least(F.greatest(col(x), wide(lo)), wide(hi))


def to_grey(x: str | Column) -> Column:
    """0 to 1 as a grey level, truncated."""
    return clamp(col(x) * 255, 0.0, 255.0).cast("smallint")


def half_even(x: str | Column) -> Column:
    """Nearest integer, halves to the even one."""
    return F.rint(col(x)).cast("int")


def plain(x: Column, digits: int = 6) -> Column:
    """Rounded for results; no negative zero."""
    return F.round(x.cast("double"), digits) + F.lit(0.0)
