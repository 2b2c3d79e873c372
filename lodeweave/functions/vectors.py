"""Vectors as arrays: norms, products and cosines inside the JVM, with double arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = Column | str


def vector(v: Vector | Sequence[float]) -> Column:
    """A column, a column's name, or a literal, as an array of doubles."""
    if isinstance(v, (Column, str)):
        return (F.col(v) if isinstance(v, str) else v).cast("array<double>")
    return F.array(*[F.lit(float(x)) for x in v])


def dot(a: Vector | Sequence[float], b: Vector | Sequence[float]) -> Column:
    """Over the shorter length."""
    pairs = F.zip_with(vector(a), vector(b), lambda x, y: F.coalesce(x * y, F.lit(0.0)))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Vector | Sequence[float]) -> Column:
    return F.sqrt(F.aggregate(vector(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Vector | Sequence[float], b: Vector | Sequence[float]) -> Column:
    """0 where either vector has no length."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale).otherwise(F.lit(0.0))


def normalize(a: Vector) -> Column:
    """To length 1; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(vector(a), lambda x: x / n)).otherwise(vector(a))


def to_literal(a: Vector) -> Column:
    """``[x,y,...]`` with 8 decimals at most."""
    number = lambda x: F.regexp_replace(F.regexp_replace(F.format_string("%.8f", x), r"0+$", ""), r"\.$", "")
    return F.concat(F.lit("["), F.array_join(F.transform(vector(a), number), ","), F.lit("]"))


def from_literal(c: Vector) -> Column:
    """The inverse of ``to_literal``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.transform(F.split(F.regexp_replace(c, r"[\[\]\s]", ""), ","), lambda x: x.cast("double"))
