"""3x3 matrices as array columns of nine doubles, row by row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTITY = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)


def identity() -> Column:
    return F.array(*map(F.lit, IDENTITY))


def product(a: str, b: str) -> Column:
    """a times b, of two columns: b's transform comes first."""
    at = lambda c, i, j: F.col(c)[3 * i + j]
    return F.array(*[at(a, i, 0) * at(b, 0, j) + at(a, i, 1) * at(b, 1, j) + at(a, i, 2) * at(b, 2, j) for i in range(3) for j in range(3)])


def determinant(m: str) -> Column:
    c = [F.col(m)[k] for k in range(9)]
    return c[0] * (c[4] * c[8] - c[5] * c[7]) - c[1] * (c[3] * c[8] - c[5] * c[6]) + c[2] * (c[3] * c[7] - c[4] * c[6])


def inverse(m: str, least: float = 1e-12) -> Column:
    """Null where the determinant is smaller than ``least``."""
    c = [F.col(m)[k] for k in range(9)]
    minor = lambda i, j, k, n: c[i] * c[n] - c[j] * c[k]
    adjugate = [minor(4, 5, 7, 8), minor(2, 1, 8, 7), minor(1, 2, 4, 5), minor(5, 3, 8, 6), minor(0, 2, 6, 8), minor(2, 0, 5, 3), minor(3, 4, 6, 7), minor(1, 0, 7, 6), minor(0, 1, 3, 4)]
    return F.when(F.abs(determinant(m)) >= least, F.array(*[x / determinant(m) for x in adjugate]))


def rigid(cos: Column, sin: Column, tx: Column, ty: Column) -> Column:
    """Rotation (and scale, if cos and sin carry one), then translation."""
    return F.array(cos, -sin, tx, sin, cos, ty, F.lit(0.0), F.lit(0.0), F.lit(1.0))


def moved(m: str, x: str, y: str) -> tuple[Column, Column]:
    """Where a matrix takes a point."""
    c = [F.col(m)[k] for k in range(9)]
    below = c[6] * F.col(x) + c[7] * F.col(y) + c[8]
    return (c[0] * F.col(x) + c[1] * F.col(y) + c[2]) / below, (c[3] * F.col(x) + c[4] * F.col(y) + c[5]) / below
