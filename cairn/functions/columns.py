"""Column expressions for 3-D geometry: all stay inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Matrix = list[list[float]]


def dist3(a: tuple, b: tuple) -> Column:
    """Euclidean distance of two points given as three columns each."""
    return F.sqrt(sum((F.col(p) - F.col(q)) * (F.col(p) - F.col(q)) for p, q in zip(a, b, strict=True)))


def affine(matrix: Matrix, x: str = "x", y: str = "y", z: str = "z") -> list[Column]:
    """The transformed coordinates as linear combinations with literal coefficients."""
    return [F.col(x) * F.lit(float(m[0])) + F.col(y) * F.lit(float(m[1])) + F.col(z) * F.lit(float(m[2])) + F.lit(float(m[3])) for m in matrix[:3]]


def rotate(matrix: Matrix, x: str = "nx", y: str = "ny", z: str = "nz") -> list[Column]:
    """Direction columns under the linear part only."""
    return affine([[*m[:3], 0.0] for m in matrix[:3]], x, y, z)


def homogeneous(x: str = "x", y: str = "y", z: str = "z") -> Column:
    """array(x, y, z, 1)."""
    return F.array(F.col(x), F.col(y), F.col(z), F.lit(1.0))


def on_plane(normal: tuple[float, float, float], names: str = "xyz") -> list[Column]:
    """The coordinates without their part along a normal, which need not be a unit vector."""
    size = math.sqrt(sum(k * k for k in normal))
    unit = [k / size for k in normal]
    along = sum(F.col(a) * F.lit(k) for a, k in zip(names, unit, strict=True))
    return [F.col(a) - along * F.lit(k) for a, k in zip(names, unit, strict=True)]


def held(rows, **columns: Column):
    """rows plus the columns, computed once: what is filtered later is not expanded into what comes before."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def clip(c: Column, low: float, high: float) -> Column:
    """c held within [low, high]."""
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def eigen3(cxx: Column, cyy: Column, czz: Column, cxy: Column, cxz: Column, cyz: Column) -> tuple[Column, Column, Column]:
    """Eigenvalues of a symmetric 3x3 matrix, descending, in closed form; null where isotropic."""
    q = (cxx + cyy + czz) / 3
    p2 = ((cxx - q) * (cxx - q) + (cyy - q) * (cyy - q) + (czz - q) * (czz - q) + 2 * (cxy * cxy + cxz * cxz + cyz * cyz)) / 6
    p = F.sqrt(p2)
    a, b, c = cxx - q, cyy - q, czz - q
    det = a * (b * c - cyz * cyz) - cxy * (cxy * c - cyz * cxz) + cxz * (cxy * cyz - b * cxz)
    r = clip(F.try_divide(det, 2 * p * p * p), -1.0, 1.0)
    phi = F.acos(r) / 3
    return q + 2 * p * F.cos(phi), q + 2 * p * F.cos(phi - 2 * math.pi / 3), q + 2 * p * F.cos(phi + 2 * math.pi / 3)


def eigenvector3(value: Column, cxx: Column, cyy: Column, czz: Column, cxy: Column, cxz: Column, cyz: Column) -> Column:
    """The unit eigenvector of a value as struct<x,y,z>: the largest cross product of two rows of C - value I."""
    rows = [(cxx - value, cxy, cxz), (cxy, cyy - value, cyz), (cxz, cyz, czz - value)]
    made = []
    for u, v in ((0, 1), (0, 2), (1, 2)):
        (a1, a2, a3), (b1, b2, b3) = rows[u], rows[v]
        x, y, z = a2 * b3 - a3 * b2, a3 * b1 - a1 * b3, a1 * b2 - a2 * b1
        made.append(F.struct((x * x + y * y + z * z).alias("s"), x.alias("x"), y.alias("y"), z.alias("z")))
    best = F.greatest(*made)
    n = F.sqrt(best["s"])
    return F.struct(*(F.try_divide(best[k], n).alias(k) for k in "xyz"))


def dot3(a: tuple, b: tuple) -> Column:
    """Dot product of two vectors given as three columns each."""
    return sum(F.col(p) * F.col(q) for p, q in zip(a, b, strict=True))


def dot4(a: tuple, b: tuple) -> Column:
    """Dot product of the homogeneous forms, whose fourth components are 1."""
    return dot3(a, b) + F.lit(1.0)


def zyx_angles(x: str, y: str, z: str) -> list[Column]:
    """Angles about z, y, x of a direction, which need not be a unit vector."""
    return [F.lit(0.0), F.atan2(x, z), -F.atan2(y, F.hypot(x, z))]


def vector_angle(y: str, x: str) -> Column:
    """Degrees of atan2."""
    return F.degrees(F.atan2(y, x))


def from_plane(plane: tuple, names: str = "xyz") -> Column:
    """abs(a x + b y + c z + d) of a plane given as four columns or numbers."""
    a, b, c, d = (F.col(k) if isinstance(k, str) else F.lit(float(k)) for k in plane)
    x, y, z = (F.col(n) for n in names)
    return F.abs(a * x + b * y + c * z + d)


def radius_from_area(cm2: Column) -> Column:
    """Radius in metres of a disc of the given area in square centimetres."""
    return F.sqrt(cm2 / math.pi) / 100
