"""Orientation of a cloud from aggregated statistics only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.columns import affine, rotate
from cairn.functions.transforms import Transform, align_x, depth_offset, half_turn, identity, scaling, translation, up_vector


def transform_points(points: DataFrame, transform: Transform) -> DataFrame:
    """Coordinates moved, normals turned (and kept unit where the transform scales)."""
    new = dict(zip("xyz", affine(transform.rows()), strict=True))
    if "nx" in points.columns:
        size = abs(float(__import__("numpy").linalg.det(transform.mat[:3, :3]))) ** (1 / 3) or 1.0
        new |= dict(zip(("nx", "ny", "nz"), (c / size for c in rotate(transform.rows())), strict=True))
    return points.withColumns(new)


def centroid_shift(points: DataFrame) -> DataFrame:
    """points about their centroid."""
    c = F.broadcast(points.agg(*(F.avg(a).alias(f"_m{a}") for a in "xyz")))  # one row
    return points.crossJoin(c).withColumns({a: F.col(a) - F.col(f"_m{a}") for a in "xyz"}).drop("_mx", "_my", "_mz")


def original_coords(rows: DataFrame, transform: Transform) -> DataFrame:
    """rows plus orig_x, orig_y, orig_z: where they were before the transform."""
    return rows.withColumns({f"orig_{a}": c for a, c in zip("xyz", affine(transform.inverse().rows()), strict=True)})


def turn_to(points: DataFrame, vector) -> DataFrame:
    """points turned so that the vector points up."""
    return transform_points(points, up_vector(vector))


def positive_xy(points: DataFrame) -> Transform:
    """The shift that takes points out of negative x and y; none for an empty cloud."""
    low = points.agg(F.min("x").alias("x"), F.min("y").alias("y")).first()
    return identity() if low.x is None else translation(-min(0.0, low.x), -min(0.0, low.y), 0.0)


def orientation(points: DataFrame, scale: float | None = None, up=None, depth: float | None = None, z_half_turn: bool = False) -> Transform:
    """scale, up vector, depth, principal axis along X, +Y upslope, positive xy, half turn.

    The covariance is carried through each turn (C' = R C R^T), so one pass over the
    points gives every angle; the shift needs one more pass for the bounds.
    """
    whole = identity()
    if scale is not None:
        whole = whole.then(scaling(scale))
    if up is not None:
        whole = whole.then(up_vector(up))
    if depth is not None:
        whole = whole.then(depth_offset(depth))
    s = points.agg(F.count("*").alias("n"), *(F.covar_samp(a, b).alias(a + b) for a, b in (("x", "x"), ("y", "y"), ("z", "z"), ("x", "y"), ("x", "z"), ("y", "z")))).first()
    if s.n >= 2:
        import numpy as np

        c = np.array([[s.xx, s.xy, s.xz], [s.xy, s.yy, s.yz], [s.xz, s.yz, s.zz]])
        c = whole.mat[:3, :3] @ c @ whole.mat[:3, :3].T
        angle = 0.5 * math.atan2(2 * c[0, 1], c[0, 0] - c[1, 1])
        turn = align_x((math.cos(angle), math.sin(angle)))
        whole = whole.then(turn)
        c = turn.mat[:3, :3] @ c @ turn.mat[:3, :3].T
        if c[1, 2] < 0:
            whole = whole.then(half_turn())
    whole = whole.then(positive_xy(transform_points(points.select("x", "y", "z"), whole)))
    return whole.then(half_turn()) if z_half_turn else whole


def orient(points: DataFrame, **steps) -> DataFrame:
    """points under their orientation."""
    return transform_points(points, orientation(points, **steps))
