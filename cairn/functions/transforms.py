"""Rigid and scaling transforms as small driver-side values.

A plan only ever sees a transform's coefficients as literals, so any chain of
transforms costs one projection.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np


@dataclass(frozen=True)
class Transform:
    """An immutable 4x4 matrix; 3x3 and 3x4 are promoted."""

    mat: np.ndarray = field(default_factory=lambda: np.eye(4))

    def __post_init__(self):
        given = np.array(self.mat, float)
        if given.shape not in ((3, 3), (3, 4), (4, 4)):
            raise ValueError(f"a transform is 3x3, 3x4 or 4x4, not {given.shape}")
        whole = np.eye(4)
        whole[: given.shape[0], : given.shape[1]] = given
        whole.setflags(write=False)
        object.__setattr__(self, "mat", whole)

    def then(self, other: Transform) -> Transform:
        """Apply this, then the other."""
        return Transform(other.mat @ self.mat)

    def inverse(self) -> Transform:
        return Transform(np.linalg.inv(self.mat))

    def apply(self, points: np.ndarray) -> np.ndarray:
        points = np.atleast_2d(np.asarray(points, float))
        return points @ self.mat[:3, :3].T + self.mat[:3, 3]

    def rows(self) -> list[list[float]]:
        return self.mat.tolist()


def identity() -> Transform:
    return Transform(np.eye(4))


def translation(x: float, y: float, z: float) -> Transform:
    m = np.eye(4)
    m[:3, 3] = x, y, z
    return Transform(m)


def scaling(factor: float) -> Transform:
    if factor == 0:
        raise ValueError("a scale of zero has no inverse")
    return Transform(np.diag([factor, factor, factor, 1.0]))


def depth_offset(depth: float) -> Transform:
    return translation(0, 0, -depth)


def xy_origin(x: float, y: float) -> Transform:
    return translation(-x, -y, 0)


def axis_angle(axis, angle: float) -> Transform:
    """Right-handed turn about an axis."""
    u = np.asarray(axis, float)
    u = u / np.linalg.norm(u)
    cross = np.array([[0, -u[2], u[1]], [u[2], 0, -u[0]], [-u[1], u[0], 0]])
    return Transform(math.cos(angle) * np.eye(3) + math.sin(angle) * cross + (1 - math.cos(angle)) * np.outer(u, u))


def euler(rx: float, ry: float, rz: float) -> Transform:
    """Rx * Ry * Rz: the turn about z comes first."""
    return axis_angle([0, 0, 1], rz).then(axis_angle([0, 1, 0], ry)).then(axis_angle([1, 0, 0], rx))


def up_vector(up) -> Transform:
    """Turns the given up direction onto +Z."""
    u = np.asarray(up, float) / np.linalg.norm(up)
    axis = np.cross(u, [0, 0, 1])
    s, c = np.linalg.norm(axis), u[2]
    if s < 1e-12:
        return identity() if c > 0 else axis_angle([1, 0, 0], math.pi)
    return axis_angle(axis, math.atan2(s, c))


def align_x(vector) -> Transform:
    """Turns a vector's xy part onto +X."""
    return axis_angle([0, 0, 1], -math.atan2(vector[1], vector[0]))


def helper_axis(n: np.ndarray) -> np.ndarray:
    """X, or Y for a unit vector that is nearly along X."""
    return np.array([1.0, 0, 0]) if abs(n[0]) < 0.9 else np.array([0, 1.0, 0])


def plane_axes(normal) -> tuple[np.ndarray, np.ndarray]:
    """Two unit vectors across a normal: the helper axis laid into the plane, and what makes it right-handed."""
    n = np.asarray(normal, float) / np.linalg.norm(normal)
    a = helper_axis(n)
    u = a - (a @ n) * n
    u /= np.linalg.norm(u)
    return u, np.cross(n, u)


def align_normal_to_z(normal) -> Transform:
    """A frame whose third axis is the normal; its first is level with the helper axis."""
    n = np.asarray(normal, float) / np.linalg.norm(normal)
    first = np.cross(helper_axis(n), n)
    first /= np.linalg.norm(first)
    return Transform(np.stack([first, np.cross(n, first), n]))


def half_turn() -> Transform:
    return axis_angle([0, 0, 1], math.pi)


def dot3(a, b) -> float:
    """Dot product of the xyz parts."""
    return float(np.dot(np.asarray(a, float)[:3], np.asarray(b, float)[:3]))


def dot4(a, b) -> float:
    """Dot product of homogeneous vectors, the fourth component 1 where missing."""
    whole = lambda v: np.append(np.asarray(v, float)[:3], v[3] if len(v) > 3 else 1.0)
    return float(np.dot(whole(a), whole(b)))


def intrinsic_zyx(vector) -> tuple[float, float, float]:
    """Angles about z, y, x of a direction."""
    x, y, z = np.asarray(vector, float) / np.linalg.norm(vector)
    return 0.0, math.atan2(x, z), -math.atan2(y, math.hypot(x, z))


def vector_angle(y: float, x: float) -> float:
    """Degrees of atan2."""
    return math.degrees(math.atan2(y, x))
