"""Quaternion algebra; component order is W, X, Y, Z everywhere."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from scenelake.functions import vectors as V


def unit(q: Column) -> Column:
    return V.bind(q, lambda v: V.normalise(v, fallback=V.vector(1.0, 0.0, 0.0, 0.0), size=4))


def from_xyzw(q: Column) -> Column:
    return F.array(q[3], q[0], q[1], q[2])


def to_xyzw(q: Column) -> Column:
    return F.array(q[1], q[2], q[3], q[0])


def conjugate(q: Column) -> Column:
    return F.array(q[0], -q[1], -q[2], -q[3])


def multiply(a: Column, b: Column) -> Column:
    return F.array(
        a[0] * b[0] - a[1] * b[1] - a[2] * b[2] - a[3] * b[3],
        a[0] * b[1] + a[1] * b[0] + a[2] * b[3] - a[3] * b[2],
        a[0] * b[2] - a[1] * b[3] + a[2] * b[0] + a[3] * b[1],
        a[0] * b[3] + a[1] * b[2] - a[2] * b[1] + a[3] * b[0],
    )


def matrix(q: Column) -> list[list[Column]]:
    """Rotation matrix rows of a unit quaternion."""
    w, x, y, z = V.parts(q, 4)
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ]


def rotate(q: Column, v: Column) -> Column:
    return F.array(*[row[0] * v[0] + row[1] * v[1] + row[2] * v[2] for row in matrix(q)])


def unrotate(q: Column, v: Column) -> Column:
    """Rotation by the inverse, i.e. the transposed matrix."""
    m = matrix(q)
    return F.array(*[m[0][j] * v[0] + m[1][j] * v[1] + m[2][j] * v[2] for j in range(3)])


def about_axis(axis: str, angle: Column) -> Column:
    half = angle / 2.0
    zero = F.lit(0.0)
    lanes = [F.sin(half) if axis == name else zero for name in "XYZ"]
    return F.array(F.cos(half), *lanes)


def yaw(angle: Column) -> Column:
    return about_axis("Z", angle)


def from_euler(x: Column, y: Column, z: Column) -> Column:
    """Rotations about X, then Y, then Z."""
    return multiply(multiply(about_axis("Z", z), about_axis("Y", y)), about_axis("X", x))


def angle_between(a: Column, b: Column) -> Column:
    """Sign-invariant geodesic distance in radians; inputs need not be unit length."""
    cosine = F.abs(V.dot(a, b, 4)) / (V.norm(a, 4) * V.norm(b, 4))
    return 2.0 * F.acos(F.least(F.lit(1.0), cosine))


def unit_angle_between(a: Column, b: Column) -> Column:
    """The same distance for inputs already known to be unit length."""
    return 2.0 * F.acos(F.least(F.lit(1.0), F.abs(V.dot(a, b, 4))))


def from_matrix(m: list[list[Column]]) -> Column:
    """Unit quaternion of a rotation matrix, taking the numerically largest pivot."""
    xx, yy, zz = m[0][0], m[1][1], m[2][2]
    rows = [
        lambda t: [t, m[2][1] - m[1][2], m[0][2] - m[2][0], m[1][0] - m[0][1]],
        lambda t: [m[2][1] - m[1][2], t, m[1][0] + m[0][1], m[0][2] + m[2][0]],
        lambda t: [m[0][2] - m[2][0], m[1][0] + m[0][1], t, m[2][1] + m[1][2]],
        lambda t: [m[1][0] - m[0][1], m[0][2] + m[2][0], m[2][1] + m[1][2], t],
    ]

    def build(pivots: Column) -> Column:
        largest = F.array_max(pivots)
        result = None
        for index, lanes in enumerate(rows):
            value = F.array(*[lane * 0.5 / F.sqrt(largest) for lane in lanes(largest)])
            chosen = pivots[index] == largest
            result = F.when(chosen, value) if result is None else result.when(chosen, value)
        return result

    return V.bind(F.array(1 + xx + yy + zz, 1 + xx - yy - zz, 1 - xx + yy - zz, 1 - xx - yy + zz), build)


def look_at(position: Column, target: Column) -> Column:
    """Orientation whose -Z axis faces ``target`` with +Y up and world up +Z."""
    unit_of = lambda v, fallback=None: V.bind(v, lambda u: V.normalise(u, fallback, epsilon=1e-8))

    def with_front(front: Column) -> Column:
        return V.bind(unit_of(V.cross(V.vector(0.0, 0.0, 1.0), front), V.vector(1.0, 0.0, 0.0)),
                      lambda right: with_axes(front, right))

    def with_axes(front: Column, right: Column) -> Column:
        # Local basis: right' = Y x (-Z) = -X, up' = Y, front' = -Z.
        return V.bind(unit_of(V.cross(front, right)),
                      lambda up: from_matrix([[-right[i], up[i], -front[i]] for i in range(3)]))

    return V.bind(unit_of(V.subtract(target, position)), with_front)


def slerp(left: Column, right: Column, fraction: Column) -> Column:
    """Spherical interpolation, falling back to a straight blend for nearly equal inputs."""

    def blend(cosine: Column) -> Column:
        angle = F.acos(cosine)
        straight = cosine > 1.0 - 1e-10
        weights = F.array(
            F.when(straight, 1.0 - fraction).otherwise(F.sin((1.0 - fraction) * angle) / F.sin(angle)),
            F.when(straight, fraction).otherwise(F.sin(fraction * angle) / F.sin(angle)),
        )
        return V.bind(weights, lambda w: F.array(*[w[0] * left[i] + w[1] * right[i] for i in range(4)]))

    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), V.dot(left, right, 4)))
    return unit(V.bind(cosine, blend))


def uniform_rotation(u1: Column, u2: Column, u3: Column) -> Column:
    """Uniformly distributed rotation from three independent unit draws."""
    inner, outer = F.sqrt(1.0 - u1), F.sqrt(u1)
    return F.array(
        inner * F.sin(2 * math.pi * u2), inner * F.cos(2 * math.pi * u2),
        outer * F.sin(2 * math.pi * u3), outer * F.cos(2 * math.pi * u3),
    )
