"""Collision-shape extents, volumes and boxes."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from scenelake.functions import quaternions as Q
from scenelake.functions import vectors as V

SHAPES = ("cube", "sphere", "cylinder", "capsule")


def half_extents(shape: Column, size: Column) -> Column:
    """Local half-extents; a capsule's caps lengthen its Z extent by one radius."""
    return F.when(shape == "capsule", F.array(size[0], size[1], size[2] + size[0])).otherwise(size)


def circumradius(shape: Column, size: Column) -> Column:
    extents = half_extents(shape, size)
    return F.when(shape == "sphere", size[0]).otherwise(V.norm(extents))


def proxy_volume(shape: Column, size: Column) -> Column:
    radius = size[0]
    ball = 4.0 / 3.0 * math.pi * F.pow(radius, F.lit(3.0))
    tube = math.pi * F.pow(radius, F.lit(2.0)) * (2.0 * size[2])
    return (
        F.when(shape == "cube", 8.0 * size[0] * size[1] * size[2])
        .when(shape == "sphere", ball)
        .when(shape == "cylinder", tube)
        .when(shape == "capsule", tube + ball)
    )


def _turned_extents(shape: Column, size: Column, quaternion: Column) -> Column:
    local = half_extents(shape, size)
    return V.bind(local, lambda h: F.array(*[
        F.abs(row[0]) * h[0] + F.abs(row[1]) * h[1] + F.abs(row[2]) * h[2] for row in Q.matrix(quaternion)
    ]))


def rotated_extents(shape: Column, size: Column, quaternion: Column) -> Column:
    """Half-extents of the axis-aligned box around the rotated shape."""
    return F.when(shape == "sphere", F.array(size[0], size[0], size[0])).otherwise(_turned_extents(shape, size, quaternion))


def box_corners(position: Column, quaternion: Column, lower: Column, upper: Column) -> Column:
    """Eight world-space corners, X slowest and Z fastest, of a local box."""
    rows = Q.matrix(quaternion)
    corners = []
    for picks in itertools.product((lower, upper), repeat=3):
        local = [picks[axis][axis] for axis in range(3)]
        corners.append(F.array(*[
            position[i] + rows[i][0] * local[0] + rows[i][1] * local[1] + rows[i][2] * local[2]
            for i in range(3)
        ]))
    return F.array(*corners)


def scaled_box_corners(position: Column, quaternion: Column, bounds: Column, scale: Column) -> Column:
    """Corners of an asset's ``bounds`` (two vectors) under a per-axis scale."""
    low = F.array(*[bounds[0][i] * scale[i] for i in range(3)])
    high = F.array(*[bounds[1][i] * scale[i] for i in range(3)])
    return box_corners(position, quaternion, low, high)


def oriented_bounds(shape: Column, size: Column, position: Column, quaternion: Column) -> Column:
    """Struct of ``lower`` and ``upper``: the box around the eight rotated corners.

    The extreme corner on an axis sums the absolute contributions of the three edges.
    """
    return V.bind(_turned_extents(shape, size, quaternion), lambda reach: F.struct(
        V.subtract(position, reach).alias("lower"), V.add(position, reach).alias("upper")))


def corner_targets(position: Column, radius: Column) -> Column:
    """Corners of the axis-aligned cube of half-width ``radius`` about a position."""
    return V.bind(radius, lambda half: F.array(*[
        F.array(*[position[i] + sign[i] * half for i in range(3)])
        for sign in itertools.product((-1.0, 1.0), repeat=3)
    ]))
