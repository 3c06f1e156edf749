"""Pinhole-camera column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from scenelake.functions import quaternions as Q
from scenelake.functions import vectors as V


def field_of_view(focal_length: Column, sensor_width: Column) -> Column:
    return 2.0 * F.atan2(sensor_width / 2.0, focal_length)


def focal_length_for(fov: Column, sensor_width: Column) -> Column:
    return sensor_width / (2.0 * F.tan(fov / 2.0))


def sensor_height(sensor_width: Column, width: Column, height: Column) -> Column:
    return sensor_width / width * height


def intrinsics(focal_length: Column, sensor_width: Column, width: Column, height: Column) -> Column:
    """Normalised row-major 3x3 matrix looking down -Z."""
    zero = F.lit(0.0)
    fx = focal_length / sensor_width
    fy = focal_length / sensor_height(sensor_width, width, height)
    return F.array(fx, zero, F.lit(-0.5), zero, -fy, F.lit(-0.5), zero, zero, F.lit(-1.0))


def orthographic_intrinsics(scale: Column) -> Column:
    zero, gain = F.lit(0.0), 2.0 / scale
    return F.array(gain, zero, zero, zero, gain, zero, zero, zero, F.lit(-1.0))


def z_to_depth(z: Column, x: Column, y: Column, width: Column, height: Column,
               focal_length: Column, sensor_width: Column) -> Column:
    """Distance to the camera centre from distance to the camera plane at a pixel centre."""
    px = (x - width / 2.0 + 0.5) / width * sensor_width
    py = (y - height / 2.0 + 0.5) / height * sensor_height(sensor_width, width, height)
    return z * F.sqrt(1.0 + (px * px + py * py) / (focal_length * focal_length))


def project(point: Column, position: Column, quaternion: Column, intrinsic: Column) -> Column:
    """Image coordinates in [0, 1] and the sign of the projective depth as third lane."""
    plane = lambda p, r: intrinsic[3 * r] * p[0] + intrinsic[3 * r + 1] * p[1] + intrinsic[3 * r + 2] * p[2]
    local = V.bind(V.subtract(point, position), lambda p: Q.unrotate(quaternion, p))
    planes = V.bind(local, lambda p: F.array(*[plane(p, r) for r in range(3)]))
    return V.bind(planes, lambda p: F.array(p[0] / p[2], p[1] / p[2], F.signum(p[2])))


def unproject(x: Column, y: Column, depth: Column, width: Column, height: Column,
              position: Column, quaternion: Column, intrinsic: Column) -> Column:
    """World point at ``depth`` along the ray through the centre of pixel (x, y)."""
    u, v = (x + 0.5) / width, (y + 0.5) / height
    # Closed-form inverse of the upper-triangular intrinsics.
    rz = F.lit(1.0) / intrinsic[8]
    ry = (v - intrinsic[5] * rz) / intrinsic[4]
    rx = (u - intrinsic[2] * rz) / intrinsic[0]
    at_depth = V.bind(F.array(rx, ry, rz), lambda ray: V.scale(V.normalise(ray), depth))
    return V.add(V.bind(at_depth, lambda p: Q.rotate(quaternion, p)), position)


def view_axes(position: Column, look_at: Column) -> Column:
    """Struct of a camera's forward, right and up axes; null where it looks at its own place."""
    def with_forward(forward: Column) -> Column:
        side = V.bind(V.cross(forward, V.vector(0.0, 0.0, 1.0)),
                      lambda v: V.normalise(v, V.vector(1.0, 0.0, 0.0), epsilon=1e-9))
        return V.bind(side, lambda right: F.struct(forward.alias("forward"), right.alias("right"), V.cross(right, forward).alias("up")))

    unit = V.bind(V.subtract(look_at, position), lambda v: V.normalise(v))
    return F.when(V.distance(look_at, position) > 1e-9, V.bind(unit, with_forward))


def frustum(focal_length: Column, sensor_width: Column, aspect: Column, margin: Column) -> tuple[Column, Column]:
    """Half width and half height of the view frustum at depth one, shrunk by ``margin``."""
    half_x = sensor_width / 2.0 / focal_length
    half_y = F.when(aspect >= 1.0, half_x / aspect).otherwise(half_x * aspect)
    keep = F.greatest(F.lit(0.0), 1.0 - margin)
    return half_x * keep, half_y * keep


def frames_point(target: Column, position: Column, axes: Column, half_x: Column, half_y: Column) -> Column:
    """Whether a world point lies inside a frustum, given its axes and halves, which are a camera's and not a point's."""
    relative = V.subtract(target, position)
    depth = V.dot(relative, axes["forward"])
    return (
        (depth > 1e-3)
        & (F.abs(V.dot(relative, axes["right"])) / depth <= half_x)
        & (F.abs(V.dot(relative, axes["up"])) / depth <= half_y)
    )


def half_angle(focal_length: float, sensor_width: float) -> float:
    return math.atan2(sensor_width / 2.0, focal_length)
