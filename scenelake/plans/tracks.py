"""Point tracks through a video from depth, labels, object coordinates and poses."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.functions import camera as C
from scenelake.functions import hashing as H
from scenelake.functions import quaternions as Q
from scenelake.functions import raster
from scenelake.functions import vectors as V
from scenelake.operators import pixels as P
from scenelake.operators import sampling as M
from scenelake.session import cut_lineage

POINT = ("scene", "point")


def box_to_world(local: Column, corners: Column) -> Column:
    """World position of a unit-box coordinate, from the box's eight world corners.

    The least-squares map of the unit-cube corners has a closed form, since their normal
    matrix is diagonal: each axis is half the signed sum of the corners, the origin
    their mean.
    """
    signs = list(itertools.product((-0.5, 0.5), repeat=3))
    lanes = []
    for i in range(3):
        origin = reduce(lambda a, b: a + b, [corners[k][i] for k in range(8)]) / 8.0
        value = origin
        for axis in range(3):
            column = reduce(lambda a, b: a + b, [corners[k][i] * signs[k][axis] for k in range(8)]) / 2.0
            value = value + local[axis] * column
        lanes.append(value)
    return F.array(*lanes)


def reproject(points: DataFrame, cameras: DataFrame, objects: DataFrame) -> DataFrame:
    """Every point in every frame: world position, raster coordinates, depth, behind flag.

    ``points``: scene, point, label, local (box or world coordinates). Label 0 is the
    static background; label ``k`` is object ``k - 1``. ``cameras``: scene, frame,
    position, quaternion, focal_length, sensor_width, height, width. ``objects``: scene,
    object_index, frame, corners, quaternion.
    """
    lens = C.intrinsics(F.col("focal_length"), F.col("sensor_width"), F.col("width"), F.col("height"))
    view = cameras.select(
        "scene", "frame", F.col("position").alias("camera_position"), F.col("quaternion").alias("camera_quaternion"),
        lens.alias("intrinsic"), "height", "width",
    )
    bodies = objects.select("scene", (F.col("object_index") + 1).alias("label"), "frame", "corners",
                            F.col("quaternion").alias("object_quaternion"))
    placed = points.join(view, "scene").join(bodies, ["scene", "label", "frame"], "left")
    world = F.when(F.col("label") == 0, F.col("local")).otherwise(box_to_world(F.col("local"), F.col("corners")))
    image = C.project(F.col("world"), F.col("camera_position"), F.col("camera_quaternion"), F.col("intrinsic"))
    return (
        placed.withColumn("world", world).withColumn("_image", image)
        .withColumn("px", F.col("_image")[0] * F.col("width")).withColumn("py", F.col("_image")[1] * F.col("height"))
        .withColumn("behind", F.col("_image")[2] < 0)
        .withColumn("point_depth", V.distance(F.col("world"), F.col("camera_position")))
        .drop("_image", "intrinsic", "corners", "camera_quaternion")
    )


def with_query_pose(points: DataFrame, cameras: DataFrame, objects: DataFrame) -> DataFrame:
    """Adds each point's normal in its object's frame and whether that normal counts.

    A point that already faces away from the camera in its own query frame is exempt, as
    are the background and untrusted normals. All of this belongs to the point, so it is
    settled before the points meet the other frames.
    """
    eyes = cameras.select("scene", F.col("frame").alias("query_frame"), F.col("position").alias("_eye"))
    pose = objects.select("scene", (F.col("object_index") + 1).alias("label"), F.col("frame").alias("query_frame"),
                          F.col("quaternion").alias("_q"), F.col("corners").alias("_c"))
    joined = points.join(eyes, ["scene", "query_frame"]).join(pose, ["scene", "label", "query_frame"], "left")
    staged = joined.withColumn("_at", box_to_world(F.col("local"), F.col("_c")))
    away = V.dot(F.col("normal"), V.subtract(F.col("_at"), F.col("_eye"))) > 0
    counts = (F.col("label") > 0) & F.col("trusted") & ~F.coalesce(away, F.lit(True))
    return staged.withColumn("faces", counts).withColumn("object_normal", Q.unrotate(F.col("_q"), F.col("normal"))).drop(
        "_eye", "_q", "_c", "_at")


def with_occlusion(tracks: DataFrame, frames: DataFrame, windows: DataFrame) -> DataFrame:
    """Adds ``occluded``: behind, hidden, outside the window or facing away."""
    normal = Q.rotate(F.col("object_quaternion"), F.col("object_normal"))
    away = V.bind(normal, lambda n: V.dot(n, V.subtract(F.col("world"), F.col("camera_position")))) > 0
    judged = P.with_hidden(
        tracks.withColumn("limit", F.col("point_depth") * 0.99)
        .withColumn("turned", F.coalesce(F.col("faces") & away, F.lit(False)))
        .drop("object_quaternion", "object_normal", "world", "camera_position"), frames
    )
    w = F.col("window")
    outside = (F.col("py") < w[0]) | (F.col("px") < w[1]) | (F.col("py") > w[2]) | (F.col("px") > w[3])
    return judged.join(windows.select("scene", "window"), "scene").withColumn(
        "occluded", F.col("behind") | F.col("hidden") | outside | F.col("turned")).drop("hidden", "turned", "limit")


def snap_queries(points: DataFrame, frames: DataFrame, seed: int) -> DataFrame:
    """Now and then moves a query next to a depth edge one pixel onto the surface behind.

    ``points`` must carry ``surface_depth``, the depth under the query pixel, and
    ``origin``, the number the draws belong to.
    """
    origin = F.concat_ws("/", F.lit(str(seed)), F.col("scene").cast("string"), F.col("origin").cast("string"))
    shift = lambda lane: F.floor(H.draw(origin, lane) * 3).cast("int") - 1
    clamp = lambda v, top: F.greatest(F.lit(0), F.least(v, top))
    near = points.join(frames.select("scene", F.col("frame").alias("query_frame"), "depth",
                                     F.col("height").alias("_h"), F.col("width").alias("_w")), ["scene", "query_frame"])
    moved_y = clamp(F.col("query_y") + shift("y"), F.col("_h") - 1)
    moved_x = clamp(F.col("query_x") + shift("x"), F.col("_w") - 1)
    far = F.get("depth", moved_y * F.col("_w") + moved_x)
    swap = (F.col("surface_depth") < far * 0.95) & (H.draw(origin, "swap") < 0.5)
    return near.withColumns({
        "query_y": F.when(swap, moved_y).otherwise(F.col("query_y")),
        "query_x": F.when(swap, moved_x).otherwise(F.col("query_x")),
    }).drop("depth", "_h", "_w")


def query_points(frames: DataFrame, cameras: DataFrame, windows: DataFrame, tracks: int = 256, stride: int = 4,
                 max_fraction: float = 0.1, seed: int = 0) -> DataFrame:
    """Sampled query points with their local coordinates, numbered from 0 in each scene.

    ``frames`` carries height, width, segmentation, depth (metric), normal (in [-1, 1]),
    trusted and object_coordinates (16-bit codes).
    """
    grids = M.grid_starts(windows, stride, seed)
    population = M.on_grid(
        frames, grids, stride, ("segmentation", "depth", "trusted"), ("normal", "object_coordinates")
    ).withColumnRenamed("segmentation", "label")
    counts = P.segment_histogram(population.withColumnRenamed("label", "segmentation"))
    quota = M.quotas(counts, tracks, max_fraction)
    drawn = M.draw_with_replacement(
        population.where(F.col("label") >= 0), quota, ("scene", "label"), ("frame", "y", "x"), seed
    )
    # Labels of a scene are few, so the running offset is a small per-scene fold.
    firsts = quota.groupBy("scene").agg(F.collect_list(F.struct("label", "quota")).alias("_q")).select(
        "scene", F.explode("_q").alias("_item"),
        "_q",
    ).select(
        "scene", F.col("_item.label").alias("label"),
        F.aggregate(F.filter("_q", lambda q: q["label"] < F.col("_item.label")), F.lit(0), lambda a, q: a + q["quota"]).alias("_first"),
    )
    lens = C.intrinsics(F.col("focal_length"), F.col("sensor_width"), F.col("width"), F.col("height"))
    background = C.unproject(F.col("x"), F.col("y"), F.col("depth"), F.col("width"), F.col("height"),
                             F.col("position"), F.col("quaternion"), F.col("intrinsic"))
    local = F.array(*[raster.dequantise(F.col("object_coordinates")[i], F.lit(0.0), F.lit(1.0)) - 0.5 for i in range(3)])
    return (
        drawn.join(firsts, ["scene", "label"])
        .join(cameras.withColumn("intrinsic", lens), ["scene", "frame"])
        .select(
            "scene", (F.col("_first") + F.col("draw")).cast("int").alias("point"), "label",
            F.col("frame").alias("query_frame"), F.col("y").alias("query_y"), F.col("x").alias("query_x"),
            F.col("depth").alias("surface_depth"), "normal", "trusted",
            F.when(F.col("label") == 0, background).otherwise(local).alias("local"),
        )
    )


def track_table(frames: DataFrame, cameras: DataFrame, objects: DataFrame, windows: DataFrame,
                tracks: int = 256, stride: int = 4, max_fraction: float = 0.1,
                snap: bool = False, train_size: tuple[int, int] | None = None, flip: bool = False,
                seed: int = 0) -> DataFrame:
    """One row per (scene, point, frame): query, target, occlusion and relative depth.

    Coordinates are relative to the window, scaled to the full image (or ``train_size``).
    ``windows``: scene, window, frame_count.
    """
    prepared = P.trusted_normals(frames)
    if snap:
        prepared = P.erode(prepared)
    sampled = query_points(prepared, cameras, windows, tracks, stride, max_fraction, seed)
    # Padding repeats points, so it happens before they are followed through the frames.
    points = M.pad(cut_lineage(sampled.withColumn("origin", F.col("point"))), tracks, ("scene",), "point")
    if snap:
        points = snap_queries(points, prepared, seed)
    posed = with_query_pose(points, cameras, objects).drop("normal", "trusted", "origin")
    tracked = with_occlusion(reproject(posed, cameras, objects), prepared, windows)
    w, h_px, w_px = F.col("window"), F.col("height"), F.col("width")
    rows, cols = (F.lit(train_size[0]), F.lit(train_size[1])) if train_size else (h_px, w_px)
    # A vertical flip negates the coordinate without re-basing it.
    sign = -1.0 if flip else 1.0
    return tracked.select(
        *POINT, "frame", "label", F.col("query_frame").cast("double").alias("query_t"),
        ((F.col("query_y") + 0.5 - w[0]) / (w[2] - w[0]) * rows * sign).alias("query_y"),
        ((F.col("query_x") + 0.5 - w[1]) / (w[3] - w[1]) * cols).alias("query_x"),
        ((F.col("px") - w[1]) / (w[3] - w[1]) * cols).alias("target_x"),
        ((F.col("py") - w[0]) / (w[2] - w[0]) * rows * sign).alias("target_y"),
        "occluded", (F.col("point_depth") / F.col("surface_depth")).alias("relative_depth"),
    )


def normalise_video(value: Column) -> Column:
    """8-bit intensity to [-1, 1]."""
    return value / (255.0 / 2.0) - 1.0
