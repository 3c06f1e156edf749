"""Per-frame annotations of scenes: poses, boxes, image positions, layers at a target size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenelake.functions import camera as C
from scenelake.functions import raster
from scenelake.functions import shapes


def scene_summary(frames: DataFrame) -> DataFrame:
    """Inclusive frame count and range of each scene."""
    return frames.groupBy("scene").agg(
        F.min("frame").alias("frame_start"), F.max("frame").alias("frame_end"),
        (F.max("frame") - F.min("frame") + 1).alias("num_frames"))


def _image(point, prefix: str = "camera_"):
    lens = C.intrinsics(F.col("focal_length"), F.col("sensor_width"), F.col("width"), F.col("height"))
    return C.project(point, F.col(f"{prefix}position"), F.col(f"{prefix}quaternion"), lens)


def _views(cameras: DataFrame) -> DataFrame:
    return cameras.select("scene", "frame", F.col("position").alias("camera_position"), F.col("quaternion").alias("camera_quaternion"),
                          "focal_length", "sensor_width", "height", "width")


def instance_frames(poses: DataFrame, cameras: DataFrame, instances: DataFrame) -> DataFrame:
    """Pose, eight box corners, image position and in-front flag of each instance and frame.

    ``poses``: scene, object_index, frame, position, quaternion; ``instances``: scene,
    object_index, bounds (two vectors) and scale.
    """
    joined = poses.join(instances.select("scene", "object_index", "bounds", "scale"), ["scene", "object_index"]).join(
        _views(cameras), ["scene", "frame"])
    placed = joined.withColumn("_image", _image(F.col("position"))).withColumn(
        "corners", shapes.scaled_box_corners(F.col("position"), F.col("quaternion"), F.col("bounds"), F.col("scale")))
    return placed.select("scene", "object_index", "frame", "position", "quaternion", "corners",
                         F.slice("_image", 1, 2).alias("image_position"), (F.col("_image")[2] > 0).alias("in_front"))


def collision_image_positions(collisions: DataFrame, cameras: DataFrame) -> DataFrame:
    """Image position of each collision, seen at the whole frame it falls in."""
    seen = collisions.withColumn("_frame", F.floor("frame").cast("int")).join(
        _views(cameras).withColumnRenamed("frame", "_frame"), ["scene", "_frame"])
    return seen.withColumn("image_position", F.slice(_image(F.col("position")), 1, 2)).select(*collisions.columns, "image_position")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _resized(values: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series, factor: pd.Series, average: pd.Series) -> pd.Series:
    result = []
    for flat, h, w, c, k, mean in zip(values, height, width, channels, factor, average):
        if h % k or w % k:
            raise ValueError(f"a {h}x{w} frame cannot shrink by {k}")
        image = np.asarray(flat).reshape(h, w, c)
        if mean:
            # Ties go to the even value.
            small = np.round(image.reshape(h // k, k, w // k, k, c).mean(axis=(1, 3)))
        else:
            small = image[(k - 1) // 2::k, (k - 1) // 2::k]
        result.append(small.astype(np.int32).ravel())
    return pd.Series(result)


def layers_at(frames: DataFrame, target_height: int, averaged: tuple[str, ...] = ("rgba",)) -> DataFrame:
    """Decoded frames shrunk by a whole factor: colour by cell means, other layers by picking.

    Each frame is a row of its own, so nothing is shuffled.
    """
    factor = (F.col("height") / target_height).cast("int")
    shrunk = frames.withColumn("_k", factor)
    return shrunk.withColumn("values", _resized("values", "height", "width", "channels", "_k", F.col("layer").isin(*averaged))).withColumns(
        {"height": (F.col("height") / F.col("_k")).cast("int"), "width": (F.col("width") / F.col("_k")).cast("int")}).drop("_k")


def quantised_depth(frames: DataFrame, ranges: DataFrame) -> DataFrame:
    """16-bit depth codes over each scene's range (columns low and high)."""
    return frames.join(ranges, "scene").withColumn(
        "depth", F.transform("depth", lambda d: raster.quantise(d, F.col("low"), F.col("high"))))


def flow_ranges(ranges: DataFrame, factor: int) -> DataFrame:
    """Stored flow ranges in units of the smaller image."""
    return ranges.withColumns({"low": F.col("low") / factor, "high": F.col("high") / factor})
