"""Pixel layers: label maps, visibility, boxes, ranges, resampling and stencils.

Stored form is one row per frame with row-major arrays (``segmentation``, ``depth`` and
so on). The long form is a transient projection that is aggregated at once, and stencils
run on whole frames, so pixels of a frame never travel one by one.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from scenelake.functions import raster
from scenelake.functions import vectors as V

FRAME = ("scene", "frame")


def to_pixels(frames: DataFrame, layers: Sequence[str] = ("segmentation",)) -> DataFrame:
    """One row per pixel with the named single-channel layers."""
    zipped = F.arrays_zip(*[F.col(n) for n in layers]) if len(layers) > 1 else F.col(layers[0])
    long = frames.select(*FRAME, "height", "width", F.posexplode(zipped).alias("_at", "_pixel"))
    values = [F.col("_pixel")[n].alias(n) for n in layers] if len(layers) > 1 else [F.col("_pixel").alias(layers[0])]
    return long.select(
        *FRAME, F.floor(F.col("_at") / F.col("width")).cast("int").alias("y"),
        F.pmod(F.col("_at"), F.col("width")).cast("int").alias("x"), *values,
    )


def label_map(old_assets: DataFrame, new_assets: DataFrame, ignored: int = 0) -> DataFrame:
    """New label of each 1-based old label of a scene.

    An explicit segmentation_id wins, then the 1-based place in the new list, then
    ``ignored``. ``old_assets``: scene, position, asset, segmentation_id (positions are
    0-based); ``new_assets``: scene, position, asset.
    """
    places = new_assets.select("scene", "asset", (F.col("position") + 1).alias("_new"))
    return old_assets.join(places, ["scene", "asset"], "left").select(
        "scene", (F.col("position") + 1).alias("label"),
        F.coalesce("segmentation_id", "_new", F.lit(ignored)).cast("int").alias("new_label"),
    )


def matte_label_map(assets: DataFrame, hashed: Column) -> DataFrame:
    """Label of each matte identifier: the explicit id or the 1-based asset position."""
    return assets.select("scene", hashed.alias("label"),
                         F.coalesce("segmentation_id", F.col("position") + 1).cast("int").alias("new_label"))


def remap_labels(frames: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rewrites segmentation arrays through a per-scene map; unmapped labels become 0.

    A scene has a handful of labels, so they travel as one map per frame row and no
    pixel is shuffled.
    """
    per_scene = mapping.groupBy("scene").agg(
        F.map_from_entries(F.collect_list(F.struct("label", "new_label"))).alias("_map")
    )
    relabel = F.transform("segmentation", lambda label: F.coalesce(F.try_element_at(F.col("_map"), label), F.lit(0)))
    return (
        frames.join(per_scene, "scene", "left")
        .withColumn("segmentation", F.when(F.col("_map").isNull(), F.transform("segmentation", lambda _: F.lit(0))).otherwise(relabel))
        .drop("_map")
    )


def _grid(frames: DataFrame, instances: DataFrame) -> DataFrame:
    return frames.select(*FRAME).distinct().join(instances.select("scene", "label").distinct(), "scene")


def label_boxes(pixels: DataFrame) -> DataFrame:
    """Inclusive pixel box and pixel count of each label present in a frame."""
    return pixels.groupBy(*FRAME, F.col("segmentation").alias("label")).agg(
        F.min("y").alias("y_min"), F.min("x").alias("x_min"),
        F.max("y").alias("y_max"), F.max("x").alias("x_max"), F.count("*").alias("pixel_count"),
    )


def visibility(frames: DataFrame, instances: DataFrame) -> DataFrame:
    """Visible pixels of every listed instance in every frame, zeros included."""
    counts = to_pixels(frames).groupBy(*FRAME, F.col("segmentation").alias("label")).agg(
        F.count("*").alias("_count")
    )
    return _grid(frames, instances).join(counts, [*FRAME, "label"], "left").select(
        *FRAME, "label", F.coalesce("_count", F.lit(0)).alias("visibility")
    )


def normalised_boxes(frames: DataFrame, instances: DataFrame) -> DataFrame:
    """Half-open boxes as fractions of the image; absent instances have no row."""
    sizes = frames.select(*FRAME, "height", "width")
    present = label_boxes(to_pixels(frames)).join(instances.select("scene", "label").distinct(), ["scene", "label"], "left_semi")
    return present.join(sizes, list(FRAME)).select(
        *FRAME, "label",
        (F.col("y_min") / F.col("height")).alias("y_min"), (F.col("x_min") / F.col("width")).alias("x_min"),
        ((F.col("y_max") + 1) / F.col("height")).alias("y_max"), ((F.col("x_max") + 1) / F.col("width")).alias("x_max"),
    )


def tracking_boxes(frames: DataFrame, instances: DataFrame) -> DataFrame:
    """Inclusive pixel boxes for every instance and frame; -1 and count 0 where absent."""
    boxes = label_boxes(to_pixels(frames))
    edges = ("y_min", "x_min", "y_max", "x_max")
    return _grid(frames, instances).join(boxes, [*FRAME, "label"], "left").select(
        *FRAME, "label", *[F.coalesce(F.col(e), F.lit(-1)).alias(e) for e in edges],
        F.coalesce("pixel_count", F.lit(0)).alias("pixel_count"),
    )


def visible_labels(visible: DataFrame) -> DataFrame:
    """Dense labels from 1 for instances seen at least once, most visible pixels first."""
    totals = visible.groupBy("scene", "label").agg(
        F.sum("visibility").alias("total"), F.max("visibility").alias("peak")
    ).where("peak > 0")
    # One row per instance of a scene: the window is as small as the scene's object list.
    rank = F.row_number().over(W.partitionBy("scene").orderBy(F.desc("total"), "label"))
    return totals.select("scene", "label", "total", rank.alias("new_label"))


def segment_histogram(pixels: DataFrame) -> DataFrame:
    """Pixels per label from 0 to the scene's largest label; label -1 is not counted."""
    counts = pixels.where("segmentation >= 0").groupBy("scene", F.col("segmentation").alias("label")).agg(
        F.count("*").alias("_count")
    )
    dense = counts.groupBy("scene").agg(F.max("label").alias("_top")).select(
        "scene", F.explode(F.sequence(F.lit(0), F.col("_top"))).alias("label")
    )
    return dense.join(counts, ["scene", "label"], "left").select(
        "scene", "label", F.coalesce("_count", F.lit(0)).alias("pixel_count")
    )


def layer_ranges(frames: DataFrame, layer: str, scale: float = 1.0) -> DataFrame:
    """Smallest and largest value of a layer over all frames of a scene."""
    per_frame = frames.select("scene", F.array_min(layer).alias("_low"), F.array_max(layer).alias("_high"))
    return per_frame.groupBy("scene").agg(
        (F.min("_low") / scale).alias("low"), (F.max("_high") / scale).alias("high")
    )


def encode_layer(frames: DataFrame, layer: str) -> DataFrame:
    """16-bit codes of a layer over the range of the whole scene, with that range."""
    ranged = frames.join(layer_ranges(frames, layer), "scene")
    return ranged.withColumn(
        layer, F.transform(layer, lambda v: raster.quantise_truncated(v, F.col("low"), F.col("high")))
    )


def merge_ranges(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Upsert of (scene, layer) ranges; fresh rows replace existing ones."""
    return fresh.unionByName(existing.join(fresh, ["scene", "layer"], "left_anti"))


def subsample_nearest(pixels: DataFrame, step_y: int, step_x: int) -> DataFrame:
    """Every ``step``-th pixel, starting at the middle of each cell."""
    off_y, off_x = (step_y - 1) // 2, (step_x - 1) // 2
    kept = pixels.where(
        (F.pmod(F.col("y") - off_y, F.lit(step_y)) == 0) & (F.pmod(F.col("x") - off_x, F.lit(step_x)) == 0)
        & (F.col("y") >= off_y) & (F.col("x") >= off_x)
    )
    return kept.withColumns({
        "y": F.floor((F.col("y") - off_y) / step_y).cast("int"),
        "x": F.floor((F.col("x") - off_x) / step_x).cast("int"),
    })


def subsample_average(pixels: DataFrame, layer: str, bin_y: int, bin_x: int) -> DataFrame:
    """Mean of each cell, ties rounded to even."""
    return pixels.groupBy(
        *FRAME, F.floor(F.col("y") / bin_y).cast("int").alias("y"), F.floor(F.col("x") / bin_x).cast("int").alias("x")
    ).agg(F.bround(F.avg(layer)).cast("int").alias(layer))


def multi_resolution(pixels: DataFrame, factors: Sequence[int]) -> DataFrame:
    """Nearest subsamples at several integer factors, tagged by factor."""
    offsets = F.explode(F.array(*[F.lit(f) for f in factors]))
    tagged = pixels.withColumn("factor", offsets).withColumn("_off", F.floor((F.col("factor") - 1) / 2).cast("int"))
    on_grid = [(F.pmod(F.col(a) - F.col("_off"), F.col("factor")) == 0) & (F.col(a) >= F.col("_off")) for a in ("y", "x")]
    shrink = lambda a: F.floor((F.col(a) - F.col("_off")) / F.col("factor")).cast("int")
    return tagged.where(on_grid[0] & on_grid[1]).withColumns({"y": shrink("y"), "x": shrink("x")}).drop("_off")


def export_flow(pixels: DataFrame, scenes: DataFrame, direction: str) -> DataFrame:
    """Flow scaled by 256 with swapped channels and flipped rows.

    Forward flow loses its last frame; backward flow loses its first, is negated and
    takes the index of the frame before. ``scenes``: scene, height, last_frame.
    """
    joined = pixels.join(scenes, "scene")
    sign = 1.0 if direction == "forward" else -1.0
    kept = joined.where(F.col("frame") < F.col("last_frame")) if direction == "forward" else joined.where(
        F.col("frame") > 0).withColumn("frame", F.col("frame") - 1)
    return kept.select(
        *FRAME, (F.col("height") - 1 - F.col("y")).alias("y"), "x",
        (F.col("d_col") * 256 * sign).alias("u"), (F.col("d_row") * 256 * sign).alias("v"), F.lit(1.0).alias("occlusion"),
    )


def crop(pixels: DataFrame, boxes: DataFrame, keys: Sequence[str] = FRAME) -> DataFrame:
    """Pixels inside an inclusive box, re-based to the box corner."""
    return pixels.join(boxes, list(keys)).where(
        F.col("y").between(F.col("y_min"), F.col("y_max")) & F.col("x").between(F.col("x_min"), F.col("x_max"))
    ).withColumns({"y": F.col("y") - F.col("y_min"), "x": F.col("x") - F.col("x_min")})


def palette_violations(frames: DataFrame) -> DataFrame:
    """Frames whose labels do not fit: above 255 would wrap, above 65535 or below 0 is invalid."""
    top, low = F.array_max("segmentation"), F.array_min("segmentation")
    verdict = F.when((top > 65535) | (low < 0), "invalid").when(top > 255, "wraps")
    return frames.select(*FRAME, top.alias("max_label"), verdict.alias("verdict")).where("verdict is not null")


def _limits(frames: DataFrame, layer: str) -> tuple[float, float]:
    return (0.0, 1.0) if frames.schema[layer].dataType.elementType.typeName() in ("float", "double") else (0, 65535)


def _unfit(frames: DataFrame, layer: str) -> Column:
    low, high = _limits(frames, layer)
    return F.coalesce(F.exists(layer, lambda v: v.isNull() | ~v.between(low, high)), F.lit(True))


def image_violations(frames: DataFrame, layer: str) -> DataFrame:
    """Frames whose ``layer`` no image can hold: whole numbers below 0 or above 65535, fractions outside [0, 1] or not finite."""
    return frames.where(_unfit(frames, layer)).select(*FRAME, F.array_min(layer).alias("low"), F.array_max(layer).alias("high"))


def guarded(frames: DataFrame, layer: str) -> DataFrame:
    """``frames``, whose ``layer`` is an error where no image can hold it, for a writer to read."""
    low, high = _limits(frames, layer)
    where = F.concat(F.lit(f"{layer} of scene "), F.col("scene").cast("string"), F.lit(", frame "), F.col("frame").cast("string"), F.lit(f": values outside {low} to {high}"))
    return frames.withColumn(layer, F.when(_unfit(frames, layer), F.raise_error(where).cast(frames.schema[layer].dataType)).otherwise(F.col(layer)))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _erode(segmentation: pd.Series, depth: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    result = []
    for labels, metres, h, w in zip(segmentation, depth, height, width):
        metres = np.asarray(metres, dtype=np.float64).reshape(h, w)
        padded = np.pad(metres, 1, mode="symmetric")
        nearest = np.full((h, w), np.inf)
        for dy, dx in np.ndindex(3, 3):
            if (dy, dx) != (1, 1):
                nearest = np.minimum(nearest, padded[dy:dy + h, dx:dx + w])
        kept = np.where(nearest < metres * 0.95, -1, np.asarray(labels).reshape(h, w))
        result.append(kept.astype(np.int32).ravel())
    return pd.Series(result)


def erode(frames: DataFrame) -> DataFrame:
    """Marks -1 every pixel with a neighbour nearer than 95 % of its own depth."""
    return frames.withColumn("segmentation", _erode("segmentation", "depth", "height", "width"))


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _trust(normals: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    result = []
    for flat, h, w in zip(normals, height, width):
        centre = np.asarray(flat, dtype=np.float64).reshape(h, w, 3)
        padded = np.pad(centre, ((1, 1), (1, 1), (0, 0)))
        rough = np.zeros((h, w), dtype=np.int32)
        for dy in (0, 2):
            for dx in (0, 2):
                jump = padded[dy:dy + h, dx:dx + w] - centre
                rough += np.sum(jump * jump, axis=-1) > 0.05 * 0.05
        result.append((rough <= 2).ravel())
    return pd.Series(result)


def trusted_normals(frames: DataFrame) -> DataFrame:
    """Adds ``trusted``: at most two of the four diagonal neighbours differ roughly."""
    return frames.withColumn("trusted", _trust("normal", "height", "width"))


def with_hidden(points: DataFrame, frames: DataFrame, chunk: int = 256) -> DataFrame:
    """Adds ``hidden``: whether a projected point lies behind a surface or on foreign labels.

    ``points`` carries scene, point (dense from 0), frame, px, py (raster coordinates),
    limit (depth below which the surface hides the point), label and any other columns.
    Points meet their frame in lists of at most ``chunk``, so each frame array is shipped
    once per list instead of once per point, and neither side grows without bound.
    """
    rest = [c for c in points.columns if c not in FRAME]
    packed = points.groupBy(*FRAME, F.floor(F.col("point") / chunk).alias("_chunk")).agg(
        F.collect_list(F.struct(*rest)).alias("_points")
    )
    clamp = lambda v, top: F.greatest(F.lit(0), F.least(v, top))
    h, w = F.col("_h"), F.col("_w")

    def corners(p: Column) -> Column:
        # Raster to pixel coordinates, then the four surrounding pixels.
        left, upper = F.floor(p["px"] - 0.5), F.floor(p["py"] - 0.5)
        xs = [clamp(left, w - 1), clamp(left + 1, w - 1)]
        ys = [clamp(upper, h - 1), clamp(upper + 1, h - 1)]
        return F.array(*[(y * w + x).cast("int") for y in ys for x in xs])

    def verdict(p: Column) -> Column:
        def judge(cells: Column) -> Column:
            surface = F.greatest(*[F.get("_depth", cells[i]) for i in range(4)])
            foreign = [F.get("_labels", cells[i]) != p["label"] for i in range(4)]
            return (surface < p["limit"]) | (foreign[0] & foreign[1] & foreign[2] & foreign[3])

        return F.struct(p.alias("row"), V.bind(corners(p), judge).alias("hidden"))

    layers = frames.select(*FRAME, F.col("height").alias("_h"), F.col("width").alias("_w"),
                           F.col("depth").alias("_depth"), F.col("segmentation").alias("_labels"))
    return (
        packed.join(layers, list(FRAME))
        .select(*FRAME, F.explode(F.transform("_points", verdict)).alias("_v"))
        .select(*FRAME, F.col("_v.row.*"), F.col("_v.hidden").alias("hidden"))
    )
