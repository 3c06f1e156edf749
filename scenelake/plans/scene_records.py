"""Scenes put together at a target size: one record per scene, and every layer's frames shrunk to it.

Frames stay rows of their own, so a scene's length bounds no task. What holds for the scene (its ranges, whether all
frames are there, whether the size is a whole fraction) is gathered once per scene and joined to the rows that need it;
a scene that breaks a rule stops the job that reads its frames, or is listed by :func:`faults`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.functions import raster
from scenelake.plans.annotations import layers_at

#: Layers under another name in the record, and the channels kept of a layer.
RENAMED = {"segmentation": "segmentations", "rgba": "video"}
CHANNELS = {"rgba": 3, "forward_flow": 2, "backward_flow": 2}
FLOWS = ("forward_flow", "backward_flow")
#: Shrunk by cell means; the others by picking.
AVERAGED = ("rgba",)


def _picked(values: Column, width: Column, factor: Column, height_out: Column, width_out: Column) -> Column:
    """Every ``factor``-th value of a one-channel image from the middle of each cell, as the layers of codes are picked."""
    start = F.floor((factor - 1) / 2)
    row, column = lambda i: F.floor(i / width_out) * factor + start, lambda i: F.pmod(i, width_out) * factor + start
    return F.transform(F.sequence(F.lit(0), height_out * width_out - 1), lambda i: F.get(values, (row(i) * width + column(i)).cast("int")))


def _first_channels(values: Column, channels: Column, kept: Column) -> Column:
    return F.when(channels == kept, values).otherwise(F.filter(values, lambda _, i: F.pmod(i, channels) < kept))


def faults(frames: DataFrame, depth: DataFrame, metadata: DataFrame, height: int, width: int, layers: Sequence[str]) -> DataFrame:
    """scene and reason: a size that is no whole fraction, or a layer without some frame (each scene's first fault)."""
    tall, wide = F.col("resolution")[1], F.col("resolution")[0]
    uneven = metadata.where((tall * width != wide * height) | (F.pmod(tall, F.lit(height)) != 0)).select("scene", F.lit(0).alias("rank"), F.lit("size").alias("fault"))
    there = frames.select("scene", "layer", "frame").unionByName(depth.select("scene", F.lit("depth").alias("layer"), "frame"))
    counts = there.join(metadata.select("scene", "num_frames"), "scene").where("frame >= 0 AND frame < num_frames").groupBy("scene", "layer").agg(F.countDistinct("frame").alias("n"))
    wanted = metadata.select("scene", "num_frames", F.explode(F.array(*[F.lit(x) for x in layers])).alias("layer"))
    missing = wanted.join(counts, ["scene", "layer"], "left").where(F.coalesce("n", F.lit(0)) < F.col("num_frames"))
    short = missing.select("scene", F.lit(1).alias("rank"), F.concat(F.lit("frames of "), "layer").alias("fault"))
    return uneven.unionByName(short).groupBy("scene").agg(F.min(F.struct("rank", "fault"))["fault"].alias("reason"))


def _sound(rows: DataFrame, column: str, broken: DataFrame) -> DataFrame:
    """``rows`` whose ``column`` is an error in broken scenes."""
    stop = F.raise_error(F.concat(F.lit("scene "), F.col("scene").cast("string"), F.lit(": "), "reason")).cast(rows.schema[column].dataType)
    joined = rows.join(broken, "scene", "left")
    return joined.withColumn(column, F.when(F.col("reason").isNotNull(), stop).otherwise(F.col(column))).drop("reason")


def depth_ranges(depth: DataFrame, height: int, width: int) -> DataFrame:
    """scene, low and high of the depth that is left after picking."""
    small = _shrunk_depth(depth, height, width)
    return small.groupBy("scene").agg(F.min(F.array_min("values")).alias("low"), F.max(F.array_max("values")).alias("high"))


def _shrunk_depth(depth: DataFrame, height: int, width: int) -> DataFrame:
    factor = F.floor(F.col("height") / height).cast("int")
    return depth.withColumn("values", _picked(F.col("values"), F.col("width"), factor, F.lit(height), F.lit(width)))


def assemble(frames: DataFrame, depth: DataFrame, ranges: DataFrame, metadata: DataFrame, events: DataFrame,
             height: int, width: int, layers: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(records, layers) of scenes at ``height`` by ``width``.

    ``frames``: scene, layer, frame, height, width, channels, values (codes); ``depth``: scene, frame, height, width,
    values (floats); ``ranges``: scene, layer, low, high; ``metadata``: scene, num_frames, num_instances and resolution
    (width, height); ``events``: scene, one row per event. Depth becomes 16-bit codes over the range of the picked depths.
    """
    broken = faults(frames, depth, metadata, height, width, layers)
    asked = frames.where(F.col("layer").isin(*[x for x in layers if x != "depth"])).join(metadata.select("scene", "num_frames"), "scene").where("frame < num_frames").drop("num_frames")
    kept = F.lit(None).cast("int")
    for layer, channels in CHANNELS.items():
        kept = F.when(F.col("layer") == layer, F.lit(channels)).otherwise(kept)
    kept = F.coalesce(kept, F.col("channels"))
    sized = layers_at(_sound(asked, "values", broken), height, AVERAGED)
    codes = sized.withColumn("values", _first_channels(F.col("values"), F.col("channels"), kept)).withColumn("channels", kept)
    name = F.col("layer")
    for layer, other in RENAMED.items():
        name = F.when(F.col("layer") == layer, other).otherwise(name)
    parts = codes.select("scene", name.alias("layer"), "frame", "height", "width", "channels", "values")

    flows = ranges.where(F.col("layer").isin(*FLOWS)).groupBy("scene").agg(*[F.max(F.when(F.col("layer") == x, F.struct("low", "high"))).alias(x) for x in FLOWS])
    scale = F.col("resolution")[1] / height
    record = metadata.join(events.groupBy("scene").agg(F.count("*").alias("events")), "scene", "left").join(flows, "scene", "left")
    columns = [F.array(*[F.col(x)[side] / scale for side in ("low", "high")]).alias(f"{x}_range") for x in FLOWS if x in layers]
    if "depth" in layers:
        span = depth_ranges(_sound(depth, "values", broken), height, width)
        record = record.join(span, "scene", "left")
        columns.append(F.array("low", "high").alias("depth_range"))
        # A layer of one depth has no range: all its codes are 0.
        code = lambda v: F.when(F.col("high") > F.col("low"), raster.quantise(v, F.col("low"), F.col("high"))).otherwise(0)
        deep = _shrunk_depth(_sound(depth, "values", broken), height, width).join(span, "scene").select(
            "scene", F.lit("depth").alias("layer"), "frame", F.lit(height).alias("height"), F.lit(width).alias("width"), F.lit(1).alias("channels"), F.transform("values", code).alias("values"))
        parts = parts.unionByName(deep)
    records = record.select("scene", F.col("scene").cast("string").alias("video_name"), F.lit(height).alias("height"), F.lit(width).alias("width"), "num_frames", "num_instances",
                            F.coalesce("events", F.lit(0)).alias("events"), *columns)
    return records, parts
