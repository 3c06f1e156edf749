"""Sparse keyframes and sampled paths evaluated at arbitrary times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.functions import quaternions as Q
from scenelake.functions import vectors as V
from scenelake.operators import ordered
from scenelake.operators.states import continuous_quaternions
from scenelake.session import spread

CHANNEL = ("asset", "member")


def values_at(keyframes: DataFrame, queries: DataFrame, size: int, interpolation: str = "linear",
              keys: Sequence[str] = CHANNEL, block: ordered.Block = ordered.BLOCK) -> DataFrame:
    """As-of value of every queried frame, clamped outside the keyed range.

    ``interpolation`` is ``const`` (previous key), ``nearest`` (a tie goes to the
    previous key) or ``linear``.
    """
    key = F.struct(F.col("frame").alias("frame"), F.col("value").alias("value"))
    # Values of no fixed width are sorted to be grouped: shuffled first, so that no reading task sorts all it has exploded.
    both = (
        keyframes.select(*keys, "frame", key.alias("_key"), F.lit(0).alias("_asked"))
        .unionByName(queries.select(*keys, "frame", F.lit(None).cast("struct<frame:int,value:array<double>>").alias("_key"),
                                    F.lit(1).alias("_asked")))
    )
    merged = (
        spread(both, *keys, "frame").groupBy(*keys, "frame")
        .agg(F.first("_key", ignorenulls=True).alias("_key"), F.max("_asked").alias("_asked"))
    )
    filled = ordered.with_bracket(merged, keys, "frame", "_key", "_left", "_right", block=block)
    asked = filled.where("_asked = 1 and (_left is not null or _right is not null)").withColumns({
        "_left": F.coalesce("_left", "_right"), "_right": F.coalesce("_right", "_left"),
    })
    left, right = F.col("_left"), F.col("_right")
    to_left, to_right = F.col("frame") - left["frame"], right["frame"] - F.col("frame")
    exact = left["frame"] == right["frame"]
    if interpolation == "const":
        # Before the first key the first key applies, so a right fill stands in for a left one.
        value = left["value"]
    elif interpolation == "nearest":
        value = F.when(exact | (F.abs(to_left) <= F.abs(to_right)), left["value"]).otherwise(right["value"])
    elif interpolation == "linear":
        mixing = to_left / (right["frame"] - left["frame"])
        value = F.when(exact, left["value"]).otherwise(V.lerp(left["value"], right["value"], mixing, size))
    else:
        raise ValueError("interpolation must be const, nearest or linear")
    return asked.select(*keys, "frame", value.alias("value"))


def frame_range(scenes: DataFrame, channels: DataFrame) -> DataFrame:
    """Every frame of the inclusive scene range for each channel of the scene's assets."""
    return channels.join(scenes, "scene").select(
        *CHANNEL, F.explode(F.sequence("frame_start", "frame_end")).alias("frame")
    )


def resample(paths: DataFrame, queries: DataFrame, keys: Sequence[str] = ("instance_id",),
             block: ordered.Block = ordered.BLOCK, output_block: ordered.Block | None = ordered.BLOCK) -> DataFrame:
    """Path pose at query times in [0, 1] over uniformly spaced samples.

    ``paths`` holds sample (0-based), position and optionally quaternion; ``queries``
    holds sample (output index) and time. The bracket is an equi join on the sample
    index, so no range condition is needed. ``output_block=None`` suits short outputs.
    """
    rotated = "quaternion" in paths.columns
    lanes = ["position"] + (["quaternion"] if rotated else [])
    source = continuous_quaternions(paths, keys, "sample", block=block) if rotated else paths
    pairs = ordered.with_neighbour(source, keys, "sample", {n: f"_next_{n}" for n in lanes}, ahead=True, block=block)
    sizes = paths.groupBy(*keys).agg((F.max("sample")).alias("_last"))
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("time")))
    located = (
        queries.join(sizes, list(keys))
        .withColumn("_at", clipped * F.col("_last"))
        .withColumn("_segment", F.least(F.floor("_at").cast("int"), (F.col("_last") - 1).cast("int")))
        .withColumn("_fraction", F.col("_at") - F.col("_segment"))
        .select(*keys, F.col("sample").alias("_output"), "_segment", "_fraction")
    )
    joined = located.join(
        pairs.select(*keys, F.col("sample").alias("_segment"), *lanes, *[f"_next_{n}" for n in lanes]),
        [*keys, "_segment"],
    )
    fraction = F.col("_fraction")

    def at_ends(name: str, value: Column) -> Column:
        return F.when(fraction == 0.0, F.col(name)).when(fraction == 1.0, F.col(f"_next_{name}")).otherwise(value)

    columns = [at_ends("position", V.lerp(F.col("position"), F.col("_next_position"), fraction, 3)).alias("position")]
    if rotated:
        columns.append(at_ends("quaternion", Q.slerp(F.col("quaternion"), F.col("_next_quaternion"), fraction)).alias("quaternion"))
    result = joined.select(*keys, F.col("_output").alias("sample"), *columns)
    # A fresh sweep over the output samples; their number is the caller's choice.
    return continuous_quaternions(result, keys, "sample", block=output_block) if rotated else result


def uniform_times(paths: DataFrame, samples: int, keys: Sequence[str] = ("instance_id",)) -> DataFrame:
    """``samples`` evenly spaced query times from 0 to 1 for every path."""
    if samples < 2:
        raise ValueError("a path needs at least two samples")
    grid = F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample")
    return paths.select(*keys).distinct().select(*keys, grid).withColumn(
        "time", F.col("sample") / F.lit(float(samples - 1))
    )
