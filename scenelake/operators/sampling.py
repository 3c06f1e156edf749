"""Grid sampling, quotas, draws with replacement, padding and batching."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.functions import hashing as H
from scenelake.functions import vectors as V
from scenelake.operators import ordered


def grid_starts(scenes: DataFrame, stride: int, seed: int) -> DataFrame:
    """Random start of the sampling grid on each axis, drawn per scene."""
    origin = H.derive_seed(seed, F.col("scene"), "grid")
    lanes = {f"{axis}_start": F.floor(H.draw(origin, axis) * stride).cast("int") for axis in ("t", "y", "x")}
    return scenes.withColumns(lanes)


def on_grid(frames: DataFrame, windows: DataFrame, stride: int, layers: Sequence[str],
            vector_layers: Sequence[str] = ()) -> DataFrame:
    """Pixels on a strided grid inside a window.

    ``windows``: scene, window (y0, x0, y1, x1; the end is exclusive), t_start, y_start,
    x_start. Coordinates are generated on the grid and read out of the frame arrays, so
    pixels off the grid never become rows.
    """
    window = F.col("window")
    kept = frames.join(windows, "scene").where(
        (F.col("frame") >= F.col("t_start")) & (F.pmod(F.col("frame") - F.col("t_start"), F.lit(stride)) == 0)
    )
    y_from, x_from = window[0] + F.col("y_start"), window[1] + F.col("x_start")
    kept = kept.where((y_from < window[2]) & (x_from < window[3]))
    ys = F.explode(F.sequence(y_from, window[2] - 1, F.lit(stride)))
    xs = F.explode(F.sequence(x_from, window[3] - 1, F.lit(stride)))
    at = F.col("y") * F.col("width") + F.col("x")
    columns = [F.get(layer, at).alias(layer) for layer in layers]
    columns += [F.array(*[F.get(layer, at * 3 + i) for i in range(3)]).alias(layer) for layer in vector_layers]
    return kept.withColumn("y", ys).withColumn("x", xs).select("scene", "frame", "y", "x", *columns)


def quotas(counts: DataFrame, tracks: int, max_fraction: float) -> DataFrame:
    """Water-filled sample sizes: the scarcest label first, the shortfall carried on.

    ``counts``: scene, label, pixel_count. The fold runs over the labels of one scene.
    """
    items = F.array_sort(F.collect_list(F.struct("pixel_count", "label")))

    def take(state: Column, item: Column) -> Column:
        share = (F.lit(1.0) / (state["left"])).cast("float")
        want = F.bround(state["remaining"].cast("float") * share).cast("int")
        ceiling = F.bround(item["pixel_count"].cast("float") * F.lit(max_fraction).cast("float")).cast("int")
        quota = F.least(want, ceiling)
        return F.struct(
            (state["left"] - 1).alias("left"), (state["remaining"] - quota).alias("remaining"),
            F.concat(state["out"], F.array(F.struct(item["label"].alias("label"), quota.alias("quota")))).alias("out"),
        )

    start = F.struct(
        F.size("_items").alias("left"), F.lit(tracks).alias("remaining"),
        F.expr("cast(array() as array<struct<label:int,quota:int>>)").alias("out"),
    )
    folded = counts.groupBy("scene").agg(items.alias("_items")).withColumn("_fold", F.aggregate("_items", start, take))
    return folded.select("scene", F.inline("_fold.out"))


def draw_with_replacement(population: DataFrame, wanted: DataFrame, keys: Sequence[str], tie_break: Sequence[str],
                          seed: int, quota: str = "quota") -> DataFrame:
    """Uniform draws with replacement: ``quota`` rows per key, numbered from 0."""
    digest = F.lpad(F.lower(F.hex(F.xxhash64(*[F.col(c) for c in (*keys, *tie_break)], F.lit(seed)))), 16, "0")
    ranked = ordered.with_rank(population.withColumn("_digest", digest), keys, "_digest", tie_break, "_rank").drop("_digest")
    sizes = population.groupBy(*keys).agg(F.count("*").alias("_n"))
    origin = H.derive_seed(seed, F.concat_ws(":", *[F.col(k).cast("string") for k in keys]), "draw")
    draws = (
        wanted.where(F.col(quota) > 0).join(sizes, list(keys))
        .select(*keys, "_n", F.explode(F.sequence(F.lit(0), F.col(quota) - 1)).alias("draw"), origin.alias("_seed"))
        .select(*keys, "draw", (F.floor(H.unit_draw(F.concat_ws(":", F.col("_seed").cast("string"), F.col("draw").cast("string"))) * F.col("_n")) + 1).alias("_rank"))
    )
    return draws.join(ranked, [*keys, "_rank"]).drop("_rank")


def pad(rows: DataFrame, length: int, keys: Sequence[str], position: str = "position") -> DataFrame:
    """Extends each key to ``length`` rows by repeating its second-to-last row.

    A key with a single row has no such row and stays as it is.
    """
    sizes = rows.groupBy(*keys).agg(F.max(position).alias("_last")).where(
        (F.col("_last") + 1 < length) & (F.col("_last") >= 1)
    )
    filler = sizes.select(*keys, (F.col("_last") - 1).alias("_source"),
                          F.explode(F.sequence(F.col("_last") + 1, F.lit(length - 1).cast(rows.schema[position].dataType))).alias("_target"))
    source = rows.withColumnRenamed(position, "_source")
    repeated = filler.join(source, [*keys, "_source"]).withColumnRenamed("_target", position)
    return rows.unionByName(repeated.select(*rows.columns))


def batches(items: DataFrame, name: str, batch: int, epochs: int = 1, seed: int = 0) -> DataFrame:
    """Shuffled batches per epoch; every epoch has its own order, short tails are kept."""
    repeated = items.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    digest = H.sha_text(seed, F.col("epoch"), F.col(name))
    ranked = ordered.with_rank(repeated.withColumn("_digest", digest), ["epoch"], "_digest", [name], "_rank")
    return ranked.withColumn("batch", F.floor((F.col("_rank") - 1) / batch)).withColumn(
        "slot", F.pmod(F.col("_rank") - 1, F.lit(batch))
    ).drop("_digest", "_rank")


def crop_windows(scenes: DataFrame, seed: int, area: tuple[float, float] = (0.3, 1.0),
                 aspect: tuple[float, float] = (0.5, 2.0)) -> DataFrame:
    """Random window (top, left, bottom, right) of bounded share of the image and bounded width by height, fitting by construction.

    ``scenes``: scene, height, width. The aspect is drawn from those at which the smallest share fits the image, evenly
    in its logarithm; then the share from those that fit at this aspect. Where the image has no such window at all, the
    window is null.
    """
    h, w = F.col("height"), F.col("width")
    draws = F.array(*[H.draw(H.derive_seed(seed, F.col("scene"), "crop"), i) for i in range(4)])

    def bounds(u: Column) -> Column:
        shape = F.log(w / h)
        low = F.greatest(F.lit(math.log(aspect[0])), shape + math.log(area[0]))
        high = F.least(F.lit(math.log(aspect[1])), shape - math.log(area[0]))
        return V.bind(F.array(low, high - low, shape), lambda b: F.when(b[1] >= 0, sized(u, b[0] + u[1] * b[1], b[2])))

    def sized(u: Column, slant: Column, shape: Column) -> Column:
        largest = F.least(F.lit(area[1]), F.exp(shape - slant), F.exp(slant - shape))
        height = F.sqrt((area[0] + u[0] * (largest - area[0])) * h * w / F.exp(slant))
        whole = lambda size, most: F.least(most.cast("double"), F.greatest(F.lit(1.0), F.bround(size)))
        return V.bind(F.array(whole(height, h), whole(height * F.exp(slant), w)), lambda s: placed(u, s))

    def placed(u: Column, s: Column) -> Column:
        top, left = F.floor(u[2] * (h - s[0] + 1)), F.floor(u[3] * (w - s[1] + 1))
        return F.array(*[v.cast("int") for v in (top, left, top + s[0], left + s[1])])

    return scenes.withColumn("window", V.bind(draws, bounds))
