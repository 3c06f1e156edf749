"""Example builders: complete scenes, per-view crops and user functions per scene."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenelake.operators import pixels as P
from scenelake.sources import scenes as S


def complete_examples(files: DataFrame, metadata: DataFrame, instances: DataFrame, frames: DataFrame,
                      layers: Sequence[str] = S.LAYERS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Metadata, instances and frames of complete scenes only.

    The filter acts on the file listing; the tables are then reduced by semi joins, so
    nothing of an incomplete scene is read further.
    """
    whole = S.complete_scenes(files, layers).select("scene")
    keep = lambda df: df.join(whole, "scene", "left_semi")
    return keep(metadata), keep(instances), keep(frames)


def with_variant_fields(instances: DataFrame, extra: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Adds per-variant fields to instances by scene and position in the instance list."""
    return instances.join(extra.select("scene", "position", *fields), ["scene", "position"])


def view_examples(frames: DataFrame, boxes: DataFrame, size: int = 512) -> DataFrame:
    """Pixels of each view cropped to its object's box, keyed ``<scene>_<frame>``.

    ``boxes`` holds scene, frame, asset_id and fractional y_min, x_min, y_max, x_max; box
    edges are truncated to pixels and the crop includes the far edge.
    """
    edges = {e: (F.col(e) * size).cast("int") for e in ("y_min", "x_min", "y_max", "x_max")}
    cut = P.crop(P.to_pixels(frames), boxes.select(*P.FRAME, "asset_id", *[v.alias(k) for k, v in edges.items()]))
    key = F.concat_ws("_", F.col("scene").cast("string"), F.format_string("%05d", "frame"))
    return cut.select(key.alias("key"), F.regexp_replace("asset_id", "_", "/").alias("asset_id"), "y", "x", "segmentation")


def map_scenes(scenes: DataFrame, generate: Callable[[dict], object], schema: str, splits: Sequence[str],
               scene: str = "scene") -> DataFrame:
    """Rows of a user function called once per scene.

    The function returns one example, a list of them, or a mapping from split to either.
    With several splits the mapping is required. Keys are ``<scene>_<i>`` within a split.
    """
    names = list(splits)

    def examples(output: object) -> dict[str, list[dict]]:
        by_split = isinstance(output, Mapping) and set(output) <= set(names) and len(output) > 0
        if not by_split:
            if len(names) != 1:
                raise ValueError("several splits need a mapping from split to examples")
            output = {names[0]: output}
        return {k: [v] if isinstance(v, Mapping) else list(v) for k, v in output.items()}

    target = T.StructType.fromDDL(f"split STRING, key STRING, {schema}")
    fields = target.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for record in batch.to_dict("records"):
                for split, items in examples(generate(record)).items():
                    rows += [{"split": split, "key": f"{record[scene]}_{i}", **item} for i, item in enumerate(items)]
            yield pd.DataFrame(rows, columns=fields)

    return scenes.mapInPandas(run, target)


def write_by_split(examples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    examples.write.mode(mode).partitionBy("split").parquet(path)
