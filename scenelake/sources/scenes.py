"""Scene folders: completeness, metadata, 8/16-bit frames and layer ranges."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME_SCHEMA = ("scene STRING, layer STRING, frame INT, height INT, width INT, channels INT, bit_depth INT, "
                "values ARRAY<INT>")
LAYERS = ("rgba", "segmentation", "forward_flow", "backward_flow", "depth", "normal", "object_coordinates")
SIDECARS = ("data_ranges.json", "metadata.json", "events.json")


def scene_files(files: DataFrame) -> DataFrame:
    """Scene and file name of paths shaped ``.../<scene>/<file>``."""
    return files.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("scene"),
                        F.substring_index("path", "/", -1).alias("file"))


def complete_scenes(files: DataFrame, layers: Sequence[str] = LAYERS) -> DataFrame:
    """Scenes with all sidecars and as many files of every layer as colour frames.

    Layers are matched by name prefix.
    """
    named = scene_files(files)
    counts = named.groupBy("scene").agg(
        *[F.count_if(F.col("file") == s).alias(f"_s{i}") for i, s in enumerate(SIDECARS)],
        *[F.count_if(F.col("file").startswith(layer)).alias(f"_n_{layer}") for layer in layers],
        F.count_if(F.col("file").startswith("rgba")).alias("_expected"),
    )
    rules = [F.col(f"_s{i}") > 0 for i in range(len(SIDECARS))] + [F.col("_expected") > 0]
    rules += [F.col(f"_n_{layer}") == F.col("_expected") for layer in layers]
    return counts.where(reduce(lambda a, b: a & b, rules)).select("scene", F.col("_expected").alias("frames"))


def read_sidecar(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document per file, tagged with its scene."""
    return spark.read.schema(schema).option("multiLine", "true").json(path).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("scene"), "*"
    )


def _unfilter(raw: np.ndarray, stride: int) -> np.ndarray:
    """Reverses the per-row byte filters of a PNG; ``raw`` has the filter type in column 0."""
    rows, width = raw.shape[0], raw.shape[1] - 1
    out = np.zeros((rows, width), dtype=np.uint8)
    above = np.zeros(width, dtype=np.uint8)
    for y in range(rows):
        kind, line = raw[y, 0], raw[y, 1:].copy()
        if kind == 1:
            lanes = line.reshape(-1, stride)
            line = np.cumsum(lanes, axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            line = line + above
        elif kind in (3, 4):
            lanes, up = line.reshape(-1, stride).astype(np.int32), above.reshape(-1, stride).astype(np.int32)
            left = corner = np.zeros(stride, dtype=np.int32)
            for x in range(len(lanes)):
                if kind == 3:
                    guess = (left + up[x]) // 2
                else:
                    estimate = left + up[x] - corner
                    d_left, d_up, d_corner = abs(estimate - left), abs(estimate - up[x]), abs(estimate - corner)
                    guess = np.where((d_left <= d_up) & (d_left <= d_corner), left, np.where(d_up <= d_corner, up[x], corner))
                corner = up[x]
                left = lanes[x] = (lanes[x] + guess) & 255
            line = lanes.astype(np.uint8).ravel()
        out[y] = above = line
    return out


def decode_png(content: bytes) -> tuple[np.ndarray, int]:
    """Pixels as ``[height, width, channels]`` and the bit depth (8 or 16, not interlaced)."""
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, body, header = 8, [], None
    while at < len(content):
        size, kind = struct.unpack(">I4s", content[at:at + 8])
        data = content[at + 8:at + 8 + size]
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            body.append(data)
        at += size + 12
    width, height, depth, color, _, _, interlace = header
    if depth not in (8, 16) or interlace:
        raise ValueError(f"unsupported bit depth {depth} or interlacing")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    stride = channels * depth // 8
    raw = np.frombuffer(zlib.decompress(b"".join(body)), dtype=np.uint8).reshape(height, 1 + width * stride)
    flat = _unfilter(raw, stride)
    pixels = flat.view(">u2") if depth == 16 else flat
    return pixels.reshape(height, width, channels), depth


def read_frames(spark: SparkSession, path: str, scenes: DataFrame | None = None,
                layers: Sequence[str] | None = None) -> DataFrame:
    """Decoded frames of ``<scene>/<layer>_<frame>.png`` files.

    Scene and layer filters act on the file listing, before any content is decoded.
    """

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                pixels, depth = decode_png(row.content)
                yield pd.DataFrame({
                    "scene": [row.scene], "layer": [row.layer], "frame": [row.frame], "height": [pixels.shape[0]],
                    "width": [pixels.shape[1]], "channels": [pixels.shape[2]], "bit_depth": [depth],
                    "values": [pixels.astype(np.int32).ravel()],
                })

    pattern = r"([^/]+)/([a-z_]+)_(\d+)\.png$"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").load(path)
    named = files.select("content", *[F.regexp_extract("path", pattern, i + 1).alias(n) for i, n in enumerate(("scene", "layer", "frame"))])
    named = named.withColumn("frame", F.col("frame").cast("int"))
    if layers is not None:
        named = named.where(F.col("layer").isin(*layers))
    if scenes is not None:
        named = named.join(scenes.select("scene"), "scene", "left_semi")
    return named.mapInPandas(decode, FRAME_SCHEMA)


def write_layer(frames: DataFrame, layer: str, root: str) -> None:
    """16-bit codes of a floating layer and its per-scene range, as tables below ``root``.

    The scenes given replace what the layer held of them; others stay, so a repeated run changes nothing.
    """
    from scenelake.operators.pixels import encode_layer, layer_ranges

    for name, rows in (("frames", encode_layer(frames, layer)), ("data_ranges", layer_ranges(frames, layer))):
        rows.withColumn("layer", F.lit(layer)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("layer", "scene").parquet(f"{root}/{name}")
