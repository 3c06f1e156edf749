"""JSON manifests, dataset indexes and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenelake.operators import assets as A

ASSET_SCHEMA = (
    "name STRING, data_dir STRING, assets MAP<STRING, STRUCT<asset_type: STRING, license: STRING, path: STRING, "
    "kwargs: STRUCT<bounds: ARRAY<ARRAY<DOUBLE>>, mass: DOUBLE, render_filename: STRING, simulation_filename: STRING>, "
    "metadata: STRUCT<category: STRING, nr_faces: BIGINT, nr_vertices: BIGINT, surface_area: DOUBLE, volume: DOUBLE>>>"
)


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one per file, with an explicit schema."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def write_documents(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON rows with keys in sorted order."""
    df.select(*sorted(df.columns)).write.mode(mode).json(path)


def read_assets(spark: SparkSession, path: str, schema: str = ASSET_SCHEMA) -> DataFrame:
    """One row per asset; name and data_dir default to the manifest's file name and folder."""
    raw = read_documents(spark, path, schema).select(
        F.coalesce("name", F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")).alias("name"),
        F.coalesce("data_dir", F.regexp_replace(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/"), "/[^/]*$", "")).alias("data_dir"),
        "assets",
    )
    flat = A.flatten(raw)
    data_dir, asset_dir = F.col("data_dir"), F.concat_ws("/", F.col("data_dir"), F.col("id"))
    resolved = flat.withColumn("path", A.resolve_path(F.coalesce("path", F.lit("")), data_dir, F.col("id")))
    for name in ("render_filename", "simulation_filename"):
        if name in resolved.columns:
            resolved = resolved.withColumn(name, A.substitute_asset_dir(F.col(name), asset_dir))
    return resolved


def split_index(instances: DataFrame) -> DataFrame:
    """One flat row per instance in (split, id) order, with the path of its artifact."""
    columns = [c for c in ("instance_id", "split", "index", "subject_id", "num_objects", "object_ids", "branches",
                           "visual_scene_hash") if c in instances.columns]
    return instances.select(*columns, F.concat(F.lit("instances/"), "instance_id").alias("path")).orderBy("split", "instance_id")


def object_range(instances: DataFrame) -> DataFrame:
    """Observed bodies per scene, the floor not counted, as ``low-high`` or one number."""
    low, high = F.min(F.col("num_objects") - 1), F.max(F.col("num_objects") - 1)
    return instances.agg(low.alias("low"), high.alias("high")).withColumn(
        "object_range", F.when(F.col("low") == F.col("high"), F.col("low").cast("string")).otherwise(F.concat_ws("-", "low", "high")))


def split_counts_text(instances: DataFrame) -> DataFrame:
    """Text such as ``8 test, 80 train`` in name order, or ``none``."""
    counts = instances.groupBy("split").agg(F.count("*").alias("n"))
    parts = F.array_sort(F.collect_list(F.struct("split", "n")))
    text = F.array_join(F.transform(parts, lambda p: F.concat_ws(" ", p["n"].cast("string"), p["split"])), ", ")
    return counts.agg(F.when(F.count("*") == 0, "none").otherwise(text).alias("counts"))


def size_summary(files: DataFrame) -> DataFrame:
    """File count, bytes and mebibytes to one decimal."""
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes")).withColumn(
        "total_mib", F.bround(F.col("total_bytes") / (1024 * 1024), 1))


def transforms(frames: DataFrame) -> DataFrame:
    """One descriptor per split: horizontal field of view and its frames' poses, as JSON.

    ``frames``: split, fov, file_path, frame, matrix. A split's frames are one video.
    """
    entries = F.transform(
        F.array_sort(F.collect_list(F.struct("frame", "file_path", "matrix"))),
        lambda f: F.struct(f["file_path"].alias("file_path"), f["matrix"].alias("transform_matrix")))
    return frames.groupBy("scene", "split").agg(F.max("fov").alias("camera_angle_x"), entries.alias("frames")).select(
        "scene", "split", F.to_json(F.struct("camera_angle_x", "frames")).alias("descriptor"))
