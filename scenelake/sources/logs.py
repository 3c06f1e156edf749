"""Simulation logs: generation-addressed tables, and the raw JSON-lines / array form."""

from __future__ import annotations

import io
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from scenelake.session import missing

CONTACT_SCHEMA = (
    "step INT, object_a STRING, object_b STRING, position ARRAY<DOUBLE>, normal ARRAY<DOUBLE>, "
    "normal_force DOUBLE, contact_distance DOUBLE, schema_version STRING"
)
STATE_SCHEMA = (
    "path STRING, step_index INT, object_index INT, position ARRAY<DOUBLE>, quaternion ARRAY<DOUBLE>, "
    "linear_velocity ARRAY<DOUBLE>, angular_velocity ARRAY<DOUBLE>"
)


def table_digest(df: DataFrame) -> str:
    """Digest of a table's rows that does not depend on their order or partitioning."""
    row = F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).cast("decimal(20,0)")
    part = df.agg(F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).alias("s"),
                  F.bit_xor(F.xxhash64(F.lit(1), *[F.col(c) for c in sorted(df.columns)])).alias("x"))
    text = F.sha2(F.concat_ws("/", F.lit(",".join(sorted(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields))), *[F.col(c).cast("string") for c in ("n", "s", "x")]), 256)
    return part.select(text.alias("digest")).first()["digest"]


def current_generation(spark: SparkSession, root: str) -> str | None:
    try:
        row = spark.read.schema("generation STRING").json(f"{root}/current").first()
    except AnalysisException as error:
        if not missing(error):
            raise
        return None
    return row["generation"] if row else None


def _present(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(f"{path}/complete").first()
        return True
    except AnalysisException as error:
        if not missing(error):
            raise
        return False


def write_generation(tables: Mapping[str, DataFrame], root: str, overwrite: bool = False,
                     partition_by: Mapping[str, list[str]] | None = None) -> str:
    """Writes tables under a content-derived generation, then swings the pointer.

    A half-written generation is never visible, since the pointer moves last; a complete
    one with the same content is reused. An existing pointer is an error unless
    ``overwrite``.
    """
    import hashlib

    spark = next(iter(tables.values())).sparkSession
    if not overwrite and current_generation(spark, root) is not None:
        raise FileExistsError(f"{root} already holds a generation")
    digests = "".join(f"{name}:{table_digest(df)};" for name, df in sorted(tables.items()))
    generation = hashlib.sha256(digests.encode()).hexdigest()
    folder = f"{root}/generations/{generation}"
    if not _present(spark, folder):
        for name, df in tables.items():
            layout = (partition_by or {}).get(name, ["branch"] if "branch" in df.columns else [])
            order = [c for c in ("instance_id", "scene", "step", "frame") if c in df.columns and c not in layout]
            out = df.sortWithinPartitions(*order) if order else df
            out.write.mode("overwrite").partitionBy(*layout).parquet(f"{folder}/{name}")
        marker = spark.createDataFrame([(digests,)], "value STRING")
        marker.coalesce(1).write.mode("overwrite").text(f"{folder}/complete")
    pointer = spark.createDataFrame([(generation,)], "generation STRING")
    pointer.coalesce(1).write.mode("overwrite").json(f"{root}/current")
    return generation


def generation_tables(spark: SparkSession, root: str) -> list[str]:
    """Names of the tables of the current generation."""
    generation = current_generation(spark, root)
    if generation is None:
        raise FileNotFoundError(f"{root} holds no generation")
    recorded = spark.read.text(f"{root}/generations/{generation}/complete").first()["value"]
    return [entry.split(":")[0] for entry in recorded.split(";") if entry]


def read_generation(spark: SparkSession, root: str, names: list[str], verify: bool = False) -> dict[str, DataFrame]:
    """Tables of the current generation; ``verify`` recomputes every digest first."""
    generation = current_generation(spark, root)
    if generation is None:
        raise FileNotFoundError(f"{root} holds no generation")
    folder = f"{root}/generations/{generation}"
    tables = {name: spark.read.parquet(f"{folder}/{name}") for name in names}
    if verify:
        recorded = spark.read.text(f"{folder}/complete").first()["value"]
        for name, df in tables.items():
            if f"{name}:{table_digest(df)};" not in recorded:
                raise ValueError(f"table {name} of generation {generation} is corrupt")
    return tables


def read_contact_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """JSON-lines contacts as (records, rejects).

    A line is rejected when blank, unparsable, or when its key set is not exactly the
    schema's. ``log`` is the folder the file lies in.
    """
    schema = T.StructType.fromDDL(CONTACT_SCHEMA)
    keys = sorted(schema.fieldNames())
    lines = spark.read.text(path).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("log"), F.col("value").alias("line")
    )
    parsed = lines.withColumn("_keys", F.array_sort(F.json_object_keys("line"))).withColumn(
        "_record", F.from_json("line", CONTACT_SCHEMA, {"mode": "PERMISSIVE"})
    )
    required = [F.col(f"_record.{k}").isNotNull() for k in keys if k != "contact_distance"]
    fine = F.col("_keys") == F.array(*[F.lit(k) for k in keys])
    for condition in required:
        fine = fine & condition
    judged = parsed.withColumn("_fine", F.coalesce(fine, F.lit(False)))
    return judged.where("_fine").select("log", "_record.*"), judged.where("not _fine").select("log", "line")


def read_state_arrays(spark: SparkSession, path: str, rows_per_batch: int = 65536) -> DataFrame:
    """``[T, N, 13]`` array files in long form, one row per step and object."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                array = np.load(io.BytesIO(content), allow_pickle=False)
                if array.ndim != 3 or array.shape[2] != 13:
                    raise ValueError(f"{file} is not a [steps, objects, 13] array")
                flat = array.reshape(-1, 13)
                for start in range(0, len(flat), rows_per_batch):
                    piece = flat[start:start + rows_per_batch]
                    index = np.arange(start, start + len(piece))
                    yield pd.DataFrame({
                        "path": file, "step_index": (index // array.shape[1]).astype(np.int32),
                        "object_index": (index % array.shape[1]).astype(np.int32),
                        "position": list(piece[:, 0:3]), "quaternion": list(piece[:, 3:7]),
                        "linear_velocity": list(piece[:, 7:10]), "angular_velocity": list(piece[:, 10:13]),
                    })

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(decode, STATE_SCHEMA).withColumn(
        "log", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    ).drop("path")


def name_states(states: DataFrame, logs: DataFrame) -> DataFrame:
    """Attaches object ids and steps of the log header (arrays ``object_ids`` and ``steps``)."""
    return states.join(logs.select("log", "object_ids", "steps"), "log").select(
        "log", F.get("steps", F.col("step_index")).alias("step"), F.get("object_ids", F.col("object_index")).alias("object_id"),
        "position", "quaternion", "linear_velocity", "angular_velocity",
    )
