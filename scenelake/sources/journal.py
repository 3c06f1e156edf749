"""The append-only journal of attempts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from scenelake.session import missing

SCHEMA = (
    "attempt_index BIGINT, status STRING, instance_id STRING, instance_seed BIGINT, "
    "qc STRUCT<accepted: BOOLEAN, reasons: ARRAY<STRING>>, "
    "candidate STRUCT<category: STRING, hop_depth: INT, hop_bucket: STRING, topology_signature: STRING, artifact_path: STRING>, "
    "spec STRING, artifact_manifest_sha256 STRING, artifact_manifest_size BIGINT, "
    "error_type STRING, message STRING, traceback STRING"
)


def read_attempts(spark: SparkSession, root: str, schema: str = SCHEMA) -> DataFrame:
    """Records named by an eight-digit index; an error sidecar stands in for a missing record."""

    def scan(folder: str) -> DataFrame | None:
        try:
            return (
                spark.read.schema(schema).option("multiLine", "true").option("pathGlobFilter", "[0-9]" * 8 + ".json")
                .json(f"{root}/{folder}").select("*", F.col("_metadata.file_name").alias("file_name"))
            )
        except AnalysisException as error:
            if not missing(error):
                raise
            return None

    records, sidecars = scan("attempts"), scan("errors")
    if sidecars is None:
        return records
    if records is None:
        return sidecars
    orphans = sidecars.join(records.select("file_name"), "file_name", "left_anti")
    return records.unionByName(orphans)


def misnamed(records: DataFrame) -> DataFrame:
    """Records whose index is not the one in their file name."""
    stem = F.regexp_extract("file_name", r"^(\d{8})\.json$", 1).cast("bigint")
    return records.where(~stem.eqNullSafe(F.col("attempt_index")))


def pending(attempts: DataFrame, published: DataFrame, key: str = "instance_id") -> DataFrame:
    """Attempts that still have to run; checked before any work is done."""
    return attempts.join(published.select(key).distinct(), key, "left_anti")


def contract_breaks(existing: DataFrame, wanted: dict[str, object]) -> list[str]:
    """Names of run settings that differ from the stored run (one row)."""
    row = existing.first()
    return [] if row is None else [k for k, v in wanted.items() if row[k] != v]
