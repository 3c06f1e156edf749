"""Artifact folders: file inventories, digests, completeness and paired artifacts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenelake.operators.integrity import differing_groups, multiset_difference
from scenelake.plans.ground_truth import GroundTruth
from scenelake.sources import logs

PAIR_TABLES = ("contacts", "states", "delta", "affected", "paths")


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Path and size of every file below a folder; contents are not read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
        .load(path).select("path", F.col("length").alias("size"))
    )


def file_records(spark: SparkSession, path: str, exclude: Sequence[str] = ("manifest.json",)) -> DataFrame:
    """SHA-256 and size of every file, except those named in ``exclude``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.substring_index("path", "/", -1)
    return files.where(~name.isin(*exclude) if exclude else F.lit(True)).select(
        "path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size")
    )


def with_artifact(files: DataFrame, root: str) -> DataFrame:
    """Splits the path below ``root`` into the artifact name and the relative path."""
    marker = "/" + root.rstrip("/").rsplit("/", 1)[-1] + "/"
    below = F.substring_index("path", marker, -1)
    return files.withColumn("artifact", F.substring_index(below, "/", 1)).withColumn(
        "path", F.expr("substring(substring_index(path, '%s', -1), length(artifact) + 2)" % marker.replace("'", "")))


def generation_digests(files: DataFrame) -> DataFrame:
    """Digest of each artifact: its file digests concatenated in path order."""
    ordered = F.array_sort(F.collect_list(F.struct("path", "sha256")))
    joined = F.array_join(F.transform(ordered, lambda f: f["sha256"]), "")
    return files.groupBy("artifact").agg(F.sha2(joined, 256).alias("generation"), F.count("*").alias("files"),
                                         F.sum("size").alias("bytes"))


def complete_artifacts(files: DataFrame, branches: Sequence[str], per_branch: Sequence[str], top: Sequence[str]) -> DataFrame:
    """Artifacts holding every wanted file: top-level ones, and non-empty ones per branch."""
    wanted = [f"{b}/{n}" for b in branches for n in per_branch]
    have = files.groupBy("artifact").agg(
        F.count_if(F.col("path").isin(*wanted) & (F.col("size") > 0)).alias("_branch"),
        F.count_if(F.col("path").isin(*top)).alias("_top"),
    )
    return have.where((F.col("_branch") == len(wanted)) & (F.col("_top") == len(top))).select("artifact")


def write_pair(contacts: DataFrame, states: DataFrame, truth: GroundTruth, root: str, overwrite: bool = False) -> str:
    tables = {"contacts": contacts, "states": states, "delta": truth.delta, "affected": truth.affected}
    if truth.paths is not None:
        tables["paths"] = truth.paths
    return logs.write_generation(tables, root, overwrite)


def read_pair(spark: SparkSession, root: str, verify: bool = False) -> tuple[DataFrame, DataFrame, GroundTruth]:
    names = logs.generation_tables(spark, root)
    tables = logs.read_generation(spark, root, [n for n in PAIR_TABLES if n in names], verify)
    truth = GroundTruth(tables["delta"], tables["affected"], tables.get("paths"))
    return tables["contacts"], tables["states"], truth


def _parts(stored: GroundTruth, recomputed: GroundTruth) -> list[tuple[str, DataFrame, DataFrame]]:
    found = [(name, getattr(stored, name), getattr(recomputed, name)) for name in ("delta", "affected", "paths")]
    return [(name, left, right.select(*left.columns)) for name, left, right in found if left is not None and right is not None]


def truth_differences(stored: GroundTruth, recomputed: GroundTruth) -> DataFrame:
    """Instances and parts whose stored truth is not what the logs give again, by digests per instance."""
    return reduce(DataFrame.unionByName, [differing_groups(left, right).withColumn("part", F.lit(name)) for name, left, right in _parts(stored, recomputed)])


def differing_rows(stored: GroundTruth, recomputed: GroundTruth, part: str) -> DataFrame:
    """Rows of one part that only one side has; rows are compared only where an instance's digests differ.

    ``balance`` is positive for rows that only the stored side has.
    """
    left, right = next((left, right) for name, left, right in _parts(stored, recomputed) if name == part)
    suspect = differing_groups(left, right).withColumnRenamed("instance_id", "_suspect")
    only = lambda df: df.join(suspect, df["instance_id"].eqNullSafe(suspect["_suspect"]), "left_semi")
    return multiset_difference(only(left), only(right))


def read_verified_pair(spark: SparkSession, root: str, recompute: Callable[[DataFrame, DataFrame], GroundTruth]) -> tuple[DataFrame, DataFrame, GroundTruth]:
    """A pair whose tables match their digests and whose truth ``recompute(contacts, states)`` gives again; else an error."""
    contacts, states, truth = read_pair(spark, root, verify=True)
    found = truth_differences(truth, recompute(contacts, states)).orderBy("instance_id", "part").limit(5).collect()
    if found:
        raise ValueError("stored truth differs from the logs: " + ", ".join(f"{row['part']} of instance {row['instance_id']}" for row in found))
    return contacts, states, truth
