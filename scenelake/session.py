"""Session construction and lineage control."""

from __future__ import annotations

import os
import tempfile
from urllib.parse import unquote

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of input files for each partition of :func:`spread`.
SHARE = 4 << 20


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the benchmark; a cluster supplies its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("scenelake")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SCENELAKE_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read, named by ``spark.checkpoint.dir``.

    Only a local session without that setting (tests, a laptop) gets a temporary folder;
    on a cluster no other machine could read it, so its absence is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that every executor can read")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def missing(error: AnalysisException) -> bool:
    """Whether a read failed for want of the path, and for no other reason."""
    return error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def cut_lineage(df: DataFrame, once: bool = False) -> DataFrame:
    """Materialises ``df`` in reliable storage so a lost executor replays nothing older.

    A checkpoint is a job after the one that computes its rows, and computes its last stage again. With ``once`` that job finds
    the rows on the disks instead; this keeps adaptive execution from merging partitions, so it suits costly rows in few.
    """
    shared_folder(df.sparkSession)
    if not once:
        return df.checkpoint(eager=True)
    kept = df.persist(StorageLevel.DISK_ONLY)
    try:
        return kept.checkpoint(eager=True)
    finally:
        kept.unpersist()


def shares(df: DataFrame, size: int = SHARE) -> int:
    """Partitions for a shuffle of ``df``: one for every ``size`` bytes of the files below it, at least one for each core.

    Without any file below it (a checkpoint) the number that the session sets.
    """
    spark = df.sparkSession
    files = [unquote(path) for path in df.inputFiles()]
    if not files:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Only the listing is read, never the contents.
    known = spark.read.format("binaryFile").load(files).agg(F.sum("length")).first()[0] or 0
    return max(spark.sparkContext.defaultParallelism, -(-known // size))


def spread(df: DataFrame, *keys: str, size: int = SHARE) -> DataFrame:
    """``df`` shuffled by ``keys`` (none: evenly) into :func:`shares` partitions.

    Adaptive execution merges the partitions of other shuffles until there is one for each core, so that a task's rows, and
    with them its memory, grow with the tables. A number of partitions that is asked for stays.
    """
    return df.repartition(shares(df, size), *keys)
