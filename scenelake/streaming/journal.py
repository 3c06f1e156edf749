"""Incremental ingestion of attempt records.

Each micro-batch owns one folder per sink, named by its batch id and written in
overwrite mode, so replaying a batch after a failure leaves no duplicates.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from scenelake.session import missing


def _published(spark: SparkSession, folder: str, before: int) -> DataFrame | None:
    try:
        return spark.read.option("basePath", folder).parquet(folder).where(F.col("batch") < before)
    except AnalysisException as error:
        if not missing(error):
            raise
        return None


def ingest_batch(records: DataFrame, batch: int, root: str, key: str = "attempt_index") -> None:
    """Publishes new records; a known key with other content goes to the rejects.

    Identical repeats are dropped, within the batch as well as against earlier ones.
    """
    columns = [c for c in records.columns if c != key]
    arrived = records.withColumn("digest", F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256))
    # The smallest digest of a key is the record kept; any other digest conflicts with it.
    first = arrived.groupBy(key).agg(F.min("digest").alias("_kept"))
    known = _published(records.sparkSession, f"{root}/published", batch)
    judged = arrived.dropDuplicates([key, "digest"]).join(first, key)
    if known is not None:
        earlier = known.select(key, F.col("digest").alias("_earlier"))
        judged = judged.join(earlier, key, "left")
    else:
        judged = judged.withColumn("_earlier", F.lit(None).cast("string"))
    fresh = judged.where(F.col("_earlier").isNull() & (F.col("digest") == F.col("_kept")))
    conflicts = judged.where(F.coalesce(F.col("_earlier"), F.col("_kept")) != F.col("digest"))
    for name, rows in (("published", fresh), ("rejected", conflicts)):
        rows.drop("_kept", "_earlier").write.mode("overwrite").parquet(f"{root}/{name}/batch={batch}")


def ingest(spark: SparkSession, source: str, schema: str, root: str, source_format: str = "json",
           files_per_batch: int | None = None, key: str = "attempt_index") -> None:
    """Processes whatever has arrived since the last run, then stops."""
    reader = spark.readStream.schema(schema).format(source_format)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    query = (
        reader.load(source).writeStream
        .foreachBatch(lambda rows, batch: ingest_batch(rows, batch, root, key))
        .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def published(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.option("basePath", f"{root}/published").parquet(f"{root}/published").drop("batch", "digest")


def rejected(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.option("basePath", f"{root}/rejected").parquet(f"{root}/rejected").drop("batch", "digest")
