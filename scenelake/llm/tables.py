"""Reading the given tables and keeping intermediate ones in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenelake.session import shared_folder

#: A word is a run of anything but the six ASCII white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession, purpose: str) -> str:
    """A new folder that every executor can read and write."""
    return f"{shared_folder(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str) -> DataFrame:
    """``df`` written once and read back: later steps start from files, which survive lost executors."""
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def slim(spark: SparkSession, batch: str = "8m") -> SparkSession:
    """A session of the same application whose batches for Python hold few bytes, for rows that carry long values."""
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    session.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", batch)
    return session


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; 0 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus, F.lit(0))


def pieces_for(total: int, each: int) -> int:
    """How many parts of about ``each`` units ``total`` makes."""
    return max(1, -(-int(total or 0) // each))
