"""Exact deduplication over a stream, with keyed state on disk that never expires.

Arrivals (digest, identifier, content locator) stream through an aggregation whose state lives in RocksDB: per digest
the identifier that stays, where its content lies, and how many rows were seen. No watermark is set, so no key is
ever dropped. Partial aggregation before the shuffle leaves one row per digest and task, however many copies there
are. Each micro-batch publishes the digests it changed under its own number, so a replayed batch overwrites itself.

A digest that was hit more than once is checked on the full normalised bytes: the smallest and the largest text of
the digest are compared, which are equal exactly when all are. Digests that fail are grouped by their bytes instead.

Defined results: a null text counts as empty; texts are equal when identical after lower-casing A-Z; of equal texts
the largest doc_id stays (a null doc_id is the smallest); rows that repeat the staying doc_id count in group_size
and all have kept = true; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenelake.llm import workers
from scenelake.llm.tables import pieces_for, scratch, stored

ARRIVAL = "doc_id long, digest binary, text_sha binary, locator string"
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Many small stores: no blocks of 4 MB reserved for each one's logs.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # All stores of an executor share so much memory, and are closed after each batch.
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def sha256(content: bytes) -> bytes:
    return hashlib.sha256(content).digest()


def _rows(digest: Callable[[bytes], bytes], content: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of (doc_id, text, locator) with the digest and, if asked for, the bytes of the normalised text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.release()
        for batch in batches:
            low = [text.as_buffer().to_pybytes() for text in pc.ascii_lower(pc.fill_null(batch.column(1), ""))]
            keys = [digest(text) for text in low]
            rest = low if content else keys if digest is sha256 else [sha256(text) for text in low]
            names = ["doc_id", "digest", "content" if content else "text_sha", "locator"]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(rest, pa.binary()), batch.column(2)], names)

    return run


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.input_file_name().alias("locator"))


def arrivals(docs: DataFrame, digest: Callable[[bytes], bytes] = sha256) -> DataFrame:
    """doc_id, digest and SHA-256 of the normalised text, and the file that holds it."""
    return _read(docs).mapInArrow(_rows(digest, content=False), ARRIVAL)


class DigestState:
    """The keyed state of one stream, in ``folder``; give it the same folder again to go on where it stopped."""

    def __init__(self, folder: str, partitions: int = 12) -> None:
        self.folder, self.partitions = folder, partitions

    def absorb(self, spark: SparkSession, path: str, files_per_batch: int = 1000) -> None:
        """Runs all files of ``path`` that the stream has not seen yet through the state."""
        session = spark.newSession()
        for key, value in _STATE.items():
            session.conf.set(key, value)
        session.conf.set("spark.sql.shuffle.partitions", str(self.partitions))
        stream = session.readStream.schema(ARRIVAL).option("maxFilesPerTrigger", files_per_batch).parquet(path)
        state = stream.groupBy("digest").agg(F.max(F.struct("doc_id", "locator")).alias("keeper"), F.count(F.lit(1)).alias("group_size"))

        def publish(changed: DataFrame, batch: int) -> None:
            changed.write.mode("overwrite").parquet(f"{self.folder}/changed/batch={batch}")

        query = (state.writeStream.outputMode("update").foreachBatch(publish).option("checkpointLocation", f"{self.folder}/stream")
                 .trigger(availableNow=True).start())
        try:
            query.awaitTermination()
        finally:
            query.stop()

    def table(self, spark: SparkSession) -> DataFrame:
        """digest, keep_id, locator and group_size as of the last batch that touched the digest."""
        schema = "digest binary, keeper struct<doc_id: long, locator: string>, group_size long, batch long"
        last = F.max_by(F.struct("keeper", "group_size"), F.col("batch")).alias("last")
        return (spark.read.schema(schema).parquet(f"{self.folder}/changed").groupBy("digest").agg(last)
                .select("digest", F.col("last.keeper.doc_id").alias("keep_id"), F.col("last.keeper.locator").alias("locator"), F.col("last.group_size").alias("group_size")))


def deduplicated(docs: DataFrame, digest: Callable[[bytes], bytes] = sha256) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept and text_sha256.

    ``digest`` may be any function of the bytes; a weak one costs time, not correctness.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "stream-dedup")
    seen = stored(arrivals(docs, digest), f"{folder}/arrivals")
    # A store holds digests, not texts: a few of them do for what many partitions of texts bring.
    state = DigestState(f"{folder}/state", pieces_for(int(spark.conf.get("spark.sql.shuffle.partitions")), 4))
    state.absorb(spark, f"{folder}/arrivals")
    known = stored(state.table(spark), f"{folder}/known")

    # Hits: the full bytes of every row whose digest came more than once, read again where the rows lie.
    hits = seen.join(known.where("group_size > 1"), "digest", "left_semi").select(F.col("doc_id").alias("hit")).distinct()
    read = _read(docs)
    # Always by a shuffle: a broadcast of the hits would be as large as the corpus is repetitive.
    found = read.join(hits.hint("merge"), read["doc_id"].eqNullSafe(hits["hit"]), "left_semi")
    contents = found.mapInArrow(_rows(digest, content=True), "doc_id long, digest binary, content binary, locator string")
    mixed = contents.groupBy("digest").agg(F.min("content").alias("low"), F.max("content").alias("high")).where("low != high").select("digest")
    mixed = stored(mixed, f"{folder}/mixed")
    if mixed.isEmpty():
        groups = seen.join(known, "digest").select("doc_id", "keep_id", "group_size", "text_sha")
    else:
        # One digest, several texts: such rows are grouped by their bytes, of which text_sha is the name by now.
        clean = seen.join(mixed, "digest", "left_anti").join(known, "digest").select("doc_id", "keep_id", "group_size", "text_sha")
        clashing = seen.join(mixed, "digest", "left_semi")
        regrouped = clashing.groupBy("text_sha").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        groups = clean.unionByName(clashing.join(regrouped, "text_sha").select("doc_id", "keep_id", "group_size", "text_sha"))
    return groups.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("text_sha")).alias("text_sha256"))


def kept(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows of which an equal text with a larger doc_id exists."""
    stay = deduplicated(docs).where("kept").select(F.col("doc_id").alias("_stay")).distinct()
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay["_stay"]), "left_semi")
