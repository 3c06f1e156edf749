"""From raw documents to token ids: five stages, each over all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from scenelake.llm import hyperminhash, langid, mixing, piece_codec, stream_dedup
from scenelake.llm.tables import scratch, stored, table

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language identification: texts without letters, or of no language more than half likely, go."""
    return langid.accepted(docs, PIECES)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact deduplication: of equal texts the document with the largest id stays."""
    return stream_dedup.kept(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near deduplication: one document of each group stays."""
    return hyperminhash.kept(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source: documents are left out, taken once or taken several times."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what the mix took, one row per copy."""
    return piece_codec.digests(docs, PIECES)


STAGES = [("language", known_language), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("source mix", mix_sources), ("piece encoding", encode)]

#: Learned scores, sketches and balanced draws have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        docs = stored(stage(spark, docs, sf_dir), f"{folder}/{number}")
    return STAGES[-1][1](spark, docs, sf_dir)
