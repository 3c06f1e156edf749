"""Asset manifests: flattening, lookups, categories, exclusions and suggestions."""

from __future__ import annotations

import difflib
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W


def flatten(manifest: DataFrame) -> DataFrame:
    """One row per asset of a manifest row; metadata overrides kwargs of the same name.

    ``manifest``: name, data_dir, assets as MAP<STRING, STRUCT<asset_type, license, path,
    kwargs, metadata>>.
    """
    rows = manifest.select("name", "data_dir", F.explode(F.map_entries("assets")).alias("_e")).select(
        "name", "data_dir", F.col("_e.key").alias("id"), "_e.value.*"
    )
    fields = lambda part: rows.schema[part].dataType.fieldNames() if part in rows.columns else []
    metadata = fields("metadata")
    columns = [F.col(f"metadata.{f}").alias(f) for f in metadata]
    columns += [F.col(f"kwargs.{f}").alias(f) for f in fields("kwargs") if f not in metadata]
    plain = [c for c in rows.columns if c not in ("kwargs", "metadata")]
    return rows.select(*plain, *columns)


def resolve_path(path: Column, data_dir: Column, asset_id: Column) -> Column:
    """Null stays null; an empty path names the asset's archive; else relative to data_dir."""
    name = F.when(path == "", F.concat(asset_id, F.lit(".tar.gz"))).otherwise(path)
    return F.when(path.isNotNull(), F.concat_ws("/", data_dir, name))


def substitute_asset_dir(value: Column, asset_dir: Column) -> Column:
    """Replaces a leading ``{asset_dir}/``."""
    marker = "{asset_dir}/"
    return F.when(value.startswith(marker), F.concat_ws("/", asset_dir, F.substring(value, len(marker) + 1, 1 << 20))).otherwise(value)


def substitute_in_struct(column: Column, data_type: T.DataType, asset_dir: Column) -> Column:
    """The same substitution through nested structs and maps."""
    if isinstance(data_type, T.StringType):
        return substitute_asset_dir(column, asset_dir)
    if isinstance(data_type, T.StructType):
        inner = [substitute_in_struct(column[f.name], f.dataType, asset_dir).alias(f.name) for f in data_type.fields]
        return F.when(column.isNotNull(), F.struct(*inner))
    if isinstance(data_type, T.MapType):
        return F.transform_values(column, lambda _, v: substitute_in_struct(v, data_type.valueType, asset_dir))
    return column


def category_ids(assets: DataFrame, category: str = "category") -> DataFrame:
    """Zero-based place of each category in sorted order; a missing or empty one has none."""
    named = assets.where(F.col(category).isNotNull() & (F.col(category) != "")).select(category).distinct()
    # Distinct categories only; a handful of rows reach the single-partition window.
    ranked = named.withColumn("category_id", (F.row_number().over(W.orderBy(category)) - 1).cast("int"))
    return assets.join(ranked, category, "left")


def path_suffix(path: Column, parts: int = 2) -> Column:
    return F.substring_index(F.regexp_replace(path, "/+$", ""), "/", -parts)


def without_denied(assets: DataFrame, path: str, denied: DataFrame) -> DataFrame:
    """Drops assets whose last two path segments are on the list (column ``suffix``)."""
    return assets.withColumn("suffix", path_suffix(F.col(path))).join(denied, "suffix", "left_anti").drop("suffix")


def lookup_by_description(instances: DataFrame, table: DataFrame, prefix: int = 15) -> DataFrame:
    """Asset id from (nr_faces, category, leading description); null where unknown."""
    keyed = instances.withColumn("description_key", F.substring("description", 1, prefix))
    return keyed.join(table, ["nr_faces", "category", "description_key"], "left").drop("description_key")


def lookup_scale(instances: DataFrame, table: DataFrame) -> DataFrame:
    """Category of an asset and its scale times the instance's own factor."""
    return instances.join(table, "asset_id", "left").withColumn("scale", F.col("scale") * F.col("scale_factor"))


def category_from_path(folders: DataFrame, path: str, names: DataFrame) -> DataFrame:
    """Asset id and category of ``.../<category code>/<asset>`` folders."""
    piece = F.split(path_suffix(F.col(path)), "/")
    return folders.withColumn("category_code", piece[0]).withColumn("asset_id", piece[1]).join(names, "category_code", "left")


def held_out(combinations: DataFrame, holdouts: DataFrame, axes: Sequence[str]) -> DataFrame:
    """Combinations matching every stated axis of some pattern; a null axis is a wildcard.

    Patterns are grouped by which axes they state, so each group is an equi join. The
    number of groups is bounded by two to the number of axes.
    """
    shape = F.concat(*[F.when(F.col(a).isNull(), "0").otherwise("1") for a in axes])
    tagged = holdouts.select(*axes).distinct().withColumn("_shape", shape)
    hits = []
    for bits in range(1 << len(axes)):
        stated = [a for i, a in enumerate(axes) if bits >> i & 1]
        code = "".join("1" if a in stated else "0" for a in axes)
        patterns = tagged.where(F.col("_shape") == code).select(*stated, F.lit(True).alias("_hit")).distinct()
        if stated:
            hits.append(combinations.join(patterns, stated, "left_semi"))
        else:
            hits.append(combinations.join(patterns.limit(1), how="left_semi", on=F.col("_hit")))
    return reduce(lambda a, b: a.unionByName(b), hits).distinct()


def without_held_out(combinations: DataFrame, holdouts: DataFrame, axes: Sequence[str]) -> DataFrame:
    matched = held_out(combinations.select(*axes).distinct(), holdouts, axes)
    return combinations.join(matched, list(axes), "left_anti")


@F.pandas_udf(T.DoubleType())
def _similarity(word: pd.Series, candidate: pd.Series) -> pd.Series:
    matcher = difflib.SequenceMatcher()
    scores = []
    for wanted, option in zip(word, candidate):
        matcher.set_seq2(wanted)
        matcher.set_seq1(option)
        scores.append(matcher.ratio())
    return pd.Series(scores)


def _occurrences(df: DataFrame, name: str) -> DataFrame:
    """(id, length, token) rows; the k-th occurrence of a character is its own token."""
    letters = F.filter(F.split(F.col(name), ""), lambda c: c != "")
    numbered = F.transform(letters, lambda c, i: F.concat(
        c, F.size(F.filter(F.slice(letters, F.lit(1), i + 1), lambda d: d == c)).cast("string")))
    return df.select(name, F.length(name).alias("_len"), F.explode(numbered).alias("_token"))


def did_you_mean(unknown: DataFrame, known: DataFrame, cutoff: float = 0.6) -> DataFrame:
    """Most similar known id of each unknown id, if any reaches the cutoff.

    A similarity of at least ``cutoff`` needs a large common bag of characters. Ordering
    characters from rare to frequent, two such bags must share one of their rarest few,
    which replaces the comparison of everything with everything by an equi join.
    """
    words, options = unknown.select(F.col("id").alias("word")).distinct(), known.select(F.col("id").alias("option")).distinct()
    left, right = _occurrences(words, "word"), _occurrences(options, "option")
    rarity = right.groupBy("_token").agg(F.count("*").alias("_freq"))
    # The shorter partner of a qualifying pair has at least this many characters.
    shortest = F.ceil(F.col("_len") * (cutoff / (2.0 - cutoff)) - 1e-9)
    needed = F.greatest(F.lit(1), F.ceil(cutoff * (F.col("_len") + shortest) / 2.0 - 1e-9))

    def prefix(df: DataFrame, name: str) -> DataFrame:
        order = W.partitionBy(name).orderBy(F.coalesce("_freq", F.lit(0)), "_token")
        return df.join(rarity, "_token", "left").withColumn("_place", F.row_number().over(order)).where(
            F.col("_place") <= F.col("_len") - needed + 1
        ).select(name, F.col("_len").alias(f"_len_{name}"), "_token")

    a, b = F.col("_len_word"), F.col("_len_option")
    pairs = prefix(left, "word").join(prefix(right, "option"), "_token").where(
        2.0 * F.least(a, b) / (a + b) >= cutoff - 1e-9
    ).select("word", "option")
    # Few bytes but much Python per pair: keep the full number of partitions.
    tasks = int(unknown.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = pairs.repartition(tasks, "word", "option").distinct()
    scored = pairs.withColumn("score", _similarity("word", "option")).where(F.col("score") >= cutoff)
    best = scored.groupBy("word").agg(F.max(F.struct("score", "option")).alias("_best"))
    return words.join(best, "word", "left").select(F.col("word").alias("id"), F.col("_best.option").alias("suggestion"))


def batch_manifest(entries: DataFrame, properties: str = "properties") -> DataFrame:
    """All entries, or none at all if any entry lacks its properties."""
    verdict = entries.agg(F.every(F.col(properties).isNotNull()).alias("_complete"))  # a single row
    return entries.crossJoin(F.broadcast(verdict)).where("_complete").drop("_complete")
