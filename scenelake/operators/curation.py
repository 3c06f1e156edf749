"""Balanced selection and leak-free splits."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scenelake.functions import hashing as H
from scenelake.operators import ordered

SPLITS = ("train", "val", "test")


def select_balanced(candidates: DataFrame, capacity: int, seed: int = 0,
                    strata: Sequence[str] = ("category", "hop_bucket"), identifier: str = "instance_id") -> DataFrame:
    """Round-robin over strata; ``selection_rank`` is the order of selection.

    Round ``k`` takes the ``k``-th candidate (by seeded digest) of every stratum that
    still has one. The place of a row is the number of rows in earlier rounds plus its
    stratum's place in the round, so the cut needs no global sort.
    """
    keys = list(strata)
    ranked = ordered.with_rank(
        candidates.withColumn("_digest", H.sha_text(seed, F.col(identifier))), keys, "_digest", [identifier], "_round"
    )
    order = ordered.with_rank(
        candidates.select(*keys).distinct().withColumn("_digest", H.sha_text(seed, *[F.col(k) for k in keys])),
        [], "_digest", keys, "_stratum",
    ).drop("_digest")
    # Null-safe: candidates without a category or bucket are a stratum like any other.
    order = order.select(*[F.col(k).alias(f"_of_{k}") for k in keys], "_stratum")
    placed = ranked.join(order, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]))
    rounds = placed.groupBy("_round").agg(F.count("*").alias("_size")).withColumn("_all", F.lit(0))
    before = ordered.with_running_sum(rounds, ["_all"], "_round", F.col("_size"), "_through")
    in_round = F.row_number().over(W.partitionBy("_round").orderBy("_stratum"))
    return (
        placed.withColumn("_slot", in_round)
        .join(before.select("_round", (F.col("_through") - F.col("_size")).alias("_before")), "_round")
        .withColumn("selection_rank", (F.col("_before") + F.col("_slot")).cast("bigint"))
        .where(F.col("selection_rank") <= capacity)
        .select(*candidates.columns, "selection_rank")
    )


def hash_split(identifier: Column, fractions: Mapping[str, float], seed: int) -> Column:
    """Split of one id from its own hash, independent of every other row.

    The unit interval is divided among the splits in the order train, val, test, others by
    name; the share that an id's draw falls into is its split.
    """
    ordered_names = sorted(fractions, key=lambda n: (SPLITS.index(n) if n in SPLITS else len(SPLITS), n))
    weights = [float(fractions[n]) for n in ordered_names]
    if not weights or min(weights) < 0.0 or sum(weights) <= 0.0:
        raise ValueError(f"no division of the unit interval by {dict(fractions)}")
    upper = accumulate(w / sum(weights) for w in weights[:-1])
    place = H.unit_draw(F.concat(F.lit(f"{int(seed)}:"), identifier.cast("string")))
    below = [F.when(place < F.lit(bound), F.lit(name)) for bound, name in zip(upper, ordered_names)]
    return F.coalesce(*below, F.lit(ordered_names[-1]))


def _picks(deficits: np.ndarray, size: np.ndarray, count: np.ndarray) -> np.ndarray:
    """How many of ``count`` equal groups each split takes when the neediest goes first.

    Split ``j`` takes groups at needs d_j, d_j - s, d_j - 2s, ...; the taken ones are the
    ``count`` largest of these progressions. A water level gives all but a few of them,
    and single steps settle the rest. Columns of ``deficits`` are in tie-break order.
    """
    scaled = deficits / size[:, None]
    need = np.sort(scaled, axis=1)[:, ::-1]
    sums = np.cumsum(need, axis=1)
    width = np.arange(1, need.shape[1] + 1)
    level = (sums - count[:, None]) / width
    # The level belongs to the widest set of splits all standing above it.
    above = need > level
    used = need.shape[1] - 1 - np.argmax(above[:, ::-1], axis=1)
    level = level[np.arange(len(level)), used]
    taken = np.maximum(np.floor(scaled - level[:, None]) - 1, 0).astype(np.int64)
    taken[count == 0] = 0
    while (open_rows := taken.sum(axis=1) < count).any():
        rest = deficits - taken * size[:, None]
        best = np.argmax(np.round(rest, 9), axis=1)
        taken[np.arange(len(taken)), best] += open_rows
    return taken


def grouped_split(candidates: DataFrame, fractions: Mapping[str, float] | None = None, seed: int = 0,
                  group: str = "topology_signature") -> DataFrame:
    """Adds ``split`` such that no group is divided and counts stay near the fractions.

    Groups go, largest first and by digest among equals, to the split that minimises the
    squared distance to the wanted counts, which is the split with the largest unmet
    need. Groups of one size are interchangeable to that rule, so the only sequential
    part runs over distinct sizes (at most the square root of twice the row count);
    the split of each single group then follows from its rank within its size.
    """
    wanted = dict(fractions or {"train": 0.8, "val": 0.1, "test": 0.1})
    if set(wanted) != set(SPLITS):
        raise ValueError("fractions must name train, val and test")
    if min(wanted.values()) < 0 or abs(sum(wanted.values()) - 1.0) > 1e-9:
        raise ValueError("split fractions must be non-negative and sum to one")
    names = sorted(SPLITS, key=lambda n: hashlib.sha256(f"{seed}\0{n}".encode()).hexdigest())
    shares = [wanted[n] for n in names]

    groups = candidates.groupBy(group).agg(F.count("*").alias("_size"))
    classes = groups.groupBy("_size").agg(F.count("*").alias("_groups"))

    def openings(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("_size", ascending=False, ignore_index=True)
        need = np.array(shares) * float((table["_size"] * table["_groups"]).sum())
        rows = []
        for size, count in zip(table["_size"].to_numpy(), table["_groups"].to_numpy()):
            rows.append(need.tolist())
            need = need - size * _picks(need[None, :], np.array([float(size)]), np.array([count]))[0]
        return pd.DataFrame({"_size": table["_size"], "_needs": rows})

    needs = classes.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(
        openings, "_size bigint, _needs array<double>"
    )

    @F.pandas_udf("string")
    def chosen(rank: pd.Series, size: pd.Series, need: pd.Series) -> pd.Series:
        deficits = np.stack(need.to_numpy())
        sizes, ranks = size.to_numpy(dtype=float), rank.to_numpy(dtype=np.int64)
        gained = _picks(deficits, sizes, ranks) - _picks(deficits, sizes, ranks - 1)
        return pd.Series(np.array(names)[np.argmax(gained, axis=1)])

    ranked = ordered.with_rank(
        groups.withColumn("_digest", H.sha_text(seed, F.col(group))), ["_size"], "_digest", [group], "_rank"
    )
    assigned = ranked.join(needs, "_size").select(group, chosen("_rank", "_size", "_needs").alias("split"))
    assigned = assigned.withColumnRenamed(group, "_group")
    return candidates.join(assigned, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def ratio_split(items: DataFrame, name: str, validation_ratio: float, seed: int = 42) -> DataFrame:
    """Seeded shuffle; the last max(1, round(n * ratio)) items are the validation set."""
    ranked = ordered.with_rank(items.withColumn("_digest", H.sha_text(seed, F.col(name))), [], "_digest", [name], "_rank")
    totals = items.agg(F.count("*").alias("_n"))  # a single row
    tail = F.greatest(F.lit(1), F.bround(F.col("_n") * validation_ratio).cast("bigint"))
    return ranked.crossJoin(F.broadcast(totals)).select(
        *items.columns, F.when(F.col("_rank") > F.col("_n") - tail, "validation").otherwise("train").alias("split")
    )


def held_out_split(items: DataFrame, name: str, fraction: float, seed: int = 42, round_up: bool = False) -> DataFrame:
    """Exactly round(n * fraction) items (or its ceiling) in ``test``, the rest in ``train``."""
    ranked = ordered.with_rank(items.withColumn("_digest", H.sha_text(seed, F.col(name))), [], "_digest", [name], "_rank")
    totals = items.agg(F.count("*").alias("_n"))  # a single row
    wanted = F.ceil(F.col("_n") * fraction) if round_up else F.bround(F.col("_n") * fraction)
    return ranked.crossJoin(F.broadcast(totals)).select(
        *items.columns, F.when(F.col("_rank") <= wanted.cast("bigint"), "test").otherwise("train").alias("split")
    )


def view_split(view: Column) -> Column:
    return F.when(view == 0, "validation").otherwise("train")


def frame_split(frames: DataFrame, fraction: float = 0.7, seed: int = 0) -> DataFrame:
    """A random int(n * fraction) of each scene's frames trains, the rest tests."""
    digest = H.sha_text(seed, F.col("scene"), F.col("frame"))
    ranked = ordered.with_rank(frames.withColumn("_digest", digest), ["scene"], "_digest", ["frame"], "_rank")
    sizes = frames.groupBy("scene").agg(F.count("*").alias("_n"))
    return ranked.join(sizes, "scene").select(
        *frames.columns, F.when(F.col("_rank") <= F.floor(F.col("_n") * fraction), "train").otherwise("test").alias("split")
    )


def numeric_order(names: DataFrame, column: str = "name") -> DataFrame:
    """Directory names in the order of their integer value."""
    return names.orderBy(F.col(column).cast("bigint"))


def outcome_counts(attempts: DataFrame, capacity: int) -> DataFrame:
    """Attempts, outcomes and whether the accepted ones fill the wanted number."""
    status = lambda s: F.count_if(F.col("status") == s)
    return attempts.agg(
        F.count("*").alias("attempts"), status("accepted").alias("accepted"),
        status("rejected").alias("rejected"), status("error").alias("errors"),
    ).withColumn("status", F.when(F.col("accepted") >= capacity, "complete").otherwise("capacity_exhausted"))


def reason_counts(attempts: DataFrame) -> DataFrame:
    """How often each rejection reason occurs."""
    return attempts.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("attempts"))
