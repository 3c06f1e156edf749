"""Mixing sources to target weights by cube-method balanced sampling.

Every source has a target number of words. A document of a source with target ratio r is taken floor(r) times for
certain and once more with probability r - floor(r). Which documents get that extra copy is decided by the cube
method: probabilities move along the null space of two constraints, the source's words and its documents, until
they are 0 or 1. A flight over a block of units leaves at most two of them open; these meet again in the next
level, and only the last block of a source lands its one or two open units by chance.

Defined results: null and empty texts have size 0, are units like any other and take no words; a null source is a
source of its own, last in order; a null doc_id is allowed; repeated rows are separate units; an empty table gives
no rows. Columns beyond doc_id, text and source are ignored by :func:`shares` and kept by :func:`mixed`.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenelake.llm.tables import WORD, pieces_for, scratch, stored

#: Units in one flight.
BLOCK = 2048
WEIGHTS = (5, 2, 1)
LIMIT = 3
_CLOSE = 1e-9


def source_targets(units: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: float = LIMIT) -> DataFrame:
    """One row per source: size, number of units and target.

    Sharing by weight and resharing what exceeds ``limit`` times a source's size ends where every target is the
    smaller of that limit and a common level times the weight; the level is the largest of those reached by
    capping the sources one after another in the order of limit over weight.
    """
    ranked = units.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_units"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(limit))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - before) / left
    return (ranked.withColumn("level", level).withColumn("level", F.max("level").over(whole))
            .select("source", "source_size", "n_units", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target")))


def direction(value: np.ndarray, size: np.ndarray, at: int) -> np.ndarray:
    """Unit ``at`` moved by one, and the others so that neither the count nor the words change.

    It is the projection of that unit's axis onto the null space of the constraints (1, size), weighted by
    value * (1 - value) so that units close to a decision move least.
    """
    room = value * (1 - value)
    n, words, squares = room.sum(), (room * size).sum(), (room * size * size).sum()
    det = n * squares - words * words
    if det > 1e-12 * n * squares:
        u0, u1 = (squares - words * size[at]) / det, (n * size[at] - words) / det
    else:  # all of one size
        u0, u1 = 1 / n, 0.0
    move = -room * (u0 + u1 * size)
    move[at] += 1
    return move


def step(value: np.ndarray, move: np.ndarray, draws: np.random.Generator) -> None:
    """One random move along ``move`` or against it, until an entry is 0 or 1; expectations stay as they are."""
    used = np.abs(move) > 1e-13
    up, down = (1 - value[used]) / np.abs(move[used]), value[used] / np.abs(move[used])
    rising = move[used] > 0
    ahead, back = np.where(rising, up, down).min(), np.where(rising, down, up).min()
    value += (ahead if draws.random() * (ahead + back) < back else -back) * move
    value[value < _CLOSE] = 0.0
    value[value > 1 - _CLOSE] = 1.0


def flight(chance: np.ndarray, size: np.ndarray, draws: np.random.Generator) -> None:
    """Moves ``chance`` in place until at most two entries are neither 0 nor 1.

    The sums of chance and of size times chance stay as they are. Units are decided in their order: the first open
    one is moved, the others make up for it.
    """
    open_ = np.flatnonzero((chance > 0) & (chance < 1))
    at = 0
    while len(open_) > 2:
        value = chance[open_]
        move = direction(value, size[open_], at)
        if np.abs(move).max() < 1e-9:  # nothing makes up for this one
            at += 1
            continue
        step(value, move, draws)
        chance[open_] = value
        open_, at = open_[(value > 0) & (value < 1)], 0


def land(chance: np.ndarray, size: np.ndarray, draws: np.random.Generator) -> None:
    """Decides the last one or two units: first only their words are kept, then the rest goes by its chance."""
    open_ = np.flatnonzero((chance > 0) & (chance < 1))
    if len(open_) == 2:
        value = chance[open_]
        first, second = size[open_]
        step(value, np.array([second, -first] if first and second else [1.0, -1.0]), draws)
        chance[open_] = value
    for i in open_:
        if 0.0 < chance[i] < 1.0:
            chance[i] = float(draws.random() < chance[i])


def _block(level: int, seed: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        # Large units are decided first: those left for the landing are small.
        rows = rows.sort_values(["size", "unit_key"], ascending=[False, True], kind="stable", ignore_index=True)
        name = f"{seed}|{level}|{rows['source'][0]}|{rows['block'][0]}"
        draws = np.random.default_rng([seed, zlib.crc32(name.encode())])
        chance = rows["chance"].to_numpy(dtype=np.float64, copy=True)
        chance[chance < _CLOSE] = 0.0
        chance[chance > 1 - _CLOSE] = 1.0
        size = rows["size"].to_numpy(dtype=np.float64)
        flight(chance, size, draws)
        if rows["last"][0]:
            land(chance, size, draws)
        return rows.assign(chance=chance)

    return run


def _numbered(rows: DataFrame, size: Column) -> DataFrame:
    """Rows with _id, which stands in for a null doc_id too, and the number of each row among those that share it."""
    rows = rows.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
    return rows.withColumn("_occurrence", F.row_number().over(Window.partitionBy("_id").orderBy("source", size)))


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def shares(docs: DataFrame, seed: int = 7, weights: tuple[int, ...] = WEIGHTS, limit: float = LIMIT) -> DataFrame:
    """Per document: doc_id, source, occurrence, size, source_size, target, copies and taken (copies times size).

    occurrence numbers the rows that share a doc_id from 1.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "mixing")
    sized = _numbered(docs.select("doc_id", "source", _size().alias("size")), F.col("size"))
    sized = stored(sized.select("doc_id", "source", "size", F.col("_occurrence").alias("occurrence")), f"{folder}/sized")
    targets = stored(source_targets(sized, weights, limit), f"{folder}/targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = (sized.alias("u").join(targets.alias("t"), F.col("u.source").eqNullSafe(F.col("t.source")))
             .select("u.doc_id", "u.source", "u.occurrence", "u.size", "t.source_size", "t.target", ratio.alias("ratio"),
                     F.xxhash64("u.doc_id", "u.occurrence", F.lit(seed)).alias("unit_key"), F.col("t.n_units").alias("left")))
    units = units.withColumn("certain", F.floor("ratio")).withColumn("chance", F.col("ratio") - F.col("certain")).drop("ratio")
    most = targets.agg(F.max("n_units")).first()[0] or 0
    units = units.withColumn("large", F.col("left") > BLOCK)
    held = F.col("large") & (F.pmod(F.xxhash64("unit_key", F.lit("held")), F.col("left")) < BLOCK // 2)
    reserve, undecided, decided, level = units.where(held), units.where(~held), None, 0
    while True:
        final = most <= (BLOCK if level == 0 else BLOCK // 2)
        if final and level:
            undecided = undecided.unionByName(reserve)
        blocks = F.lit(1).cast("long") if final else F.ceil(F.col("left") / BLOCK)
        undecided = undecided.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("unit_key", F.lit(level)), F.col("blocks")))
        undecided = undecided.withColumn("last", F.lit(True) if final else ~F.col("large"))
        flown = undecided.groupBy("source", "block").applyInPandas(_block(level, seed), undecided.schema)
        flown = stored(flown, f"{folder}/level{level}")
        closed = flown.where(F.col("chance").isin(0.0, 1.0))
        decided = closed if decided is None else decided.unionByName(closed)
        if final:
            break
        undecided = flown.where(~F.col("chance").isin(0.0, 1.0)).withColumn("left", 2 * F.col("blocks")).drop("block", "blocks", "last")
        most, level = 2 * pieces_for(most, BLOCK), level + 1
    copies = (F.col("certain") + F.col("chance")).cast("long")
    return decided.select("doc_id", "source", "occurrence", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, seed: int = 7, weights: tuple[int, ...] = WEIGHTS, limit: float = LIMIT) -> DataFrame:
    """The mix itself: ``docs`` with every row repeated as often as it is taken."""
    chosen = shares(docs, seed, weights, limit).where("copies > 0")
    chosen = chosen.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_id"), F.col("occurrence").alias("_occurrence"), F.col("copies").alias("_copies"))
    # The row travels as one value, so that no column of it can clash with those made here.
    whole = F.struct(*(F.col(f"`{name}`") for name in docs.columns)).alias("row")
    rows = _numbered(docs.select(whole, "doc_id", "source", _size().alias("size")), F.col("size")).join(chosen, ["_id", "_occurrence"])
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("row.*")
