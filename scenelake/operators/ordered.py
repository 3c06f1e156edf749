"""Ordered analytics that never place a whole key in one task.

A plain window sorts every row of a key in a single task. Here each key is cut into
blocks of the integer order column (or of a digest); a window runs inside each block and
only one summary row per block is carried across blocks. One key holding a third of all
rows therefore spreads over as many tasks as it has blocks.

``block=None`` is the plain window, for keys whose row count a parameter bounds. ``block=ByRows(n)`` cuts by row count,
for order values that are no counters (timestamps): approximate quantiles of each large key are its cut points.

No row is lost to a null: rows with a null order value form the first block of their key,
and rows with a null key form one block, as no summary could find its way back to them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scenelake.session import spread

BLOCK = 4096


@dataclass(frozen=True)
class ByRows:
    """Blocks of about ``rows`` rows. A key is cut into ``parts`` blocks at most, beyond which these grow."""

    rows: int = BLOCK
    parts: int = 256


Block = int | ByRows
_BEFORE = (W.unboundedPreceding, -1)
_UP_TO = (W.unboundedPreceding, W.currentRow)
_AFTER = (1, W.unboundedFollowing)
_ONWARD = (W.currentRow, W.unboundedFollowing)


_FIRST = -(1 << 63)


def _keyless(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys], F.lit(False))


def cut_points(df: DataFrame, keys: Sequence[str], order: str, block: ByRows) -> DataFrame:
    """Per key of more than ``block.rows`` rows: keys and ``_cuts``, ascending order values after which a block ends.

    The quantiles are gathered map-side, so no task holds a key; small keys, which stay whole, have no row.
    """
    fractions = [i / block.parts for i in range(1, block.parts)]
    known = df.where(F.col(order).isNotNull() & ~_keyless(keys)).groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx(order, fractions, 20 * block.parts).alias("_all"))
    stride = F.greatest(F.lit(1), F.ceil(F.lit(float(block.parts * block.rows)) / F.col("_n")).cast("int"))
    thinned = F.array_distinct(F.filter("_all", lambda _, i: (i + 1) % F.col("_stride") == 0))
    return known.where(F.col("_n") > block.rows).withColumn("_stride", stride).select(*keys, thinned.alias("_cuts"))


def _blocked(df: DataFrame, keys: Sequence[str], order: str, block: Block) -> DataFrame:
    """``df`` with its ``_block``, shuffled by block into tasks of a bounded share of the input."""
    return spread(_numbered(df, keys, order, block), *keys, "_block")


def _numbered(df: DataFrame, keys: Sequence[str], order: str, block: Block) -> DataFrame:
    if isinstance(block, ByRows):
        # Equal order values stay together. A large key's rows meet one row of cuts, so the join's skew can be split.
        cut = df.join(cut_points(df, keys, order, block), list(keys), "left")
        number = F.coalesce(F.size(F.filter("_cuts", lambda at: at < F.col(order))), F.lit(0)).cast("bigint")
        return cut.withColumn("_block", F.when(_keyless(keys) | F.col(order).isNull(), F.lit(_FIRST)).otherwise(number)).select(*df.columns, "_block")
    number = F.coalesce(F.floor(F.col(order) / block).cast("bigint"), F.lit(_FIRST))
    return df.withColumn("_block", F.when(_keyless(keys), F.lit(_FIRST)).otherwise(number))


def _across(keys: Sequence[str]):
    return W.partitionBy(*keys).orderBy("_block")


def _within(keys: Sequence[str], order: str):
    return W.partitionBy(*keys, "_block").orderBy(order)


def with_neighbour(df: DataFrame, keys: Sequence[str], order: str, values: Mapping[str, str],
                   ahead: bool = False, block: Block | None = BLOCK) -> DataFrame:
    """Adds columns of the previous (or next) row of the key; ``values`` maps source to output."""
    shift, pick = (F.lead, F.min_by) if ahead else (F.lag, F.max_by)
    packed = F.struct(*[F.col(source).alias(name) for source, name in values.items()])
    if block is None:
        near = shift(packed).over(W.partitionBy(*keys).orderBy(order))
        return df.withColumn("_near", near).select(*df.columns, *[F.col("_near")[n].alias(n) for n in values.values()])
    blocked = _blocked(df, keys, order, block).withColumn("_packed", packed)
    carried = (
        blocked.groupBy(*keys, "_block").agg(pick("_packed", order).alias("_edge"))
        .select(*keys, "_block", shift("_edge").over(_across(keys)).alias("_carry"))
        .where(F.col("_carry").isNotNull())
    )
    near = F.coalesce(F.col("_near"), F.col("_carry"))
    return (
        blocked.withColumn("_near", shift("_packed").over(_within(keys, order)))
        .join(carried, [*keys, "_block"], "left")
        .select(*df.columns, *[near[name].alias(name) for name in values.values()])
    )


def with_running_sum(df: DataFrame, keys: Sequence[str], order: str, value: Column, name: str,
                     block: Block | None = BLOCK) -> DataFrame:
    """Adds the inclusive running sum of ``value`` in order of a unique ``order`` column."""
    if block is None:
        return df.withColumn(name, F.sum(value).over(W.partitionBy(*keys).orderBy(order).rowsBetween(*_UP_TO)))
    blocked = _blocked(df, keys, order, block).withColumn("_value", value)
    carried = (
        blocked.groupBy(*keys, "_block").agg(F.sum("_value").alias("_sum"))
        .select(*keys, "_block", F.sum("_sum").over(_across(keys).rowsBetween(*_BEFORE)).alias("_carry"))
        .where(F.col("_carry").isNotNull())
    )
    local = F.sum("_value").over(_within(keys, order).rowsBetween(*_UP_TO))
    return (
        blocked.withColumn("_local", local)
        .join(carried, [*keys, "_block"], "left")
        .withColumn(name, F.col("_local") + F.coalesce(F.col("_carry"), F.lit(0)))
        .select(*[c for c in df.columns if c != name], name)
    )


def with_last_known(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str,
                    block: Block = BLOCK) -> DataFrame:
    """Fills ``name`` with the nearest non-null ``value`` at or before each row."""
    return with_bracket(df, keys, order, value, name, None, block)


def with_bracket(df: DataFrame, keys: Sequence[str], order: str, value: str, before: str,
                 after: str | None, block: Block = BLOCK) -> DataFrame:
    """Fills ``before`` and ``after`` with the nearest non-null ``value`` on either side.

    A row's own value counts for both sides. Every block keeps one summary row, so a block
    without any value still receives what its neighbours carry.
    """
    blocked = _blocked(df, keys, order, block)
    place = F.when(F.col(value).isNotNull(), F.col(order))
    sides = {before: (F.max_by, F.last, _UP_TO, _BEFORE)}
    if after:
        sides[after] = (F.min_by, F.first, _ONWARD, _AFTER)
    edges = blocked.groupBy(*keys, "_block").agg(*[
        pick(F.col(value), place).alias(f"_edge_{name}") for name, (pick, *_) in sides.items()
    ])
    carried = edges.select(*keys, "_block", *[
        take(f"_edge_{name}", ignorenulls=True).over(_across(keys).rowsBetween(*outer)).alias(f"_carry_{name}")
        for name, (_, take, _, outer) in sides.items()
    ])
    filled = blocked.withColumns({
        f"_local_{name}": take(value, ignorenulls=True).over(_within(keys, order).rowsBetween(*inner))
        for name, (_, take, inner, _) in sides.items()
    })
    return filled.join(carried, [*keys, "_block"], "left").select(
        *[c for c in df.columns if c not in sides],
        *[F.coalesce(f"_local_{name}", f"_carry_{name}").alias(name) for name in sides],
    )


def with_running_changes(df: DataFrame, keys: Sequence[str], order: str, value: str, changed, name: str,
                         block: Block | None = BLOCK) -> DataFrame:
    """Adds how often ``changed(previous, current)`` held up to each row of the key.

    One pass: a block counts its own changes, and its first and last value decide the
    change between blocks.
    """
    flag = lambda a, b: F.coalesce(changed(a, b).cast("int"), F.lit(0))
    if block is None:
        window = W.partitionBy(*keys).orderBy(order)
        marked = df.withColumn("_change", flag(F.lag(value).over(window), F.col(value)))
        return marked.withColumn(name, F.sum("_change").over(window.rowsBetween(*_UP_TO))).drop("_change")
    within = _within(keys, order)
    counted = (
        _blocked(df, keys, order, block)
        .withColumn("_previous", F.lag(value).over(within))
        .withColumn("_change", flag(F.col("_previous"), F.col(value)))
        .withColumn("_local", F.sum("_change").over(within.rowsBetween(*_UP_TO)))
    )
    edges = counted.groupBy(*keys, "_block").agg(
        F.min_by(value, order).alias("_head"), F.max_by(value, order).alias("_tail"), F.sum("_change").alias("_inner")
    )
    across = _across(keys)
    joined = (
        edges.withColumn("_before", F.lag("_tail").over(across))
        .withColumn("_entry", flag(F.col("_before"), F.col("_head")))
        .withColumn("_carry", F.sum(F.col("_entry") + F.col("_inner")).over(across.rowsBetween(*_UP_TO)) - F.col("_inner"))
        .select(*keys, "_block", "_carry")
    )
    carry = F.coalesce(F.col("_carry"), F.lit(0))
    return counted.join(joined, [*keys, "_block"], "left").withColumn(name, F.col("_local") + carry).select(
        *[c for c in df.columns if c != name], name
    )


def with_rank(df: DataFrame, keys: Sequence[str], digest: str, ties: Sequence[str], name: str,
              hex_digits: int = 4) -> DataFrame:
    """Adds the 1-based rank by (``digest``, ``ties``) within ``keys``; no keys means overall.

    The leading hex digits of a digest are uniform, so they cut any key, or the whole
    table, into even ranges whose sizes alone decide the offset of each range.
    """
    range_ = F.coalesce(F.substring(F.col(digest), 1, hex_digits), F.lit(""))
    scoped = df.withColumn("_block", F.when(_keyless(keys), F.lit("")).otherwise(range_))
    group = list(keys)
    across = (W.partitionBy(*group) if group else W.partitionBy(F.lit(0))).orderBy("_block")
    offsets = (
        scoped.groupBy(*group, "_block").agg(F.count("*").alias("_in_block"))
        .select(*group, "_block",
                F.coalesce(F.sum("_in_block").over(across.rowsBetween(*_BEFORE)), F.lit(0)).alias("_offset"))
    )
    local = F.row_number().over(W.partitionBy(*group, "_block").orderBy(digest, *ties))
    return (
        scoped.withColumn("_local", local)
        .join(offsets, [*group, "_block"], "left")
        .withColumn(name, (F.col("_local") + F.coalesce(F.col("_offset"), F.lit(0))).cast("bigint"))
        .select(*[c for c in df.columns if c != name], name)
    )


def runs(df: DataFrame, keys: Sequence[str], order: str,
         measures: Mapping[str, tuple[Column, str]], block: Block = BLOCK) -> DataFrame:
    """Maximal runs of consecutive ``order`` values; one row per run with an exclusive end.

    ``order`` must be unique per key. ``measures`` maps a name to a partial aggregate and
    the function (``sum``, ``max``, ``min``) that merges partials of a run spanning blocks.
    """
    local = (
        _blocked(df, keys, order, block)
        .withColumn("_island", F.col(order) - F.row_number().over(_within(keys, order)))
        .groupBy(*keys, "_block", "_island")
        .agg(F.min(order).alias("_first"), F.max(order).alias("_last"),
             *[partial.alias(name) for name, (partial, _) in measures.items()])
    )
    if isinstance(block, ByRows):
        inside = W.partitionBy(*keys, "_block")
        local = local.withColumn("_edge", (F.col("_first") == F.min("_first").over(inside)) | (F.col("_last") == F.max("_last").over(inside)))
        touches = F.col("_edge")
    else:
        touches = (F.pmod(F.col("_first"), F.lit(block)) == 0) | (F.pmod(F.col("_last"), F.lit(block)) == block - 1)
    chain = W.partitionBy(*keys).orderBy("_first")
    opens = F.coalesce(F.lag("_last").over(chain) + 1 != F.col("_first"), F.lit(True)).cast("int")
    stitched = (
        local.where(touches)
        .withColumn("_opens", opens)
        .withColumn("_run", F.sum("_opens").over(chain.rowsBetween(*_UP_TO)))
        .groupBy(*keys, "_run")
        .agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"),
             *[getattr(F, merge)(name).alias(name) for name, (_, merge) in measures.items()])
    )
    shape = [
        *keys,
        F.col("_first").alias("start_step"),
        (F.col("_last") + 1).cast(df.schema[order].dataType).alias("end_step"),
        *measures,
    ]
    return local.where(~touches).select(*shape).unionByName(stitched.select(*shape))


def with_run_start(df: DataFrame, keys: Sequence[str], order: str, name: str = "start_step",
                   block: Block = BLOCK) -> DataFrame:
    """Labels every row with the first ``order`` value of the consecutive run it belongs to."""
    stepped = with_neighbour(df, keys, order, {order: "_previous"}, block=block)
    starts = F.col("_previous").isNull() | (F.col("_previous") + 1 != F.col(order))
    marked = stepped.withColumn("_start", F.when(starts, F.col(order)))
    return with_last_known(marked, keys, order, "_start", name, block=block).drop("_previous", "_start")
