"""Spatial predicates: box overlap, static clipping, swept segments and framing."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.functions import camera as C
from scenelake.functions import quaternions as Q
from scenelake.functions import shapes as S
from scenelake.functions import vectors as V
from scenelake.operators import ordered


def _every(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _whole(df: DataFrame) -> DataFrame:
    """A join's side that is shuffled, never broadcast.

    The optimiser takes exploded rows for as few as they came from and would pass all of them through the driver.
    """
    return df.hint("merge")


#: Cells that a segment passes along its longest axis at its own level, about.
SLABS = 64
_CELLS = ["_at", "_x", "_y", "_z"]


def _level(width: Column, cell: float) -> Column:
    """The least level at whose cells, ``cell`` doubled so many times, ``width`` spans one cell at most."""
    return F.greatest(F.coalesce(F.ceil(F.log2(width / cell)), F.lit(0)), F.lit(0)).cast("int")


def _levelled(df: DataFrame, lower: Column, upper: Column, cell: float) -> DataFrame:
    """Boxes with ``_lower``, ``_upper`` and ``_level``; a null or non-finite corner gives no level, and no cells later."""
    half = F.greatest(*[F.col("_upper")[i] / 2 - F.col("_lower")[i] / 2 for i in range(3)])
    level = F.when(V.all_finite(F.col("_lower")) & V.all_finite(F.col("_upper")), _level(half, cell / 2))
    return df.withColumns({"_lower": lower, "_upper": upper}).withColumn("_level", level)


def _at_own(df: DataFrame) -> DataFrame:
    return df.withColumn("_at", F.col("_level"))


def _at_others(df: DataFrame, others: DataFrame, keys: Sequence[str], also_own: bool) -> DataFrame:
    """Rows once per level of the other side that is coarser than their own, or as coarse too."""
    found = others.groupBy(*keys).agg(F.collect_set("_level").alias("_levels"))
    at = F.filter("_levels", lambda level: level >= F.col("_level") if also_own else level > F.col("_level"))
    return df.join(_whole(found), list(keys)).withColumn("_at", F.explode(at)).drop("_levels")


def _tiled(df: DataFrame, cell: float) -> DataFrame:
    """One row per cell of its level ``_at`` that a box touches, with its lowest cell as ``_base``: eight rows at most."""
    index = lambda corner, i: F.floor(F.col(corner)[i] / (F.pow(F.lit(2.0), F.col("_at")) * cell)).cast("bigint")
    tiled = df.withColumn("_base", F.array(*[index("_lower", i) for i in range(3)]))
    for i, axis in enumerate("xyz"):
        tiled = tiled.withColumn(f"_{axis}", F.explode(F.sequence(F.col("_base")[i], index("_upper", i))))
    return tiled.drop("_lower", "_upper", "_level")


def _sharing(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tiled boxes of the same key that share a cell, each pair from its first shared cell only."""
    joined = left.withColumnRenamed("_base", "_base_l").join(_whole(right.withColumnRenamed("_base", "_base_r")), [*keys, *_CELLS])
    first = _every([F.col(c) == F.greatest(F.col("_base_l")[i], F.col("_base_r")[i]) for i, c in enumerate(_CELLS[1:])])
    return joined.where(first).drop(*_CELLS, "_base_l", "_base_r")


def _meeting(left: DataFrame, right: DataFrame, keys: Sequence[str], cell: float) -> DataFrame:
    """Pairs of levelled boxes of the same key whose cells meet, each pair once.

    Every box lies in the few cells of its own level, and looks at the cells of the other side's coarser levels: a pair meets
    at the coarser of its two levels. Columns of the two sides must differ, except keys and levels.
    """
    finer = _sharing(_tiled(_at_others(left, right, keys, True), cell), _tiled(_at_own(right), cell), keys)
    coarser = _sharing(_tiled(_at_own(left), cell), _tiled(_at_others(right, left, keys, False), cell), keys)
    return finer.unionByName(coarser)


def overlaps(boxes: DataFrame, cell: float) -> DataFrame:
    """Pairs of boxes of an instance that strictly overlap.

    ``boxes`` holds instance_id, object_id, position and extent. Boxes meet in the cells of a hierarchical grid whose finest
    cells are ``cell`` wide, so candidates are neighbours in space and not all pairs of an instance, however much the
    boxes differ in size; ``cell`` near the width of most boxes is best.
    """
    given = _levelled(
        boxes.select("instance_id", "object_id", "position", "extent"),
        V.subtract(F.col("position"), F.col("extent")), V.add(F.col("position"), F.col("extent")), cell,
    )
    side = lambda df, s: df.select("instance_id", "_base", *_CELLS, *[F.col(c).alias(f"{c}_{s}") for c in ("object_id", "position", "extent", "_fine")])
    fine = given.withColumn("_fine", F.col("_level"))
    pairs = _sharing(side(_tiled(_at_others(fine, given, ["instance_id"], True), cell), "a"), side(_tiled(_at_own(fine), cell), "b"), ["instance_id"])
    # Of two boxes of one level each finds the other; of different ones only the smaller does.
    once = (F.col("_fine_a") < F.col("_fine_b")) & (F.col("object_id_a") != F.col("object_id_b")) | (F.col("_fine_a") == F.col("_fine_b")) & (F.col("object_id_a") < F.col("object_id_b"))
    strict = _every([
        F.abs(F.col("position_a")[i] - F.col("position_b")[i]) < F.col("extent_a")[i] + F.col("extent_b")[i] for i in range(3)
    ])
    return pairs.where(once & strict).select(
        "instance_id", F.least("object_id_a", "object_id_b").alias("object_a"), F.greatest("object_id_a", "object_id_b").alias("object_b")
    )


def crowded(boxes: DataFrame) -> DataFrame:
    """Instances of a few boxes each, of which two strictly overlap as in :func:`overlaps`.

    The boxes of an instance travel as one list and are compared in its row, so a parameter has to bound their number.
    ``boxes`` shuffled by instance already are not shuffled again.
    """
    # Judged in the list: a condition on the rows would be moved below what made them, and make it again.
    placed = lambda box: V.all_finite(V.subtract(box["position"], box["extent"])) & V.all_finite(V.add(box["position"], box["extent"]))
    listed = boxes.groupBy("instance_id").agg(F.filter(F.collect_list(F.struct("object_id", "position", "extent")), placed).alias("_boxes"))
    meet = lambda a, b: _every([a["object_id"] < b["object_id"]] + [
        F.abs(a["position"][i] - b["position"][i]) < a["extent"][i] + b["extent"][i] for i in range(3)])
    return listed.where(F.exists("_boxes", lambda a: F.exists("_boxes", lambda b: meet(a, b)))).select("instance_id")


def static_clips(states: DataFrame, targets: DataFrame, obstacles: DataFrame, epsilon: float = 1e-9,
                 cell: float = 1.0) -> DataFrame:
    """Steps at which the target's rotated box sinks into a static obstacle on all axes.

    ``obstacles`` holds instance_id, object_id, position, extent, clip_exempt. Poses and
    obstacles meet in grid cells of width ``cell``.
    """
    target = states.join(targets, "instance_id").where(F.col("object_id") == F.col("target_id")).select(
        "instance_id", "branch", "step", F.col("position").alias("_p"),
        S.rotated_extents(F.col("shape"), F.col("size"), F.col("quaternion")).alias("_e"),
    )
    moving = _levelled(target, V.subtract(F.col("_p"), F.col("_e")), V.add(F.col("_p"), F.col("_e")), cell)
    solid = obstacles.where(~F.coalesce(F.col("clip_exempt"), F.lit(False))).select(
        "instance_id", F.col("object_id").alias("obstacle_id"), "position", "extent")
    fixed = _levelled(solid, V.subtract(F.col("position"), F.col("extent")), V.add(F.col("position"), F.col("extent")), cell)
    deep = _every([
        F.col("_e")[i] + F.col("extent")[i] - F.abs(F.col("_p")[i] - F.col("position")[i]) > epsilon
        for i in range(3)
    ])
    return _meeting(moving, fixed, ["instance_id"], cell).where(deep).select("instance_id", "branch", "step", "obstacle_id")


def out_of_bounds(states: DataFrame, targets: DataFrame, bounds: DataFrame, epsilon: float = 1e-9) -> DataFrame:
    """Steps at which the target's rotated box leaves the scene bounds."""
    extent = S.rotated_extents(F.col("shape"), F.col("size"), F.col("quaternion"))
    joined = (
        states.join(targets, "instance_id").where(F.col("object_id") == F.col("target_id"))
        .join(bounds, "instance_id").withColumn("_e", extent)
    )
    outside = reduce(lambda a, b: a | b, [
        (F.col("position")[i] - F.col("_e")[i] < F.col("lower")[i] - epsilon)
        | (F.col("position")[i] + F.col("_e")[i] > F.col("upper")[i] + epsilon)
        for i in range(3)
    ])
    return joined.where(outside).select("instance_id", "branch", "step")


def segment_hits_box(start: Column, end: Column, lower: Column, upper: Column, closed: bool = True) -> Column:
    """Slab test of a segment against a box; touching counts only for a closed box.

    Halves are compared, which is exact, so that no difference overflows.
    """
    huge = F.greatest(*[F.abs(v[i]) for v in (start, end, lower, upper) for i in range(3)]) > 2.0 ** 1000
    entries, exits, outside = [F.lit(0.0)], [F.lit(1.0)], []
    for axis in range(3):
        s, e, low, high = (v[axis] * 0.5 for v in (start, end, lower, upper))
        delta = e - s
        still = delta == 0.0
        one, two = (low - s) / delta, (high - s) / delta
        entries.append(F.when(still, F.lit(0.0)).otherwise(F.least(one, two)))
        exits.append(F.when(still, F.lit(1.0)).otherwise(F.greatest(one, two)))
        beyond = (s < low) | (s > high) if closed else (s <= low) | (s >= high)
        outside.append(still & beyond)
    entry, leave = F.greatest(*entries), F.least(*exits)
    crossing = entry <= leave if closed else entry < leave
    # For huge values all of the box may fall on one rounded parameter: ask the edge axes too.
    return crossing & ~reduce(lambda a, b: a | b, outside) & ~(huge & V.bind(F.array(start, end, lower, upper), _beside))


def _beside(corners: Column) -> Column:
    """Whether an edge axis parts a segment (start, end) from a box (lower, upper)."""
    start, end, lower, upper = (corners[i] for i in range(4))
    reach = [end[i] / 2 - start[i] / 2 for i in range(3)]
    longest = F.greatest(*[F.abs(x) for x in reach])
    along = [F.when(longest > 0, x / longest).otherwise(F.lit(0.0)) for x in reach]
    away = [lower[i] / 2 + upper[i] / 2 - (start[i] / 2 + end[i] / 2) for i in range(3)]
    half = [upper[i] / 2 - lower[i] / 2 for i in range(3)]
    return reduce(lambda a, b: a | b, [
        F.abs(along[i] * away[j] - along[j] * away[i]) > half[i] * F.abs(along[j]) + half[j] * F.abs(along[i]) for i, j in ((0, 1), (0, 2), (1, 2))])


def swept_hits(paths: DataFrame, boxes: DataFrame, clearance: float = 0.0, closed: bool = True,
               keys: Sequence[str] = ("instance_id",), block: ordered.Block = ordered.BLOCK, cell: float = 1.0) -> DataFrame:
    """Path segments that meet a box widened by ``clearance``; a (key, step, obstacle) each once.

    Boxes lie in a hierarchical grid. A segment passes the cells along its way, not those of its bounding box, at a level
    where these are about SLABS at most, and at the coarser levels of its key's boxes.
    """
    segments = ordered.with_neighbour(
        paths.select(*keys, "step", "position"), keys, "step", {"position": "_end"}, ahead=True, block=block
    ).where(F.col("_end").isNotNull())
    low = F.array(*[F.col("lower")[i] - clearance for i in range(3)])
    high = F.array(*[F.col("upper")[i] + clearance for i in range(3)])
    fixed = _levelled(boxes.select(*keys, F.col("object_id").alias("obstacle_id"), "lower", "upper"), low, high, cell)
    fixed = fixed.select(*keys, "obstacle_id", "_lower", "_upper", "_level", F.col("_lower").alias("_low"), F.col("_upper").alias("_high"))
    half = F.greatest(*[F.abs(F.col("_end")[i] / 2 - F.col("position")[i] / 2) for i in range(3)])
    finite = V.all_finite(F.col("position")) & V.all_finite(F.col("_end"))
    moving = segments.withColumn("_level", F.when(finite, _level(half / SLABS, cell / 2)))
    hit = segment_hits_box(F.col("position"), F.col("_end"), F.col("_low"), F.col("_high"), closed)
    shared = [*keys, *_CELLS]
    finer = _passed(_at_others(moving, fixed, keys, True), cell).join(_whole(_tiled(_at_own(fixed), cell).drop("_base")), shared)
    coarser = _passed(_at_own(moving), cell).join(_whole(_tiled(_at_others(fixed, moving, keys, False), cell).drop("_base")), shared)
    # The cells of a way are no box: a pair may meet in several of them.
    return finer.unionByName(coarser).where(hit).select(*keys, "step", "obstacle_id").distinct()


def _passed(segments: DataFrame, cell: float) -> DataFrame:
    """One row per cell of level ``_at`` on the way from ``position`` to ``_end``, and a few beside it.

    The longest axis is cut into slabs of one cell; within a slab the other two coordinates move by a cell at most.
    """
    start, end = F.col("position"), F.col("_end")
    # As in segment_hits_box, so that no difference overflows.
    scale = F.when(F.greatest(*[F.abs(v[i]) for v in (start, end) for i in range(3)]) > 2.0 ** 1000, F.lit(2.0 ** -100)).otherwise(F.lit(1.0))
    way = segments.withColumns({"_s": F.array(*[start[i] * scale for i in range(3)]), "_e": F.array(*[end[i] * scale for i in range(3)]),
                                "_size": F.pow(F.lit(2.0), F.col("_at")) * cell * scale})
    reach = [F.abs(F.col("_e")[i] - F.col("_s")[i]) for i in range(3)]
    way = way.withColumn("_axis", F.when((reach[0] >= reach[1]) & (reach[0] >= reach[2]), 0).when(reach[1] >= reach[2], 1).otherwise(2))
    index = lambda value: F.floor(value / F.col("_size")).cast("bigint")
    s, e = F.get("_s", F.col("_axis")), F.get("_e", F.col("_axis"))
    way = way.withColumn("_slab", F.explode(F.sequence(index(F.least(s, e)), index(F.greatest(s, e)))))
    still = s == e
    enter, leave = (F.col("_slab") * F.col("_size") - s) / (e - s), ((F.col("_slab") + 1) * F.col("_size") - s) / (e - s)
    way = way.withColumns({"_from": F.when(still, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(enter, leave))),
                           "_to": F.when(still, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(enter, leave)))})
    for i, axis in enumerate("xyz"):
        a, b = F.col("_s")[i], F.col("_e")[i]
        one, two = a + F.col("_from") * (b - a), a + F.col("_to") * (b - a)
        # Room for rounding.
        slack = F.col("_size") * 1e-9 + (F.abs(a) + F.abs(b)) * 1e-15
        cells = F.sequence(index(F.least(one, two) - slack), index(F.greatest(one, two) + slack))
        way = way.withColumn(f"_{axis}", F.explode(F.when(F.col("_axis") == i, F.array("_slab")).otherwise(cells)))
    return way.drop("_s", "_e", "_size", "_axis", "_slab", "_from", "_to", "_level")


def path_violations(paths: DataFrame, bounds: DataFrame | None = None, boxes: DataFrame | None = None,
                    clearance: float = 0.0, keys: Sequence[str] = ("instance_id",),
                    block: ordered.Block = ordered.BLOCK, cell: float = 1.0) -> DataFrame:
    """Rule codes broken by each path; an absent path row means the path is valid."""
    tolerance = 1e-6
    found = []
    code = lambda df, name: df.select(*keys, F.lit(name).alias("code")).distinct()
    found.append(code(paths.where(~V.all_finite(F.col("position"))), "not_finite"))
    found.append(code(paths.groupBy(*keys).count().where("count < 2"), "too_short"))
    if "quaternion" in paths.columns:
        q = F.col("quaternion")
        found.append(code(paths.where(~(F.abs(V.stable_norm(q, 4) - 1.0) <= tolerance)), "not_unit"))
        stepped = ordered.with_neighbour(paths, keys, "step", {"quaternion": "_previous"}, block=block)
        found.append(code(stepped.where(V.dot(q, F.col("_previous"), 4) < -tolerance), "sign_flip"))
    if bounds is not None:
        outside = reduce(lambda a, b: a | b, [
            (F.col("position")[i] < F.col("lower")[i]) | (F.col("position")[i] > F.col("upper")[i]) for i in range(3)
        ])
        found.append(code(paths.join(bounds, list(keys)).where(outside), "outside_bounds"))
    if boxes is not None:
        found.append(code(swept_hits(paths, boxes, clearance, True, keys, block, cell), "hits_static"))
    return reduce(lambda a, b: a.unionByName(b), found)


def framing(cameras: DataFrame, targets: DataFrame, margin: float = 0.0) -> DataFrame:
    """Whether each camera sees every target point of its instance, with a margin.

    Every camera has to be tested against every target of its instance. Both sides are
    shuffled by it, never broadcast, so verdicts fold where the join makes them.
    """
    wide, tall = C.frustum(F.col("focal_length"), F.col("sensor_width"), F.col("aspect"), F.lit(float(margin)))
    views = cameras.select("instance_id", "camera", "position", C.view_axes(F.col("position"), F.col("look_at")).alias("_axes"), wide.alias("_wide"), tall.alias("_tall"))
    inside = C.frames_point(F.col("target"), F.col("position"), F.col("_axes"), F.col("_wide"), F.col("_tall"))
    return views.join(_whole(targets), "instance_id").groupBy("instance_id", "camera").agg(
        F.every(F.coalesce(inside, F.lit(False))).alias("frames_all"), F.count("*").alias("target_count")
    )


def coarse_camera_fit(cameras: DataFrame, scenes: DataFrame, safety_margin: float) -> DataFrame:
    """Whether all corners of the scene bounds stay within ``depth * safety_margin`` sideways."""
    separate = V.distance(F.col("look_at"), F.col("position")) > 1e-6
    forward = V.normalise(V.subtract(F.col("look_at"), F.col("position")))
    right = V.normalise(V.cross(V.vector(0.0, 0.0, 1.0), F.col("_forward")),
                        fallback=V.vector(1.0, 0.0, 0.0), epsilon=1e-12)
    joined = (
        cameras.join(scenes.select("instance_id", "lower", "upper"), "instance_id")
        .withColumn("_forward", forward).withColumn("_right", right)
        .withColumn("_up", V.cross(F.col("_forward"), F.col("_right")))
    )
    verdicts = [separate]
    for bits in range(8):
        corner = F.array(*[F.col("upper" if bits >> i & 1 else "lower")[i] for i in range(3)])
        relative = V.subtract(corner, F.col("position"))
        depth = V.dot(relative, F.col("_forward"))
        reach = depth * float(safety_margin)
        verdicts.append((depth > 0.0) & (F.abs(V.dot(relative, F.col("_right"))) <= reach)
                        & (F.abs(V.dot(relative, F.col("_up"))) <= reach))
    return joined.select("instance_id", "camera", _every(verdicts).alias("fits"))


def scene_boundaries(regions: DataFrame, widen: float = 0.1) -> DataFrame:
    """Spawn region widened on each side; the floor's top must equal the region's bottom."""
    return regions.withColumns({
        "boundary_lower": F.array(*[F.col("lower")[i] - widen for i in range(3)]),
        "boundary_upper": F.array(*[F.col("upper")[i] + widen for i in range(3)]),
        "floor_matches": F.abs(F.col("floor_top") - F.col("lower")[2]) <= 1e-8 + 1e-5 * F.abs(F.col("lower")[2]),
    })
