"""Rigid-body state trajectories: alignment, divergence and motion."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.functions import quaternions as Q
from scenelake.functions import vectors as V
from scenelake.operators import ordered
from scenelake.session import spread

TRACK = ("instance_id", "branch", "object_id")
POSE = ("position", "quaternion", "linear_velocity", "angular_velocity")


def branch_states(states: DataFrame, branch: str) -> DataFrame:
    return states.where(F.col("branch") == branch).drop("branch")


def misaligned(factual: DataFrame, counterfactual: DataFrame) -> DataFrame:
    """Instances with a (step, object) present in only one of the two branches."""
    keys = ["instance_id", "step", "object_id"]
    left = factual.select(*keys).withColumn("_f", F.lit(1))
    right = counterfactual.select(*keys).withColumn("_c", F.lit(1))
    lonely = left.join(right, keys, "full").where(F.col("_f").isNull() | F.col("_c").isNull())
    return lonely.groupBy("instance_id").agg(F.count("*").alias("unmatched_rows"))


def _gaps(unit_quaternions: bool = False) -> list[Column]:
    angle = Q.unit_angle_between if unit_quaternions else Q.angle_between
    f, c = (lambda name: F.col(f"f.{name}")), (lambda name: F.col(f"c.{name}"))
    return [
        V.distance(f("position"), c("position")).alias("position_gap"),
        V.distance(f("linear_velocity"), c("linear_velocity")).alias("linear_gap"),
        V.distance(f("angular_velocity"), c("angular_velocity")).alias("angular_gap"),
        angle(f("quaternion"), c("quaternion")).alias("rotation_gap"),
    ]


def state_gaps(factual: DataFrame, counterfactual: DataFrame, on: Sequence[str],
               unit_quaternions: bool = False) -> DataFrame:
    """Largest gap of each object over the rows both branches share."""
    keys = list(on)
    paired = factual.alias("f").join(
        counterfactual.alias("c"), [F.col(f"f.{k}") == F.col(f"c.{k}") for k in keys]
    ).select(*[F.col(f"f.{k}").alias(k) for k in keys], *_gaps(unit_quaternions))
    names = ("position_gap", "linear_gap", "angular_gap", "rotation_gap")
    # NaN sorts above every number; a gap that is not a number is no gap.
    return paired.groupBy("instance_id", "object_id").agg(*[F.max(F.when(~F.isnan(n), F.col(n))).alias(n) for n in names])


def _exceeds(position: float, velocity: float, rotation: float) -> Column:
    return (
        (F.col("position_gap") > position) | (F.col("linear_gap") > velocity)
        | (F.col("angular_gap") > velocity) | (F.col("rotation_gap") > rotation)
    )


def diverged(factual: DataFrame, counterfactual: DataFrame, targets: DataFrame,
             position_epsilon: float = 1e-3, velocity_epsilon: float = 1e-3,
             quaternion_epsilon: float = 1e-3) -> DataFrame:
    """Non-target objects whose aligned states differ at or after the intervention."""
    late = lambda side: side.join(targets.select("instance_id", "start_step"), "instance_id").where(
        F.col("step") >= F.col("start_step")).drop("start_step")
    gaps = state_gaps(late(factual), late(counterfactual), ("instance_id", "step", "object_id"))
    return (
        gaps.where(_exceeds(position_epsilon, velocity_epsilon, quaternion_epsilon))
        .join(targets.select("instance_id", F.col("target_id").alias("object_id")),
              ["instance_id", "object_id"], "left_anti")
    )


def with_step_index(states: DataFrame, keys: Sequence[str] = ("instance_id", "object_id"),
                    block: ordered.Block = ordered.BLOCK) -> DataFrame:
    """Zero-based position of each row on its own track."""
    counted = ordered.with_running_sum(states, keys, "step", F.lit(1), "step_index", block=block)
    return counted.withColumn("step_index", F.col("step_index") - 1)


def diverged_shared(factual: DataFrame, other: DataFrame, position_epsilon: float = 1e-3,
                    velocity_epsilon: float = 1e-3, quaternion_epsilon: float = 1e-3,
                    block: ordered.Block = ordered.BLOCK) -> DataFrame:
    """Divergence of the objects in both logs, matched by row position up to the shorter log."""
    gaps = state_gaps(
        with_step_index(factual, block=block), with_step_index(other, block=block),
        ("instance_id", "object_id", "step_index"), unit_quaternions=True,
    )
    return gaps.where(_exceeds(position_epsilon, velocity_epsilon, quaternion_epsilon))


def speed_limits(states: DataFrame, keys: Sequence[str] = ("instance_id", "branch")) -> DataFrame:
    """Largest linear and angular speed; any non-finite component makes it the largest double."""
    peak = lambda name: F.least(F.max(V.stable_norm(F.col(name))), F.lit(V.DOUBLE_MAX))
    return states.groupBy(*keys).agg(
        peak("linear_velocity").alias("max_linear_velocity"),
        peak("angular_velocity").alias("max_angular_velocity"),
    )


def nonfinite(states: DataFrame, keys: Sequence[str] = ("instance_id", "branch")) -> DataFrame:
    """Groups holding a state with a component that is not a finite number."""
    fine = reduce(lambda a, b: a & b, [
        V.all_finite(F.col(n), 4 if n == "quaternion" else 3) for n in POSE
    ])
    return states.where(~fine).select(*keys).distinct()


def motion_modes(states: DataFrame, step_rate: float, minimum_revolutions: float = 0.35,
                 minimum_travel: float = 0.10, keys: Sequence[str] = TRACK,
                 block: ordered.Block = ordered.BLOCK) -> DataFrame:
    """Path length, revolutions about horizontal axes and the motion label of each body."""
    stepped = ordered.with_neighbour(
        states.select(*keys, "step", "position", "angular_velocity"), keys, "step",
        {"position": "_previous"}, block=block,
    )
    spin = F.sqrt(F.col("angular_velocity")[0] ** 2 + F.col("angular_velocity")[1] ** 2)
    travel = F.coalesce(V.distance(F.col("position"), F.col("_previous")), F.lit(0.0))
    rolls, slides = F.col("revolutions") >= minimum_revolutions, F.col("path_length") >= minimum_travel
    mode = (
        F.when(rolls & slides, "both").when(rolls, "rolling").when(slides, "sliding").otherwise("static")
    )
    return (
        stepped.groupBy(*keys)
        .agg(F.sum(travel).alias("path_length"),
             (F.sum(spin) / F.lit(float(step_rate)) / F.lit(2.0 * math.pi)).alias("revolutions"))
        .withColumn("mode", mode)
    )


def max_displacement(factual: DataFrame, other: DataFrame, subjects: DataFrame,
                     environment: Sequence[str], block: ordered.Block = ordered.BLOCK) -> DataFrame:
    """Largest position gap of any shared body except the subject and the environment."""
    movable = lambda side: (
        side.where(~F.col("object_id").isin(*environment)) if environment else side
    ).select("instance_id", "object_id", "step", "position").join(
        subjects.select("instance_id", F.col("subject_id").alias("object_id")),
        ["instance_id", "object_id"], "left_anti",
    )
    left = with_step_index(movable(factual), block=block)
    right = with_step_index(movable(other), block=block).withColumnRenamed("position", "_other").drop("step")
    gaps = left.join(right, ["instance_id", "object_id", "step_index"]).groupBy("instance_id").agg(
        F.max(V.distance(F.col("position"), F.col("_other"))).alias("_gap")
    )
    return subjects.select("instance_id").join(gaps, "instance_id", "left").select(
        "instance_id", F.coalesce("_gap", F.lit(0.0)).alias("max_displacement")
    )


def commanded_velocities(paths: DataFrame, step_rate: float,
                         keys: Sequence[str] = ("instance_id", "branch"),
                         block: ordered.Block = ordered.BLOCK) -> DataFrame:
    """Backward-difference velocity of a commanded path; the first sample is at rest.

    Values outside the single-precision range raise.
    """
    limit = 3.4028234663852886e38
    stepped = ordered.with_neighbour(paths, keys, "step", {"position": "_previous"}, block=block)
    lanes = []
    for axis in range(3):
        lane = F.coalesce((F.col("position")[axis] - F.col("_previous")[axis]) * float(step_rate), F.lit(0.0))
        lanes.append(F.when(lane.between(-limit, limit), lane).otherwise(
            F.raise_error(F.lit("commanded velocity exceeds single precision"))))
    return stepped.withColumn("velocity", F.array(*lanes)).drop("_previous")


def continuous_quaternions(tracks: DataFrame, keys: Sequence[str], order: str,
                           block: ordered.Block | None = ordered.BLOCK) -> DataFrame:
    """Normalises quaternions and flips signs so neighbours never oppose.

    Flipping is cumulative, and a flip happens exactly where the raw neighbours oppose,
    so the sign is the parity of the running count of opposing neighbours.
    """
    normal = tracks.withColumn("quaternion", Q.unit(F.col("quaternion")))
    opposes = lambda a, b: V.dot(a, b, 4) < 0.0
    counted = ordered.with_running_changes(normal, keys, order, "quaternion", opposes, "_flips", block=block)
    sign = F.when(F.pmod(F.col("_flips"), F.lit(2)) == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    return counted.withColumn("quaternion", V.scale(F.col("quaternion"), sign, 4)).drop("_flips")


def prefix_mismatches(factual: DataFrame, counterfactual: DataFrame, targets: DataFrame) -> DataFrame:
    """Objects whose twin states differ before the intervention, or at step 0 for non-targets."""
    keys = ["instance_id", "step", "object_id"]
    early = lambda side: side.join(targets, "instance_id").where(
        (F.col("step") < F.col("start_step"))
        | ((F.col("step") == 0) & (F.col("object_id") != F.col("target_id")))
    ).select(*keys, F.struct(*POSE).alias("_state"))
    joined = early(factual).join(early(counterfactual).withColumnRenamed("_state", "_twin"), keys, "full")
    return joined.where(~F.col("_state").eqNullSafe(F.col("_twin"))).groupBy("instance_id", "object_id").agg(
        F.count("*").alias("mismatched_steps")
    )


def prefix_contact_mismatches(factual: DataFrame, counterfactual: DataFrame, targets: DataFrame,
                              columns: Sequence[str]) -> DataFrame:
    """Contact records before the intervention that the twin lacks, counted as a multiset."""
    early = lambda side, sign: side.join(targets.select("instance_id", "start_step"), "instance_id").where(
        F.col("step") < F.col("start_step")).select("instance_id", *columns, F.lit(sign).alias("_sign"))
    both = early(factual, 1).unionByName(early(counterfactual, -1))
    balance = spread(both, "instance_id", *columns).groupBy("instance_id", *columns).agg(F.sum("_sign").alias("_balance"))
    return balance.where("_balance <> 0").groupBy("instance_id").agg(
        F.sum(F.abs("_balance")).alias("unmatched_contacts")
    )


def frame_steps(scenes: DataFrame) -> DataFrame:
    """Simulation step of every frame of a half-open frame range."""
    per_frame = (F.col("step_rate") / F.col("frame_rate")).cast("int")
    frames = F.sequence(F.col("frame_start"), F.col("frame_end") - 1)
    return scenes.where(F.col("frame_end") > F.col("frame_start")).select(
        "*", F.explode(frames).alias("frame")
    ).withColumn("step", ((F.col("frame") - F.col("frame_start")) * per_frame).cast("int"))


def duration_steps(scenes: DataFrame) -> DataFrame:
    """Number of steps per scene; invalid rates or fewer than two steps give null."""
    frames = F.col("frame_end") - F.col("frame_start")
    count = F.floor(frames * F.col("step_rate") / F.col("frame_rate")).cast("int")
    fine = (frames > 0) & (F.pmod(F.col("step_rate"), F.col("frame_rate")) == 0) & (count >= 2)
    return scenes.withColumn("duration_steps", F.when(fine, count))


def path_deviation(factual: DataFrame, perturbed: DataFrame,
                   keys: Sequence[str] = ("instance_id",)) -> DataFrame:
    """Largest per-sample distance between a path and its perturbation."""
    other = perturbed.select(*keys, "step", F.col("position").alias("_other"))
    gap = V.stable_norm(V.subtract(F.col("position"), F.col("_other")))
    return factual.join(other, [*keys, "step"]).groupBy(*keys).agg(F.max(gap).alias("max_deviation"))


def command_violations(states: DataFrame, commands: DataFrame, objects: DataFrame,
                       penetrations: DataFrame, step_rate: float, gravity: float,
                       block: ordered.Block = ordered.BLOCK) -> DataFrame:
    """Target poses that leave their commanded pose by more than the per-row tolerance.

    Free steps must match to single-precision rounding; a step with a recorded
    penetration may move by the larger of the commanded travel and the penetration.
    Of several peers at a step the deepest counts. ``states`` are target rows; ``objects`` gives instance_id, radius and smallest_size.
    """
    single = 2.0 ** -23
    travel = commanded_velocities(commands, step_rate, keys=("instance_id",), block=block)
    joined = (
        states.join(travel.select("instance_id", "step", F.col("position").alias("_p"),
                                  F.col("quaternion").alias("_q"), "velocity"), ["instance_id", "step"])
        .join(objects, "instance_id")
        .join(penetrations.groupBy("instance_id", "step").agg(F.max("depth").alias("depth")), ["instance_id", "step"], "left")
    )
    # Spacing of a single-precision number: one unit in its last place.
    real = F.array(*[F.col("_p")[i].cast("float").cast("double") for i in range(3)])
    ulp = F.array(*[
        F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(F.abs(real[i]), F.lit(2.0 ** -126)))) - 23) for i in range(3)
    ])
    error = V.subtract(F.col("position"), real)
    norm_error = F.abs(V.norm(F.col("quaternion"), 4) - 1.0)
    turn = Q.angle_between(F.col("quaternion"), F.array(*[F.col("_q")[i].cast("float").cast("double") for i in range(4)]))
    depth = F.least(F.col("radius"), F.col("depth"))
    allowance = (
        F.greatest(V.norm(F.col("velocity")) / float(step_rate), depth)
        + 0.5 * gravity / float(step_rate) ** 2 + V.norm(V.scale(ulp, 4.0))
    )
    cap = F.least(F.lit(math.pi), F.col("radius") / F.col("smallest_size"))
    twist = F.least(cap, depth / F.col("smallest_size")) + 8.0 * single
    free = F.col("depth").isNull()
    off_free = reduce(lambda a, b: a | b, [F.abs(error[i]) > 4.0 * ulp[i] for i in range(3)])
    reason = (
        F.when(norm_error > 4.0 * single, "quaternion_norm")
        .when(free & off_free, "position_mismatch")
        .when(free & (turn > 8.0 * single), "quaternion_mismatch")
        .when(~free & (V.norm(error) > allowance), "position_envelope")
        .when(~free & (turn > twist), "quaternion_envelope")
    )
    return joined.select("instance_id", "step", reason.alias("reason"), V.norm(error).alias("position_error")).where(
        F.col("reason").isNotNull()
    )
