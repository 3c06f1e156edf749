"""Acceptance checks over whole instances."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.functions import vectors as V
from scenelake.operators import contacts as K
from scenelake.operators import integrity as I
from scenelake.operators import spatial as X
from scenelake.operators import states as S
from scenelake.plans import ground_truth as T
from scenelake.session import cut_lineage


def _codes(flags: Mapping[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(flags[c], F.lit(False)), F.lit(c)) for c in sorted(flags)]))


def _flag(df: DataFrame, name: str) -> DataFrame:
    return df.select("instance_id").distinct().withColumn(name, F.lit(True))


def pair_quality(specs: DataFrame, objects: DataFrame, states: DataFrame, contacts: DataFrame, paths: DataFrame,
                 truth: T.GroundTruth, targets: DataFrame, linear_ceiling: float = 100.0,
                 angular_ceiling: float = 100.0, clip_epsilon: float = 1e-9) -> DataFrame:
    """Sorted rejection reasons and metrics of factual / counterfactual pairs.

    ``specs``: instance_id, target_id, start_step, end_step, recipe, magnitude,
    expected_effect, step_count, lower, upper. ``objects``: instance_id, object_id,
    shape, size, position, quaternion, static, clip_exempt. ``paths``: instance_id,
    branch, step, position and quaternion of the commanded target.
    """
    # Every check below reads these; one plan would make them anew for each.
    specs, targets, states, objects = (cut_lineage(df) for df in (specs, targets, states, objects))
    f, c = S.branch_states(states, "factual"), S.branch_states(states, "counterfactual")
    summary = T.summary(truth, targets)

    wanted_steps = specs.select("instance_id", F.explode(F.sequence(F.lit(0), F.col("step_count") - 1)).alias("step"))
    grid = wanted_steps.join(objects.select("instance_id", "object_id"), "instance_id")
    broken = [
        S.misaligned(f, c),
        S.misaligned(f, grid), S.misaligned(c, grid),
        I.dangling_contacts(contacts, objects, wanted_steps),
        path_breaks(paths, specs),
    ]
    misaligned = reduce(lambda a, b: a.unionByName(b), [b.select("instance_id") for b in broken])
    limits = S.speed_limits(states, keys=("instance_id",))
    start = targets.select("instance_id", "target_id", "start_step")
    early = lambda side: side.join(start.select("instance_id", "start_step"), "instance_id").where("step < start_step")
    prefix = I.multiset_difference(
        early(f).select("instance_id", "step", "object_id", *S.POSE), early(c).select("instance_id", "step", "object_id", *S.POSE)
    ).select("instance_id").unionByName(
        S.prefix_contact_mismatches(
            contacts.where("branch = 'factual'"), contacts.where("branch = 'counterfactual'"), start,
            [n for n in contacts.columns if n not in ("instance_id", "branch")],
        ).select("instance_id")
    )
    body = objects.join(specs.select("instance_id", "target_id"), "instance_id").where("object_id = target_id").select(
        "instance_id", "target_id", "shape", "size")
    from scenelake.functions import shapes
    solid = objects.join(specs.select("instance_id", "target_id"), "instance_id").where("static and object_id <> target_id").select(
        "instance_id", "object_id", "position", "clip_exempt",
        shapes.rotated_extents(F.col("shape"), F.col("size"), F.col("quaternion")).alias("extent"))
    outside = X.out_of_bounds(states, body, specs.select("instance_id", "lower", "upper"), clip_epsilon)
    clips = X.static_clips(states, body, solid, clip_epsilon)

    joined = specs
    for frame in (
        _flag(misaligned, "_misaligned"), _flag(S.nonfinite(states), "_nonfinite"), limits,
        _flag(prefix, "_prefix"), _flag(outside, "_outside"), _flag(clips, "_clip"),
        _flag(shared_peers(contacts, objects, specs), "_peers"),
        _flag(changed_window(paths, specs), "_retimed"), summary,
    ):
        joined = joined.join(frame, "instance_id", "left")
    aligned = F.col("_misaligned").isNull()
    affected, changed = F.col("hard") + F.col("soft"), F.col("added") + F.col("removed") + F.col("changed")
    yes = lambda name: F.coalesce(F.col(name), F.lit(False))
    recipe = F.col("recipe")
    outcome = (
        F.when(recipe == "create_collision", yes("target_added"))
        .when(recipe.isin("remove_collision", "break_contact"), yes("target_removed"))
        .when(recipe == "maintain_contact", yes("_peers"))
        .when(recipe == "retime", (F.col("magnitude") != 0.0) & yes("_retimed"))
        .otherwise(F.lit(False))
    )
    effect = F.col("expected_effect")
    reasons = _codes({
        "branch_misaligned": ~aligned,
        "nonfinite_state": yes("_nonfinite"),
        "linear_velocity_ceiling": F.coalesce(F.col("max_linear_velocity"), F.lit(V.DOUBLE_MAX)) > linear_ceiling,
        "angular_velocity_ceiling": F.coalesce(F.col("max_angular_velocity"), F.lit(V.DOUBLE_MAX)) > angular_ceiling,
        "twin_prefix_mismatch": aligned & yes("_prefix"),
        "target_out_of_bounds": yes("_outside"),
        "target_static_clip": yes("_clip"),
        "empty_affected": (effect == "non_null") & (affected == 0),
        "expected_null_mismatch": (effect == "null") & ((affected > 0) | (changed > 0)),
        "recipe_outcome_mismatch": aligned & (effect == "non_null") & ~outcome,
    })
    return joined.select(
        "instance_id", reasons.alias("reasons"), "max_linear_velocity", "max_angular_velocity",
        affected.alias("affected_count"), changed.alias("contact_delta_count"),
    ).withColumn("accepted", F.size("reasons") == 0)


def path_breaks(paths: DataFrame, specs: DataFrame) -> DataFrame:
    """Instances whose commanded paths do not fit their spec.

    Outside the open intervention window, and at its two anchors, both branches must be
    identical; inside, the offset may not exceed the magnitude.
    """
    keys = ["instance_id", "step"]
    lanes = ("position", "quaternion")
    f = paths.where("branch = 'factual'").select(*keys, *[F.col(n).alias(f"_f_{n}") for n in lanes])
    c = paths.where("branch = 'counterfactual'").select(*keys, *[F.col(n).alias(f"_c_{n}") for n in lanes])
    window = specs.select("instance_id", "magnitude", F.col("start_step").alias("_from"), F.col("end_step").alias("_to"))
    both = f.join(c, keys, "full").join(window, "instance_id")
    same = reduce(lambda a, b: a & b, [F.col(f"_f_{n}").eqNullSafe(F.col(f"_c_{n}")) for n in lanes])
    fixed = (F.col("step") <= F.col("_from")) | (F.col("step") >= F.col("_to") - 1) | (F.col("magnitude") == 0.0)
    gap = V.stable_norm(V.subtract(F.col("_c_position"), F.col("_f_position")))
    incomplete = F.col("_f_position").isNull() | F.col("_c_position").isNull()
    bad = incomplete | (fixed & ~same) | (gap > F.col("magnitude") + 1e-12)
    counts = both.groupBy("instance_id").agg(F.count("*").alias("_n"), F.count_if(F.coalesce(bad, F.lit(True))).alias("_bad"))
    return specs.join(counts, "instance_id", "left").where(
        F.col("_n").isNull() | (F.col("_n") != F.col("step_count")) | (F.col("_bad") > 0)
    ).select("instance_id")


def changed_window(paths: DataFrame, specs: DataFrame) -> DataFrame:
    """Instances whose two commanded paths differ somewhere inside the window."""
    keys = ["instance_id", "step"]
    f = paths.where("branch = 'factual'").select(*keys, F.struct("position", "quaternion").alias("_f"))
    c = paths.where("branch = 'counterfactual'").select(*keys, F.struct("position", "quaternion").alias("_c"))
    return f.join(c, keys).join(specs.select("instance_id", "start_step", "end_step"), "instance_id").where(
        (F.col("step") >= F.col("start_step")) & (F.col("step") < F.col("end_step")) & ~F.col("_f").eqNullSafe(F.col("_c"))
    ).select("instance_id")


def shared_peers(contacts: DataFrame, objects: DataFrame, specs: DataFrame) -> DataFrame:
    """Dynamic bodies that touch the target inside the window in both branches."""
    inside = contacts.where("normal_force > 0").join(
        specs.select("instance_id", "target_id", F.col("start_step").alias("_from"), F.col("end_step").alias("_to")), "instance_id"
    ).where((F.col("step") >= F.col("_from")) & (F.col("step") < F.col("_to")))
    peer = F.when(F.col("object_a") == F.col("target_id"), F.col("object_b")).when(
        F.col("object_b") == F.col("target_id"), F.col("object_a"))
    touching = inside.select("instance_id", "branch", peer.alias("object_id")).where("object_id is not null")
    movable = objects.where("not static").select("instance_id", "object_id")
    peers = touching.distinct().join(movable, ["instance_id", "object_id"], "left_semi")
    side = lambda b: peers.where(F.col("branch") == b).select("instance_id", "object_id")
    return side("factual").intersect(side("counterfactual"))


def triplet_quality(specs: DataFrame, states: DataFrame, contacts: DataFrame, step_rate: float,
                    environment: Sequence[str] = ("floor",), linear_ceiling: float = 60.0, angular_ceiling: float = 120.0,
                    minimum_effect: float = 0.0, require_contact: bool = True, tolerance: float = 1e-6,
                    minimum_revolutions: float = 0.35, minimum_travel: float = 0.10) -> DataFrame:
    """Reasons for factual / counterfactual / subject_removed triplets.

    ``specs``: instance_id, subject_id, lower, upper.
    """
    fine = reduce(lambda a, b: a & b, [V.all_finite(F.col(n), 4 if n == "quaternion" else 3) for n in S.POSE])
    outside = reduce(lambda a, b: a | b, [
        (F.col("position")[i] < F.col("lower")[i] - tolerance) | (F.col("position")[i] > F.col("upper")[i] + tolerance)
        for i in range(3)
    ])
    per_branch = states.join(specs.select("instance_id", "lower", "upper"), "instance_id").groupBy("instance_id", "branch").agg(
        F.max(V.norm(F.col("linear_velocity"))).alias("linear"), F.max(V.norm(F.col("angular_velocity"))).alias("angular"),
        F.some(outside).alias("outside"), F.every(fine).alias("finite"),
    )
    # A branch with a non-finite state reports only that.
    ok = F.col("finite")
    coded = F.array_compact(F.array(
        F.when(~ok, F.concat(F.lit("nonfinite_state:"), "branch")),
        F.when(ok & (F.col("linear") > linear_ceiling), F.concat(F.lit("linear_velocity_ceiling:"), "branch")),
        F.when(ok & (F.col("angular") > angular_ceiling), F.concat(F.lit("angular_velocity_ceiling:"), "branch")),
        F.when(ok & F.col("outside"), F.concat(F.lit("out_of_bounds:"), "branch")),
    ))
    branch_codes = per_branch.groupBy("instance_id").agg(F.flatten(F.collect_list(coded)).alias("_branch_codes"))
    factual = S.branch_states(states, "factual")
    touched = K.without_environment(contacts.where("branch = 'factual'"), environment).join(
        specs.select("instance_id", "subject_id"), "instance_id"
    ).where("object_a = subject_id or object_b = subject_id").groupBy("instance_id").agg(F.count("*").alias("subject_contacts"))
    moves = S.motion_modes(factual, step_rate, minimum_revolutions, minimum_travel, keys=("instance_id", "object_id")).where(
        ~F.col("object_id").isin(*environment)
    ).groupBy("instance_id").agg(
        F.some(F.col("mode").isin("rolling", "both")).alias("_rolls"), F.some(F.col("mode").isin("sliding", "both")).alias("_slides"),
    )
    gap = lambda branch, name: S.max_displacement(factual, S.branch_states(states, branch), specs, environment).withColumnRenamed(
        "max_displacement", name)
    joined = specs.select("instance_id")
    for frame in (branch_codes, touched, moves, gap("counterfactual", "counterfactual_displacement"), gap("subject_removed", "removal_displacement")):
        joined = joined.join(frame, "instance_id", "left")
    own = _codes({
        "no_factual_interaction": F.lit(require_contact) & F.col("subject_contacts").isNull(),
        "null_effect": (F.lit(minimum_effect) > 0.0) & (F.col("counterfactual_displacement") < minimum_effect),
        "no_rolling_motion": ~F.coalesce("_rolls", F.lit(False)),
        "no_sliding_motion": ~F.coalesce("_slides", F.lit(False)),
    })
    empty = F.array().cast("array<string>")
    return joined.select(
        "instance_id", F.array_sort(F.array_distinct(F.concat(own, F.coalesce("_branch_codes", empty)))).alias("reasons"),
        F.coalesce("subject_contacts", F.lit(0)).alias("subject_contacts"), "counterfactual_displacement", "removal_displacement",
    ).withColumn("accepted", F.size("reasons") == 0)
