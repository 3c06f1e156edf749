"""Causal ground truth of factual and counterfactual branches, for all instances at once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.operators import contacts as K
from scenelake.operators import graph as G
from scenelake.operators import states as S
from scenelake.session import cut_lineage


@dataclass(frozen=True)
class GroundTruth:
    """``delta`` (edge buckets), ``affected`` (instance_id, object_id, kind) and ``paths``.

    ``paths`` is None where they were not asked for.
    """

    delta: DataFrame
    affected: DataFrame
    paths: DataFrame | None


def _graphs(contacts: DataFrame, step_rate: float, force_threshold: float, minimum_impulse: float):
    steps = K.contact_steps(K.canonicalise(contacts), step_rate)
    # Both branches feed the delta, the union and every sweep: aggregate the contacts once.
    edges = cut_lineage(K.episodes(steps, force_threshold, minimum_impulse))
    return G.branch_edges(edges, "factual"), G.branch_edges(edges, "counterfactual")


def _kinds(hard: DataFrame, soft: DataFrame) -> DataFrame:
    return hard.select("instance_id", "object_id", F.lit("hard").alias("kind")).unionByName(
        soft.select("instance_id", "object_id", F.lit("soft").alias("kind"))
    )


def kinematic(contacts: DataFrame, states: DataFrame, targets: DataFrame, step_rate: float,
              excluded: Sequence[str] = (), force_threshold: float = 0.0, minimum_impulse: float = 0.0,
              force_tolerance: float = 1e-6, position_epsilon: float = 1e-3, velocity_epsilon: float = 1e-3,
              quaternion_epsilon: float = 1e-3, with_paths: bool = True) -> GroundTruth:
    """Hard: reachable through a changed edge. Soft: diverged, not hard, not the target.

    Instances whose physics are identical in both branches have no delta and no
    divergence, hence no rows.
    """
    # One row per instance, met by every sweep: not drawn from the logs anew each time.
    targets = cut_lineage(targets)
    factual, counterfactual = _graphs(contacts, step_rate, force_threshold, minimum_impulse)
    delta = cut_lineage(G.edge_delta(factual, counterfactual, force_tolerance))
    union = G.union_edges(factual.select(*G.IDENTITY), counterfactual.select(*G.IDENTITY))
    arcs = G.causal_arcs(union, delta, targets, excluded)
    hard = cut_lineage(G.hard_affected(union, delta, targets, excluded, arcs))
    moved = S.diverged(
        S.branch_states(states, "factual"), S.branch_states(states, "counterfactual"), targets,
        position_epsilon, velocity_epsilon, quaternion_epsilon,
    ).select("instance_id", "object_id")
    soft = moved.join(hard, ["instance_id", "object_id"], "left_anti")
    paths = G.witness_paths(union, delta, targets, hard, excluded, arcs) if with_paths else None
    return GroundTruth(delta, _kinds(hard, soft), paths)


def velocity(contacts: DataFrame, states: DataFrame, subjects: DataFrame, step_rate: float,
             environment: Sequence[str] = ("floor",), position_epsilon: float = 1e-3,
             velocity_epsilon: float = 1e-3, quaternion_epsilon: float = 1e-3) -> GroundTruth:
    """Intervention at step 0. Hard: reachable in either branch and diverged."""
    factual, counterfactual = _graphs(contacts, step_rate, 0.0, 0.0)
    delta = G.edge_delta(factual, counterfactual)
    paths = None
    for edges in (factual, counterfactual):
        reached = G.forward_reachable(edges, subjects, environment)
        found = G.forward_paths(edges, subjects, reached, environment)
        paths = found if paths is None else paths.unionByName(found)
    # The fewest hops over both branches, then the smallest path.
    shortest = paths.groupBy("instance_id", "object_id").agg(
        F.min(F.struct(F.size("path").alias("n"), "path"))["path"].alias("path")
    )
    moved = S.diverged_shared(
        S.branch_states(states, "factual"), S.branch_states(states, "counterfactual"),
        position_epsilon, velocity_epsilon, quaternion_epsilon,
    )
    return _intersected(delta, shortest, moved, subjects)


def removal(contacts: DataFrame, states: DataFrame, subjects: DataFrame, step_rate: float,
            environment: Sequence[str] = ("floor",), position_epsilon: float = 1e-3,
            velocity_epsilon: float = 1e-3, quaternion_epsilon: float = 1e-3) -> GroundTruth:
    """Branch without the subject: the factual graph loses the subject before the delta."""
    factual, removed = _graphs(contacts, step_rate, 0.0, 0.0)
    named = factual.join(subjects.select("instance_id", "subject_id"), "instance_id")
    stripped = G.without_node(named, F.col("subject_id")).drop("subject_id")
    delta = G.edge_delta(stripped, removed)
    reached = G.forward_reachable(factual, subjects, environment)
    paths = G.forward_paths(factual, subjects, reached, environment)
    moved = S.diverged_shared(
        S.branch_states(states, "factual"), S.branch_states(states, "counterfactual"),
        position_epsilon, velocity_epsilon, quaternion_epsilon,
    )
    return _intersected(delta, paths, moved, subjects)


def _intersected(delta: DataFrame, paths: DataFrame, moved: DataFrame, subjects: DataFrame) -> GroundTruth:
    keys = ["instance_id", "object_id"]
    moved = moved.select(*keys)
    hard = paths.join(moved, keys, "left_semi")
    subject = subjects.select("instance_id", F.col("subject_id").alias("object_id"))
    soft = moved.join(hard, keys, "left_anti").join(subject, keys, "left_anti")
    return GroundTruth(delta, _kinds(hard, soft), hard)


def _bucket_counts(delta: DataFrame) -> DataFrame:
    has = lambda b: F.count_if(F.col("bucket") == b)
    return delta.groupBy("instance_id").agg(
        has("added").alias("added"), has("removed").alias("removed"), has("changed").alias("changed")
    )


def summary(truth: GroundTruth, targets: DataFrame, environment: Sequence[str] = ()) -> DataFrame:
    """Per instance: bucket and affected counts, path facts and endpoint facts."""
    kind = lambda k: F.count_if(F.col("kind") == k)
    hops = F.size("path") - 1
    home = lambda side: (F.col(side) == F.col("target_id")) | F.col(side).isin(*environment)
    ends = truth.delta.join(targets.select("instance_id", "target_id"), "instance_id").groupBy("instance_id").agg(
        F.every(home("object_a") & home("object_b")).alias("only_home"),
        F.some((F.col("bucket") == "added") & ((F.col("object_a") == F.col("target_id")) | (F.col("object_b") == F.col("target_id")))).alias("target_added"),
        F.some((F.col("bucket") == "removed") & ((F.col("object_a") == F.col("target_id")) | (F.col("object_b") == F.col("target_id")))).alias("target_removed"),
    )
    joined = (
        targets.select("instance_id")
        .join(_bucket_counts(truth.delta), "instance_id", "left")
        .join(truth.affected.groupBy("instance_id").agg(kind("hard").alias("hard"), kind("soft").alias("soft")), "instance_id", "left")
        .join(truth.paths.groupBy("instance_id").agg(
            F.max(hops).alias("max_hops"), F.some(hops == 1).alias("has_direct"), F.some(hops >= 2).alias("has_cascade")
        ), "instance_id", "left")
        .join(ends, "instance_id", "left")
    )
    return joined.fillna(0, ["added", "removed", "changed", "hard", "soft", "max_hops"]).fillna(
        False, ["has_direct", "has_cascade", "target_added", "target_removed"]
    ).fillna(True, ["only_home"])


def primary_category() -> Column:
    """Category over the columns of :func:`summary`."""
    added, removed, changed = (F.col(c) > 0 for c in ("added", "removed", "changed"))
    present = added.cast("int") + removed.cast("int") + changed.cast("int")
    return (
        F.when(present > 1, "mixed_contact_delta").when(added, "contact_added").when(removed, "contact_removed")
        .when(changed, "contact_changed").when(F.col("hard") + F.col("soft") > 0, "state_only").otherwise("null_effect")
    )


def hop_bucket() -> Column:
    depth = F.greatest(F.lit(0), F.col("max_hops"))
    return F.when(depth >= 3, "3+").otherwise(depth.cast("string"))


def tags(unstable: Column | None = None, mismatch: Column | None = None) -> Column:
    """Sorted tag list over the columns of :func:`summary`."""
    records = F.col("added") + F.col("removed") + F.col("changed") > 0
    unaffected = F.col("hard") + F.col("soft") == 0
    flags = {
        "cascade": F.col("has_cascade"),
        "contact_added": F.col("added") > 0,
        "contact_changed": F.col("changed") > 0,
        "contact_removed": F.col("removed") > 0,
        "direct_contact": F.col("has_direct"),
        "environment_only": records & F.col("only_home"),
        "null_effect": ~records & unaffected,
        "preintervention_mismatch": mismatch if mismatch is not None else F.lit(False),
        "target_only": unaffected & F.col("only_home"),
        "unstable": unstable if unstable is not None else F.lit(False),
    }
    return F.array_compact(F.array(*[F.when(flag, name) for name, flag in flags.items()]))


def longest_paths(paths: DataFrame) -> DataFrame:
    """The longest path of each instance; ties go to the smallest object id."""
    order = F.struct((-F.size("path")).alias("n"), "object_id")
    return paths.groupBy("instance_id").agg(F.min_by(F.struct("object_id", "path"), order).alias("_p")).select(
        "instance_id", "_p.object_id", "_p.path"
    )


def first_matching_edge(delta: DataFrame, steps: DataFrame, buckets: Sequence[str], target: str, peer: str) -> DataFrame:
    """Earliest delta edge between target and peer that starts at a logged contact step."""
    ends = F.array(F.col("object_a"), F.col("object_b"))
    fitting = delta.where(F.col("bucket").isin(*buckets) & F.array_contains(ends, target) & F.array_contains(ends, peer))
    return fitting.join(
        steps.select("instance_id", F.col("step").alias("start_step")).distinct(), ["instance_id", "start_step"], "left_semi"
    ).groupBy("instance_id").agg(F.min("start_step").alias("start_step"))
