"""Contact points to per-step and per-episode contact facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.functions import vectors as V
from scenelake.operators import ordered

SCOPE = ("instance_id", "branch")
PAIR = ("object_a", "object_b")


def canonicalise(contacts: DataFrame) -> DataFrame:
    """Orders the endpoints of each contact and turns the normal when they swap."""
    swap = F.col("object_b") < F.col("object_a")
    columns = {
        "object_a": F.least("object_a", "object_b"),
        "object_b": F.greatest("object_a", "object_b"),
    }
    if "normal" in contacts.columns:
        normal = F.col("normal")
        sign = F.when(swap, F.lit(-1.0)).otherwise(F.lit(1.0))
        columns["normal"] = F.array(*[V.fold_negative_zero(normal[i] * sign) for i in range(3)])
    if "position" in contacts.columns:
        columns["position"] = F.array(*[V.fold_negative_zero(F.col("position")[i]) for i in range(3)])
    return contacts.withColumns(columns)


def resolve_raw(raw: DataFrame, bodies: DataFrame, epsilon: float = 0.0) -> DataFrame:
    """Names the bodies of raw solver contacts; drops unknown, self and too weak ones.

    ``bodies`` maps (instance_id, body) to object_id. Its size follows the number of
    instances, so the join strategy is left to the optimiser.
    """
    first = bodies.select("instance_id", F.col("body").alias("body_a"), F.col("object_id").alias("object_a"))
    second = bodies.select("instance_id", F.col("body").alias("body_b"), F.col("object_id").alias("object_b"))
    named = (
        raw.where(F.col("normal_force") > epsilon)
        .join(first, ["instance_id", "body_a"])
        .join(second, ["instance_id", "body_b"])
        .where(F.col("object_a") != F.col("object_b"))
    )
    return canonicalise(named.drop("body_a", "body_b"))


def collision_events(raw: DataFrame, steps_per_frame: int, minimum_force: float = 1e-6) -> DataFrame:
    """Solver contacts as collision events; endpoints in (b, a) order, fractional frame."""
    return raw.where(F.col("normal_force") > minimum_force).select(
        "instance_id",
        F.col("body_b").alias("first_body"),
        F.col("body_a").alias("second_body"),
        (F.col("step") / steps_per_frame).alias("frame"),
        F.col("normal_force").alias("force"),
        *[c for c in ("position", "normal") if c in raw.columns],
    )


def index_collisions(events: DataFrame, instances: DataFrame) -> DataFrame:
    """Replaces collision bodies by instance indices, -1 for bodies outside the list."""
    result = events
    for side in ("first", "second"):
        lookup = instances.select(
            "instance_id", F.col("body").alias(f"{side}_body"), F.col("instance_index").alias(f"{side}_instance")
        )
        result = result.join(lookup, ["instance_id", f"{side}_body"], "left").withColumn(
            f"{side}_instance", F.coalesce(f"{side}_instance", F.lit(-1))
        )
    return result


def without_environment(contacts: DataFrame, environment: Sequence[str],
                        endpoint: Column | str | None = None) -> DataFrame:
    """Contacts touching none of ``environment`` and, if given, touching ``endpoint``."""
    kept = contacts.where(~F.col("object_a").isin(*environment) & ~F.col("object_b").isin(*environment))
    if endpoint is not None:
        value = endpoint if isinstance(endpoint, Column) else F.lit(endpoint)
        kept = kept.where((F.col("object_a") == value) | (F.col("object_b") == value))
    return kept


def contact_steps(contacts: DataFrame, step_rate: float,
                  keys: Sequence[str] = SCOPE) -> DataFrame:
    """Force-weighted aggregate of all contact points of a pair at a step."""
    force = F.col("normal_force")
    group = [*keys, "step", *PAIR]
    measures = [F.sum(force).alias("normal_force"), F.count("*").alias("_n")]
    geometry = [c for c in ("position", "normal") if c in contacts.columns]
    for name in geometry:
        for axis in range(3):
            lane = F.col(name)[axis]
            measures += [F.sum(force * lane).alias(f"_w_{name}_{axis}"), F.sum(lane).alias(f"_s_{name}_{axis}")]
    grouped = contacts.groupBy(*group).agg(*measures)
    whole = F.when(V.is_finite(force), force).otherwise(
        F.raise_error(F.lit("aggregated normal force must be finite"))
    )
    result = grouped.withColumn("normal_force", whole).withColumn("impulse", force / F.lit(float(step_rate)))
    for name in geometry:
        mean = F.array(*[
            F.when(force == 0.0, F.col(f"_s_{name}_{i}") / F.col("_n")).otherwise(F.col(f"_w_{name}_{i}") / force)
            for i in range(3)
        ])
        result = result.withColumn(name, mean)
    if "normal" in geometry:
        result = result.withColumn("normal", V.normalise(F.col("normal")))
    return result.select(*group, *geometry, "normal_force", "impulse")


def contact_nodes(contacts: DataFrame, keys: Sequence[str] = SCOPE) -> DataFrame:
    """Every endpoint of the unfiltered contacts."""
    pairs = contacts.select(*keys, *PAIR).distinct()
    return pairs.select(*keys, F.explode(F.array(*PAIR)).alias("node")).distinct()


def episodes(steps: DataFrame, force_threshold: float = 0.0, minimum_impulse: float = 0.0,
             keys: Sequence[str] = SCOPE, block: ordered.Block = ordered.BLOCK) -> DataFrame:
    """Maximal runs of consecutive contact steps of a pair; ``end_step`` is exclusive."""
    strong = steps.where(F.col("normal_force") >= force_threshold)
    merged = ordered.runs(
        strong, [*keys, *PAIR], "step",
        {"total_impulse": (F.sum("impulse"), "sum"), "peak_force": (F.max("normal_force"), "max")},
        block=block,
    )
    return merged.where(F.col("total_impulse") >= minimum_impulse)


def episode_members(steps: DataFrame, force_threshold: float = 0.0,
                    keys: Sequence[str] = SCOPE, block: ordered.Block = ordered.BLOCK) -> DataFrame:
    """The contact steps of each episode in long form, labelled with the episode start."""
    strong = steps.where(F.col("normal_force") >= force_threshold)
    return ordered.with_run_start(strong, [*keys, *PAIR], "step", block=block)


def pair_counts(contacts: DataFrame, keys: Sequence[str] = SCOPE) -> DataFrame:
    """Number of contact records of each pair, keyed by the two ids joined by a pipe."""
    pair = F.concat_ws("|", F.least(*PAIR), F.greatest(*PAIR))
    return contacts.groupBy(*keys, pair.alias("pair")).agg(F.count("*").alias("contact_count"))


def pair_steps(contacts: DataFrame, keys: Sequence[str] = SCOPE) -> DataFrame:
    """Distinct contact steps, one row each."""
    return contacts.select(*keys, "step").distinct()


def deepest_penetrations(raw: DataFrame, targets: DataFrame) -> DataFrame:
    """Deepest capped penetration of the target per step and peer body.

    ``targets`` holds instance_id, target_body and target_scale.
    """
    joined = raw.join(targets, "instance_id")
    peer = (
        F.when(F.col("body_a") == F.col("target_body"), F.col("body_b"))
        .when(F.col("body_b") == F.col("target_body"), F.col("body_a"))
    )
    depth = F.least(F.greatest(F.lit(0.0), -F.col("contact_distance")), F.col("target_scale"))
    return (
        joined.withColumn("peer_body", peer).withColumn("depth", depth)
        .where(F.col("peer_body").isNotNull() & (F.col("peer_body") != F.col("target_body")))
        .where(V.is_finite(F.col("contact_distance")) & (F.col("depth") > 0.0))
        .groupBy("instance_id", "step", "peer_body").agg(F.max("depth").alias("depth"))
    )


def canonical_order() -> list[Column]:
    """Sort key of the contact log; a missing distance sorts last."""
    return [
        F.col("step"), F.col("object_a"), F.col("object_b"),
        *[F.col("position")[i] for i in range(3)],
        *[F.col("normal")[i] for i in range(3)],
        F.col("normal_force"), F.col("contact_distance").asc_nulls_last(),
    ]


def in_canonical_order(contacts: DataFrame, keys: Sequence[str] = SCOPE) -> DataFrame:
    return contacts.orderBy(*keys, *canonical_order())
