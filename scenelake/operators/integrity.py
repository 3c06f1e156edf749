"""Row rules, referential checks and evidence checks; each returns the offending rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.functions import shapes
from scenelake.functions import vectors as V
from scenelake.session import spread

# The five intervention recipes.
RECIPES = ("break_contact", "create_collision", "maintain_contact", "remove_collision", "retime")


def with_violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Adds ``violations``: the names of rules that do not hold; a null result is a failure."""
    failed = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]
    return df.withColumn("violations", F.array_compact(F.array(*failed)))


def object_rules() -> dict[str, Column]:
    size, mass = F.col("size"), F.col("mass")
    q = F.col("quaternion")
    return {
        "object_id_blank": F.length(F.trim("object_id")) > 0,
        "shape_unknown": F.lower("shape").isin(*shapes.SHAPES),
        "size_not_positive": V.all_finite(size) & (F.least(size[0], size[1], size[2]) > 0.0),
        "radii_unequal": ~F.lower("shape").isin("sphere", "cylinder", "capsule") | (size[0] == size[1]),
        "sphere_not_round": (F.lower("shape") != "sphere") | (size[1] == size[2]),
        "mass_invalid": V.is_finite(mass) & (mass >= 0.0) & ((mass > 0.0) | F.col("static")),
        "friction_negative": V.is_finite(F.col("friction")) & (F.col("friction") >= 0.0),
        "restitution_range": F.col("restitution").between(0.0, 1.0),
        "quaternion_zero": V.all_finite(q, 4) & (F.greatest(*[F.abs(q[i]) for i in range(4)]) > 0.0),
        "position_not_finite": V.all_finite(F.col("position")),
    }


def asset_rules() -> dict[str, Column]:
    """Ranges of a rendered asset; its friction is bounded above, unlike a simulated object's."""
    low, high = F.col("bounds")[0], F.col("bounds")[1]
    return {
        "mass_negative": F.col("mass") >= 0.0,
        "friction_range": F.col("friction").between(0.0, 1.0),
        "restitution_range": F.col("restitution").between(0.0, 1.0),
        "bounds_reversed": (low[0] <= high[0]) & (low[1] <= high[1]) & (low[2] <= high[2]),
    }


def scene_rules() -> dict[str, Column]:
    low, high = F.col("lower"), F.col("upper")
    rates = (F.col("frame_rate") > 0) & (F.col("step_rate") > 0)
    return {
        "seed_negative": F.col("seed") >= 0,
        "bounds_empty": (low[0] < high[0]) & (low[1] < high[1]) & (low[2] < high[2]),
        "frame_range": (F.col("frame_start") >= 0) & (F.col("frame_end") > F.col("frame_start")),
        "rate_not_positive": rates,
        "rate_not_divisible": F.when(rates, F.pmod("step_rate", "frame_rate") == 0),
    }


def intervention_rules() -> dict[str, Column]:
    start, end = F.col("window_start"), F.col("window_end")
    return {
        "target_blank": F.length(F.trim("target_id")) > 0,
        "recipe_unknown": F.col("recipe").isin(*RECIPES),
        "magnitude_negative": V.is_finite(F.col("magnitude")) & (F.col("magnitude") >= 0.0),
        "window_invalid": (start >= 0) & (end > start),
        "push_mass_not_positive": F.col("push_mass") > 0.0,
    }


def contact_rules() -> dict[str, Column]:
    return {
        "step_negative": F.col("step") >= 0,
        "endpoint_blank": (F.length(F.trim("object_a")) > 0) & (F.length(F.trim("object_b")) > 0),
        "endpoints_equal": F.col("object_a") != F.col("object_b"),
        "endpoints_unordered": F.col("object_a") < F.col("object_b"),
        "geometry_not_finite": V.all_finite(F.col("position")) & V.all_finite(F.col("normal")),
        "force_negative": V.is_finite(F.col("normal_force")) & (F.col("normal_force") >= 0.0),
    }


def spec_rules() -> dict[str, Column]:
    """Rules of an instance spec joined with its scene and the length of its path."""
    steps = F.floor((F.col("frame_end") - F.col("frame_start")) * F.col("step_rate") / F.col("frame_rate"))
    return {
        "effect_unknown": F.col("expected_effect").isin("null", "non_null"),
        "null_with_magnitude": (F.col("expected_effect") != "null") | (F.col("magnitude") == 0.0),
        "target_mismatch": F.col("target_id") == F.col("intervention_target"),
        "start_mismatch": F.col("start_step") == F.col("window_start"),
        "window_outside_path": (F.col("window_start") >= 0) & (F.col("window_start") < F.col("window_end"))
        & (F.col("window_end") <= F.col("path_length")),
        "path_length": F.col("path_length") == steps,
    }


def outside_bounds(objects: DataFrame, scenes: DataFrame) -> DataFrame:
    """Objects that start outside their scene's bounds."""
    inside = reduce(lambda a, b: a & b, [
        F.col("position")[i].between(F.col("lower")[i], F.col("upper")[i]) for i in range(3)
    ])
    return objects.join(scenes.select("instance_id", "lower", "upper"), "instance_id").where(~inside).select("instance_id", "object_id")


def dangling_contacts(contacts: DataFrame, objects: DataFrame, steps: DataFrame) -> DataFrame:
    """Contacts naming an object or a step that does not exist."""
    known = objects.select("instance_id", "object_id")
    missing = [
        contacts.join(known.withColumnRenamed("object_id", side), ["instance_id", side], "left_anti")
        .select("instance_id", "step", "object_a", "object_b", F.lit(side).alias("missing"))
        for side in ("object_a", "object_b")
    ]
    late = contacts.join(steps.select("instance_id", "step"), ["instance_id", "step"], "left_anti").select(
        "instance_id", "step", "object_a", "object_b", F.lit("step").alias("missing")
    )
    return missing[0].unionByName(missing[1]).unionByName(late)


def correspondence_gaps(visual: DataFrame, simulated: DataFrame) -> DataFrame:
    """Objects present in only one of the visual and simulated scenes."""
    keys = ["instance_id", "object_id"]
    left = visual.select(*keys).distinct().withColumn("_v", F.lit(1))
    right = simulated.select(*keys).distinct().withColumn("_s", F.lit(1))
    return left.join(right, keys, "full").where(F.col("_v").isNull() | F.col("_s").isNull()).select(
        *keys, F.when(F.col("_v").isNull(), "visual").otherwise("simulated").alias("missing_in")
    )


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows whose multiplicity differs; ``balance`` is positive for surplus on the left.

    One aggregation answers both directions of EXCEPT ALL.
    """
    columns = left.columns
    both = left.withColumn("_sign", F.lit(1)).unionByName(right.select(*columns).withColumn("_sign", F.lit(-1)))
    return both.groupBy(*columns).agg(F.sum("_sign").alias("balance")).where("balance <> 0")


def differing_groups(left: DataFrame, right: DataFrame, key: str = "instance_id") -> DataFrame:
    """Keys whose rows are not the same multiset on both sides.

    Each row counts by two digests, with a sign per side: sums that do not depend on order and that equal multisets
    bring to zero. A task sends one row per key, so nothing of the rows is moved.
    """
    columns = sorted(left.columns)
    signed = lambda df, sign: df.select(key, F.lit(sign).alias("n"), *[
        (F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)") * sign).alias(f"h{seed}") for seed in (1, 2)])
    sums = signed(left, 1).unionByName(signed(right.select(*left.columns), -1)).groupBy(key).agg(*[F.sum(c).alias(c) for c in ("n", "h1", "h2")])
    return sums.where("n <> 0 OR h1 <> 0 OR h2 <> 0").select(key)


def provenance_mismatches(contacts: DataFrame, raw: DataFrame) -> DataFrame:
    """Difference between logged contacts and those rebuilt from the raw solver rows."""
    from scenelake.operators.contacts import canonicalise
    rebuilt = canonicalise(raw.where("normal_force > 0 and object_a <> object_b"))
    return multiset_difference(contacts, rebuilt)


def manifest_mismatches(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Full comparison of a manifest with the files found: missing, extra, hash or size."""
    listed = manifest.select("path", F.col("sha256").alias("_want_sha"), F.col("size").alias("_want_size"))
    found = files.select("path", F.col("sha256").alias("_got_sha"), F.col("size").alias("_got_size"))
    problem = (
        F.when(F.col("_got_sha").isNull(), "missing").when(F.col("_want_sha").isNull(), "extra")
        .when(F.col("_want_size") != F.col("_got_size"), "size").when(F.col("_want_sha") != F.col("_got_sha"), "hash")
    )
    return listed.join(found, "path", "full").select("path", problem.alias("problem")).where("problem is not null")


# The exact key set of a journal record for each status.
JOURNAL_KEYS = {
    "accepted": ("attempt_index", "instance_id", "instance_seed", "qc", "status", "candidate",
                 "artifact_manifest_sha256", "artifact_manifest_size"),
    "rejected": ("attempt_index", "instance_id", "instance_seed", "qc", "status", "spec"),
    "error": ("attempt_index", "error_type", "message", "traceback", "status"),
}


def journal_violations(records: DataFrame, published: DataFrame | None = None) -> DataFrame:
    """Faults of journal records; ``records`` is a nullable superset of all key sets.

    ``published`` lists instance ids with an artifact, which only accepted attempts may have.
    """
    every = [c for c in records.columns if any(c in keys for keys in JOURNAL_KEYS.values())]
    exact = None
    for status, keys in JOURNAL_KEYS.items():
        fits = reduce(lambda a, b: a & b, [
            F.col(c).isNotNull() if c in keys else F.col(c).isNull() for c in every
        ])
        exact = F.when(F.col("status") == status, fits) if exact is None else exact.when(F.col("status") == status, fits)
    rules = {
        "status": F.col("status").isin(*JOURNAL_KEYS),
        "keys": exact.otherwise(F.lit(True)),
        "error_type": (F.col("status") != "error") | (F.length(F.trim("error_type")) > 0),
    }
    if "artifact_manifest_sha256" in records.columns:
        rules["digest"] = (F.col("status") != "accepted") | (
            F.col("artifact_manifest_sha256").rlike("^[0-9a-f]{64}$") & (F.col("artifact_manifest_size") >= 0))
    if "file_name" in records.columns:
        rules["file_name"] = F.col("file_name") == F.concat(F.format_string("%08d", F.col("attempt_index").cast("bigint")), F.lit(".json"))
    if published is not None:
        seen = published.select("instance_id").distinct().withColumn("_seen", F.lit(True))
        # A left join would send all rows without an id to one task.
        named = spread(records.where("instance_id IS NOT NULL"), "instance_id").join(seen, "instance_id", "left")
        records = named.unionByName(records.where("instance_id IS NULL").withColumn("_seen", F.lit(None).cast("boolean")))
        rules["artifact_conflict"] = (F.col("status") == "accepted") | F.col("_seen").isNull()
    judged = with_violations(records, rules)
    return judged.where(F.size("violations") > 0).drop("_seen")


def evidence_mismatches(journal: DataFrame, recomputed: DataFrame, columns: Sequence[str],
                        key: str = "instance_id") -> DataFrame:
    """Accepted journal rows whose stored evidence differs from the recomputed one."""
    again = recomputed.select(key, *[F.col(c).alias(f"_r_{c}") for c in columns], F.lit(True).alias("_known"))
    differs = F.array_compact(F.array(*[
        F.when(~F.col(c).eqNullSafe(F.col(f"_r_{c}")), F.lit(c)) for c in columns
    ]))
    return (
        journal.where("status = 'accepted'").join(again, key, "left")
        .select(key, F.col("_known").isNull().alias("unknown"), differs.alias("differing"))
        .where(F.col("unknown") | (F.size("differing") > 0))
    )


def uncovered_penetrations(contacts: DataFrame, evidence: DataFrame, targets: DataFrame) -> DataFrame:
    """Penetrating target contacts without matching evidence of at least that depth.

    ``evidence``: instance_id, step, object_id, depth; ``targets``: instance_id, target_id, radius.
    """
    joined = contacts.join(targets, "instance_id")
    peer = F.when(F.col("object_a") == F.col("target_id"), F.col("object_b")).when(
        F.col("object_b") == F.col("target_id"), F.col("object_a"))
    depth = F.greatest(F.lit(0.0), -F.col("contact_distance"))
    needed = joined.select("instance_id", "step", peer.alias("object_id"), F.least(F.col("radius"), depth).alias("needed")).where(
        "object_id is not null and needed > 0"
    )
    proof = evidence.select("instance_id", "step", "object_id", "depth")
    return needed.join(proof, ["instance_id", "step", "object_id"], "left").where(
        F.coalesce("depth", F.lit(-1.0)) + 1e-12 < F.col("needed")
    ).select("instance_id", "step", "object_id", "needed", "depth")


def missing_numbers(names: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``names`` that ``known`` lacks."""
    return names.join(known.select(*keys).distinct(), list(keys), "left_anti")
