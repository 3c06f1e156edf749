"""Row rules, referential checks and journal evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenelake.operators import contacts as K
from scenelake.operators import integrity as I
from scenelake.operators import pixels as P
from scenelake.functions import vectors as V
from scenelake.queries import fixtures as X
from scenelake.sources import journal as J

r, sr = X.rounded, X.sql_rounded


def _joined(df, *keys):
    return df.where(F.size("violations") > 0).select(*keys, F.array_join(F.array_sort("violations"), ",").alias("violations"))


def object_violations(spark, sf):
    b = X.bodies(spark, sf)
    objects = b.select(
        "instance_id", F.when(F.col("k") % 11 == 0, " ").otherwise(F.col("object_id")).alias("object_id"), F.when(F.col("k") % 13 == 0, "cone").otherwise(F.col("shape")).alias("shape"),
        F.when(F.col("k") % 17 == 0, F.array(F.lit(-1.0), F.lit(0.5), F.lit(0.7))).otherwise(F.col("size")).alias("size"),
        F.when(F.col("k") % 7 == 0, 0.0).otherwise(1.5).alias("mass"), (F.col("k") % 5 - 1).cast("double").alias("friction"), (F.col("k") % 6 / 4.0).alias("restitution"),
        F.when(F.col("k") % 19 == 0, V.vector(0.0, 0.0, 0.0, 0.0)).otherwise(F.col("quaternion")).alias("quaternion"),
        F.when(F.col("k") % 23 == 0, F.array(F.lit(float("nan")), F.lit(0.0), F.lit(0.0))).otherwise(F.col("position")).alias("position"), F.col("is_static").alias("static"), "k")
    return _joined(I.with_violations(objects, I.object_rules()), "instance_id", "k")


def contact_violations(spark, sf):
    return _joined(I.with_violations(X.contact_points(spark, sf).where("branch = 'factual'"), {**I.contact_rules(), "weak": F.col("normal_force") >= 3.0}),
                   "instance_id", "step", "object_a", "object_b")


def asset_violations(spark, sf):
    parts = X.given(spark, sf, "part").select("p_partkey", (F.col("p_retailprice") - 905).alias("mass"), (F.col("p_size") / 40.0).alias("friction"),
                                              (F.col("p_size") / 45.0).alias("restitution"), F.array(V.vector(0.0, 0.0, 0.0), F.array((F.col("p_size") - 3).cast("double"), F.lit(1.0), F.lit(1.0))).alias("bounds"))
    return _joined(I.with_violations(parts, I.asset_rules()), "p_partkey")


def _specs(spark, sf):
    o, k = F.col("o_orderkey"), F.col("o_custkey")
    return X.given(spark, sf, "orders").select(
        o.alias("attempt_index"), (o % 7 - 1).alias("seed"), V.vector(0.0, 0.0, 0.0).alias("lower"), F.array((k % 5).cast("double"), F.lit(2.0), F.lit(2.0)).alias("upper"),
        F.lit(0).alias("frame_start"), (k % 9).cast("int").alias("frame_end"), F.lit(24).alias("frame_rate"), (F.lit(240) + o % 2).cast("int").alias("step_rate"),
        F.when(o % 10 == 0, " ").otherwise("target").alias("target_id"), F.lit("target").alias("intervention_target"),
        F.array(*[F.lit(x) for x in (*I.RECIPES, "teleport")])[(o % 6).cast("int")].alias("recipe"), ((k % 4) - 1).cast("double").alias("magnitude"),
        (o % 8).cast("int").alias("window_start"), (k % 12).cast("int").alias("window_end"), (k % 3).cast("double").alias("push_mass"),
        F.when(k % 5 == 0, "null").otherwise("non_null").alias("expected_effect"), (o % 8 + F.when(o % 16 == 3, 1).otherwise(0)).cast("int").alias("start_step"),
        ((k % 9) * 10).alias("path_length"))


def spec_violations(spark, sf):
    rules = {**I.scene_rules(), **I.intervention_rules(), **I.spec_rules()}
    return _joined(I.with_violations(_specs(spark, sf), rules), "attempt_index")


def objects_outside_bounds(spark, sf):
    b = X.bodies(spark, sf)
    scenes = b.select("instance_id").distinct().select("instance_id", V.vector(0.5, 0.5, 0.0).alias("lower"), V.vector(10.0, 8.5, 3.5).alias("upper"))
    return I.outside_bounds(b, scenes)


def dangling_contacts(spark, sf):
    points = X.contact_points(spark, sf).where("branch = 'factual'")
    ids = X.table(spark, sf, "targets").select("instance_id")
    objects = ids.select("instance_id", F.explode(F.array(*[F.lit(f"object_{i}") for i in range(6)])).alias("object_id"))
    steps = ids.select("instance_id", F.explode(F.sequence(F.lit(0), F.lit(229))).alias("step"))
    return I.dangling_contacts(points, objects, steps).groupBy("instance_id", "missing").agg(F.count("*").alias("contacts"))


def correspondence_gaps(spark, sf):
    b = X.bodies(spark, sf)
    return I.correspondence_gaps(b.where("k % 31 <> 0"), b.where("k % 37 <> 0"))


def provenance_mismatches(spark, sf):
    """Logged contacts against those rebuilt from raw rows, of which some were dropped or doubled."""
    logged = K.canonicalise(X.contact_points(spark, sf).where("branch = 'factual'")).select("instance_id", "step", "object_a", "object_b", "normal_force")
    raw = X.contact_points(spark, sf).where("branch = 'factual'").select("instance_id", "step", "object_a", "object_b", "normal_force")
    doubled = raw.where("normal_force <> 13").unionByName(raw.where("normal_force = 17"))
    return I.provenance_mismatches(logged, doubled).groupBy("instance_id").agg(F.sum(F.abs("balance")).alias("rows"), F.sum("balance").alias("balance"))


def manifest_mismatches(spark, sf):
    d = X.given(spark, sf, "documents")
    files = d.where("doc_id % 41 <> 0").select(F.concat(F.lit("f/"), F.col("doc_id").cast("string")).alias("path"), F.sha2(F.when(F.col("doc_id") % 43 == 0, "x").otherwise(F.col("text")), 256).alias("sha256"),
                                               (F.col("n_chars") + F.when(F.col("doc_id") % 47 == 0, 1).otherwise(0)).alias("size"))
    listed = d.where("doc_id % 53 <> 0").select(F.concat(F.lit("f/"), F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("sha256"), F.col("n_chars").alias("size"))
    return I.manifest_mismatches(listed, files)


def _journal(spark, sf):
    o = F.col("o_orderkey")
    status = F.array(*[F.lit(s) for s in ("accepted", "rejected", "error", "paused")])[(o % 4).cast("int")]
    kept = lambda names, value: F.when(F.col("status").isin(*names) & (o % 29 != 0), value)
    return X.given(spark, sf, "orders").withColumn("status", status).select(
        o.alias("attempt_index"), "status", kept(("accepted", "rejected"), F.concat(F.lit("i"), o.cast("string"))).alias("instance_id"), F.when(F.col("status").isin("accepted", "rejected"), o).alias("instance_seed"),
        F.when(F.col("status").isin("accepted", "rejected"), "qc").alias("qc"), F.when(F.col("status") == "accepted", "c").alias("candidate"), F.when((F.col("status") == "rejected") | (o % 31 == 0), "s").alias("spec"),
        F.when(F.col("status") == "accepted", F.when(o % 37 == 0, "abc").otherwise(F.sha2(o.cast("string"), 256))).alias("artifact_manifest_sha256"), F.when(F.col("status") == "accepted", F.lit(5)).alias("artifact_manifest_size"),
        F.when(F.col("status") == "error", F.when(o % 10 == 2, " ").otherwise("ValueError")).alias("error_type"), F.when(F.col("status") == "error", "m").alias("message"), F.when(F.col("status") == "error", "t").alias("traceback"),
        F.format_string("%08d.json", o + F.when(o % 41 == 0, 1).otherwise(0)).alias("file_name"))


def journal_violations(spark, sf):
    published = _journal(spark, sf).where("instance_id is not null and (status = 'accepted' or attempt_index % 43 = 0)")
    return _joined(I.journal_violations(_journal(spark, sf), published), "attempt_index")


def misnamed_records(spark, sf):
    return J.misnamed(_journal(spark, sf)).select("attempt_index", "file_name")


def pending_attempts(spark, sf):
    every = _journal(spark, sf).where("instance_id is not null").select("instance_id")
    return J.pending(every, _journal(spark, sf).where("status = 'accepted' and instance_id is not null"))


def evidence_mismatches(spark, sf):
    journal = X.table(spark, sf, "attempts")
    again = journal.where("attempt_index % 59 <> 0").withColumn("category", F.when(F.col("attempt_index") % 61 == 0, "other").otherwise(F.col("category"))).withColumn(
        "hop_bucket", F.when(F.col("attempt_index") % 67 == 0, "9").otherwise(F.col("hop_bucket")))
    return I.evidence_mismatches(journal, again, ["category", "hop_bucket"]).select("instance_id", "unknown", F.array_join("differing", ",").alias("differing"))


def uncovered_penetrations(spark, sf):
    points = X.contact_points(spark, sf).where("branch = 'factual'")
    targets = X.table(spark, sf, "targets").select("instance_id", "target_id", F.lit(0.05).alias("radius"))
    raw = X.raw_contacts(spark, sf).where("step % 3 <> 0")
    scale = targets.select("instance_id", F.lit(0).alias("target_body"), F.lit(0.03).alias("target_scale"))
    proof = K.deepest_penetrations(raw, scale).withColumn("object_id", F.concat(F.lit("object_"), F.col("peer_body").cast("string")))
    return I.uncovered_penetrations(points, proof, targets).groupBy("instance_id").agg(F.count("*").alias("missing"), r(F.max("needed")).alias("deepest"))


def ranges_upsert(spark, sf):
    fresh = P.layer_ranges(X.frames(spark, sf).where("scene % 2 = 0"), "e").withColumn("layer", F.lit("flow"))
    old = P.layer_ranges(X.frames(spark, sf), "depth").withColumn("layer", F.lit("flow"))
    return P.merge_ranges(old, fresh).select("scene", "layer", r(F.col("low")).alias("low"), r(F.col("high")).alias("high"))


QUERIES = {f.__name__: f for f in (
    object_violations, contact_violations, asset_violations, spec_violations, objects_outside_bounds, dangling_contacts, correspondence_gaps, provenance_mismatches,
    manifest_mismatches, journal_violations, misnamed_records, pending_attempts, evidence_mismatches, uncovered_penetrations, ranges_upsert,
)}


def _listed(rules: dict[str, str], keys: str, source: str) -> str:
    """Names of broken rules, sorted; every rule is the condition of its violation."""
    arms = ", ".join(f"CASE WHEN {rules[n]} THEN '{n}' END" for n in sorted(rules))
    return f"SELECT * FROM (SELECT {keys}, list_aggregate(list_filter([{arms}], lambda v: v IS NOT NULL), 'string_agg', ',') AS violations FROM {source}) t WHERE violations IS NOT NULL"


_RADII = "CASE WHEN k % 17 = 0 THEN true ELSE false END"
JOURNAL = """j AS (SELECT o_orderkey AS k, ['accepted', 'rejected', 'error', 'paused'][CAST(o_orderkey % 4 AS INT) + 1] AS status FROM orders)"""

ORACLES = {
    "object_violations": X.oracle("boxes", _listed({
        "object_id_blank": "k % 11 = 0", "shape_unknown": "k % 13 = 0", "size_not_positive": "k % 17 = 0", "radii_unequal": "k % 17 = 0 AND k % 13 <> 0 AND shape <> 'cube'",
        "sphere_not_round": "k % 17 = 0 AND k % 13 <> 0 AND shape = 'sphere'", "mass_invalid": "k % 7 = 0 AND NOT is_static", "friction_negative": "k % 5 = 0", "restitution_range": "k % 6 = 5",
        "quaternion_zero": "k % 19 = 0", "position_not_finite": "k % 23 = 0"}, "instance_id, k", "boxes")),
    "contact_violations": X.oracle("contacts", _listed({"endpoints_unordered": "object_a >= object_b", "weak": "normal_force < 3"}, "instance_id, step, object_a, object_b", "(SELECT * FROM contacts WHERE branch = 'factual') c")),
    "asset_violations": _listed({"mass_negative": "p_retailprice < 905", "friction_range": "p_size / 40.0 > 1", "restitution_range": "p_size / 45.0 > 1", "bounds_reversed": "p_size < 3"}, "p_partkey", "part"),
    "spec_violations": _listed({
        "seed_negative": "o_orderkey % 7 = 0", "bounds_empty": "o_custkey % 5 = 0", "frame_range": "o_custkey % 9 = 0", "rate_not_divisible": "o_orderkey % 2 = 1", "target_blank": "o_orderkey % 10 = 0",
        "recipe_unknown": "o_orderkey % 6 = 5", "magnitude_negative": "o_custkey % 4 = 0", "window_invalid": "o_custkey % 12 <= o_orderkey % 8", "push_mass_not_positive": "o_custkey % 3 = 0",
        "null_with_magnitude": "o_custkey % 5 = 0 AND o_custkey % 4 <> 1", "target_mismatch": "o_orderkey % 10 = 0", "start_mismatch": "o_orderkey % 16 = 3",
        "window_outside_path": "o_custkey % 12 <= o_orderkey % 8 OR o_custkey % 12 > (o_custkey % 9) * 10", "path_length": "(o_custkey % 9) * 10 <> floor((o_custkey % 9) * (240 + o_orderkey % 2) / 24.0)"},
        "o_orderkey AS attempt_index", "orders"),
    "objects_outside_bounds": X.oracle("boxes", "SELECT instance_id, object_id FROM boxes WHERE x < 0.5 OR x > 10 OR y < 0.5 OR y > 8.5 OR z < 0 OR z > 3.5"),
    "dangling_contacts": X.oracle("contacts", """f AS (SELECT * FROM contacts WHERE branch = 'factual'), m AS (SELECT instance_id, 'object_a' AS missing FROM f WHERE object_a = 'object_6'
        UNION ALL SELECT instance_id, 'object_b' FROM f WHERE object_b = 'object_6' UNION ALL SELECT instance_id, 'step' FROM f WHERE step >= 230) SELECT instance_id, missing, count(*) AS contacts FROM m GROUP BY ALL"""),
    "correspondence_gaps": X.oracle("boxes", """SELECT instance_id, object_id, CASE WHEN k % 31 = 0 THEN 'visual' ELSE 'simulated' END AS missing_in FROM boxes WHERE (k % 31 = 0) <> (k % 37 = 0)"""),
    "provenance_mismatches": X.oracle("contacts", """SELECT instance_id, count(*) AS rows, CAST(sum(CASE WHEN normal_force = 13 THEN 1 ELSE -1 END) AS BIGINT) AS balance FROM contacts
        WHERE branch = 'factual' AND normal_force IN (13, 17) GROUP BY ALL"""),
    "manifest_mismatches": """SELECT 'f/' || doc_id AS path, CASE WHEN doc_id % 41 = 0 THEN 'missing' WHEN doc_id % 53 = 0 THEN 'extra' WHEN doc_id % 47 = 0 THEN 'size' ELSE 'hash' END AS problem FROM documents
        WHERE NOT (doc_id % 41 = 0 AND doc_id % 53 = 0) AND (doc_id % 41 = 0 OR doc_id % 53 = 0 OR doc_id % 47 = 0 OR doc_id % 43 = 0)""",
    "journal_violations": "WITH " + JOURNAL + " " + _listed({
        "status": "status = 'paused'", "keys": "status <> 'paused' AND ((status <> 'error' AND k % 29 = 0) OR (status <> 'rejected' AND k % 31 = 0))", "error_type": "status = 'error' AND k % 10 = 2",
        "digest": "status = 'accepted' AND k % 37 = 0", "file_name": "k % 41 = 0", "artifact_conflict": "status = 'rejected' AND k % 29 <> 0 AND k % 43 = 0"}, "k AS attempt_index", "j"),
    "misnamed_records": "SELECT o_orderkey AS attempt_index, printf('%08d.json', o_orderkey + 1) AS file_name FROM orders WHERE o_orderkey % 41 = 0",
    "pending_attempts": "SELECT 'i' || o_orderkey AS instance_id FROM orders WHERE o_orderkey % 4 = 1 AND o_orderkey % 29 <> 0",
    "evidence_mismatches": X.oracle("attempts", """SELECT instance_id, attempt_index % 59 = 0 AS unknown, CASE WHEN attempt_index % 59 = 0 THEN 'category,hop_bucket' ELSE
        concat_ws(',', CASE WHEN attempt_index % 61 = 0 THEN 'category' END, CASE WHEN attempt_index % 67 = 0 THEN 'hop_bucket' END) END AS differing
        FROM attempts WHERE status = 'accepted' AND (attempt_index % 59 = 0 OR attempt_index % 61 = 0 OR attempt_index % 67 = 0)"""),
    "uncovered_penetrations": X.oracle("contacts", f"""f AS (SELECT instance_id, step, CASE WHEN body_a = 0 THEN body_b ELSE body_a END AS peer, -contact_distance AS depth FROM contacts WHERE branch = 'factual' AND 0 IN (body_a, body_b) AND contact_distance < 0),
        e AS (SELECT instance_id, step, peer, max(least(depth, 0.03)) AS proof FROM f WHERE step % 3 <> 0 GROUP BY ALL)
        SELECT instance_id, count(*) AS missing, {sr('max(least(0.05, depth))')} AS deepest FROM f LEFT JOIN e USING (instance_id, step, peer) WHERE coalesce(proof, -1) + 1e-12 < least(0.05, depth) GROUP BY ALL"""),
    "ranges_upsert": X.oracle("frame_rows", f"""{X.PIXELS} SELECT scene, 'flow' AS layer, {sr('CASE WHEN scene % 2 = 0 THEN min(v) ELSE min(depth) END')} AS low, {sr('CASE WHEN scene % 2 = 0 THEN max(v) ELSE max(depth) END')} AS high
        FROM pixels GROUP BY scene"""),
}
