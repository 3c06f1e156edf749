"""Contacts, episodes and temporal graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenelake.operators import contacts as K
from scenelake.operators import graph as G
from scenelake.operators import states as S
from scenelake.plans import ground_truth as T
from scenelake.queries import fixtures as X
from scenelake.session import cut_lineage

RATE, FORCE, IMPULSE, STRONG = 240.0, 10.0, 0.052, 92.0
r, sr = X.rounded, X.sql_rounded


def _steps(spark, sf):
    return K.contact_steps(K.canonicalise(X.contact_points(spark, sf)), RATE)


def _edges(spark, sf, force=FORCE):
    thin = K.canonicalise(X.contact_points(spark, sf).select("instance_id", "branch", "step", "object_a", "object_b", "normal_force"))
    return K.episodes(K.contact_steps(thin, RATE), force, IMPULSE)


def _delta(spark, sf):
    edges = _edges(spark, sf)
    return G.edge_delta(G.branch_edges(edges, "factual"), G.branch_edges(edges, "counterfactual"))


def _union(spark, sf):
    edges = _edges(spark, sf)
    return G.union_edges(G.branch_edges(edges, "factual"), G.branch_edges(edges, "counterfactual"))


def _strong_graph(spark, sf):
    """Union and delta of the strong contacts alone, thin enough that some nodes stay unreached."""
    edges = cut_lineage(_edges(spark, sf, STRONG))
    sides = G.branch_edges(edges, "factual"), G.branch_edges(edges, "counterfactual")
    return G.union_edges(*sides), G.edge_delta(*sides)


def contact_steps(spark, sf):
    return _steps(spark, sf).select(
        "instance_id", "branch", "step", "object_a", "object_b", r(F.col("normal_force")).alias("normal_force"),
        r(F.col("impulse")).alias("impulse"), *X.lanes("position", "px py pz"), *X.lanes("normal", "nx ny nz"))


def canonical_contacts(spark, sf):
    points = K.canonicalise(X.contact_points(spark, sf))
    return K.in_canonical_order(points).select(
        "instance_id", "branch", "step", "object_a", "object_b", "normal_force", *X.lanes("position", "px py pz"),
        *X.lanes("normal", "nx ny nz"), r(F.col("contact_distance")).alias("contact_distance"))


def contact_episodes(spark, sf):
    return _edges(spark, sf).select("instance_id", "branch", "object_a", "object_b", "start_step", "end_step",
                                    r(F.col("total_impulse")).alias("total_impulse"), "peak_force")


def episode_members(spark, sf):
    thin = K.canonicalise(X.contact_points(spark, sf).select("instance_id", "branch", "step", "object_a", "object_b", "normal_force"))
    return K.episode_members(K.contact_steps(thin, RATE), FORCE).select(
        "instance_id", "branch", "object_a", "object_b", "step", "start_step", "normal_force")


def contact_nodes(spark, sf):
    return K.contact_nodes(X.contact_points(spark, sf))


def contact_pair_counts(spark, sf):
    return K.pair_counts(X.contact_points(spark, sf))


def contact_step_sets(spark, sf):
    return K.pair_steps(X.contact_points(spark, sf))


def subject_contacts(spark, sf):
    points = K.without_environment(K.canonicalise(X.contact_points(spark, sf)), ["object_6"], "object_0")
    return points.groupBy("instance_id", "branch").agg(F.count("*").alias("contact_count"), F.sum("normal_force").alias("force"))


def _named_bodies(spark, sf):
    ids = X.table(spark, sf, "targets").select("instance_id")
    numbers = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("body")
    return ids.select("instance_id", numbers).withColumn("object_id", F.concat(F.lit("object_"), F.col("body").cast("string")))


def resolved_contacts(spark, sf):
    named = K.resolve_raw(X.raw_contacts(spark, sf), _named_bodies(spark, sf), epsilon=5.0)
    return named.select("instance_id", "step", "object_a", "object_b", "normal_force", *X.lanes("normal", "nx ny nz"))


def collision_instances(spark, sf):
    events = K.collision_events(X.raw_contacts(spark, sf), steps_per_frame=20)
    listed = _named_bodies(spark, sf).select("instance_id", "body", F.col("body").alias("instance_index"))
    return K.index_collisions(events, listed).select(
        "instance_id", "first_instance", "second_instance", r(F.col("frame")).alias("frame"), "force", *X.lanes("position", "px py pz"))


def deepest_penetrations(spark, sf):
    scale = X.table(spark, sf, "targets").select("instance_id", F.lit(0).alias("target_body"), F.lit(0.05).alias("target_scale"))
    return K.deepest_penetrations(X.raw_contacts(spark, sf), scale).select(
        "instance_id", "step", "peer_body", r(F.col("depth")).alias("depth"))


def graph_delta(spark, sf):
    return _delta(spark, sf).select(
        *G.IDENTITY, "bucket", *[r(F.col(f"{b}_{m}")).alias(f"{b}_{m}") for b in ("factual", "counterfactual") for m in ("total_impulse", "peak_force")])


def removed_subject_delta(spark, sf):
    edges = _edges(spark, sf)
    stripped = G.without_node(G.branch_edges(edges, "factual"), "object_0")
    return G.edge_delta(stripped, G.branch_edges(edges, "counterfactual")).groupBy("instance_id", "bucket").agg(F.count("*").alias("edges"))


def edge_union(spark, sf):
    return _union(spark, sf).select(*G.IDENTITY, r(F.col("total_impulse")).alias("total_impulse"), "peak_force")


def delta_categories(spark, sf):
    counts = T._bucket_counts(_delta(spark, sf)).withColumns({"hard": F.lit(0), "soft": F.lit(0)})
    return counts.select("instance_id", "added", "removed", "changed", T.primary_category().alias("category"))


def bucket_overlaps(spark, sf):
    """Identities filed twice when every branch edge counts as added or removed by its parity."""
    edges = _edges(spark, sf).withColumn("bucket", F.when(F.col("branch") == "factual", "removed").otherwise("added"))
    return G.overlapping_buckets(edges)


def conflicting_edges(spark, sf):
    return G.conflicting_records(_edges(spark, sf), G.IDENTITY, ["peak_force"])


def hard_affected(spark, sf):
    union, delta = _strong_graph(spark, sf)
    return G.hard_affected(union, delta, X.table(spark, sf, "targets"), excluded=["object_6"])


def forward_reachable(spark, sf):
    late = G.branch_edges(_edges(spark, sf), "factual")
    return G.forward_reachable(late, X.table(spark, sf, "targets"), ["object_6"]).select("instance_id", "object_id", "arrival")


def propagation_paths(spark, sf):
    (union, delta), targets = _strong_graph(spark, sf), X.table(spark, sf, "targets")
    hard = G.hard_affected(union, delta, targets, ["object_6"])
    paths = G.witness_paths(union, delta, targets, hard, ["object_6"])
    return paths.select("instance_id", "object_id", F.array_join("path", ">").alias("path"), (F.size("path") - 1).alias("hops"))


def longest_propagation(spark, sf):
    reach_targets = X.table(spark, sf, "targets")
    late = G.branch_edges(_edges(spark, sf), "factual")
    reached = G.forward_reachable(late, reach_targets, ["object_6"])
    paths = T.longest_paths(G.forward_paths(late, reach_targets, reached, ["object_6"]))
    return paths.select("instance_id", "object_id", F.array_join("path", ">").alias("path"))


def chain_cue(spark, sf):
    steps = K.pair_steps(X.contact_points(spark, sf).where("branch = 'counterfactual'"), ["instance_id"])
    return T.first_matching_edge(_delta(spark, sf), steps, ["added", "changed"], "object_0", "object_3")


def _truth(spark, sf, with_paths=True):
    thin = X.contact_points(spark, sf).select("instance_id", "branch", "step", "object_a", "object_b", "normal_force")
    return T.kinematic(thin, X.body_states(spark, sf), X.table(spark, sf, "targets").withColumn("start_step", F.lit(50)), RATE,
                       ["object_6"], STRONG, IMPULSE, with_paths=with_paths)


def affected_objects(spark, sf):
    return _truth(spark, sf, with_paths=False).affected


def ground_truth_tags(spark, sf):
    truth = _truth(spark, sf)
    facts = T.summary(truth, X.table(spark, sf, "targets"), ["object_6"])
    return facts.select("instance_id", "added", "removed", "changed", "hard", "soft", "max_hops", T.hop_bucket().alias("hop_bucket"),
                        T.primary_category().alias("category"), F.array_join(T.tags(), ",").alias("tags"))


def velocity_affected(spark, sf):
    thin = X.contact_points(spark, sf)
    return T.velocity(thin, X.body_states(spark, sf), X.table(spark, sf, "targets"), RATE, ["object_6"]).affected


def removal_affected(spark, sf):
    thin = X.contact_points(spark, sf)
    return T.removal(thin, X.body_states(spark, sf), X.table(spark, sf, "targets"), RATE, ["object_6"]).affected


QUERIES = {f.__name__: f for f in (
    contact_steps, canonical_contacts, contact_episodes, episode_members, contact_nodes, contact_pair_counts, contact_step_sets,
    subject_contacts, resolved_contacts, collision_instances, deepest_penetrations, graph_delta, removed_subject_delta, edge_union,
    delta_categories, bucket_overlaps, conflicting_edges, hard_affected, forward_reachable, propagation_paths, longest_propagation,
    chain_cue, affected_objects, ground_truth_tags, velocity_affected, removal_affected,
)}

CANON = """canon AS (SELECT instance_id, branch, step, least(object_a, object_b) AS object_a, greatest(object_a, object_b) AS object_b,
    normal_force, px, py, pz, contact_distance, CASE WHEN object_b < object_a THEN -1.0 ELSE 1.0 END AS sg, nx, ny, nz FROM contacts)"""


def episodes_sql(source: str = "canon", threshold: float = FORCE, impulse: float = IMPULSE, name: str = "edges") -> str:
    """Gaps and islands over the summed force of each pair and step."""
    return f"""{name}_sums AS (SELECT instance_id, branch, object_a, object_b, step, sum(normal_force) AS f FROM {source} GROUP BY ALL),
    {name}_marks AS (SELECT *, step - row_number() OVER (PARTITION BY instance_id, branch, object_a, object_b ORDER BY step) AS g
        FROM {name}_sums WHERE f >= {threshold}),
    {name} AS (SELECT instance_id, branch, object_a, object_b, CAST(min(step) AS INT) AS start_step, CAST(max(step) + 1 AS INT) AS end_step,
        sum(f) / 240.0 AS total_impulse, max(f) AS peak_force FROM {name}_marks GROUP BY instance_id, branch, object_a, object_b, g
        HAVING sum(f) / 240.0 >= {impulse})"""


EDGES = f"{CANON}, {episodes_sql()}"
_COMPARED = """f AS (SELECT * FROM edges WHERE branch = 'factual'), c AS (SELECT * FROM edges WHERE branch = 'counterfactual'),
    compared AS (SELECT instance_id, object_a, object_b, start_step, end_step,
        f.total_impulse AS fi, f.peak_force AS fp, c.total_impulse AS ci, c.peak_force AS cp,
        CASE WHEN f.peak_force IS NULL THEN 'added' WHEN c.peak_force IS NULL THEN 'removed'
             WHEN abs(f.total_impulse - c.total_impulse) > 1e-6 OR abs(f.peak_force - c.peak_force) > 1e-6 THEN 'changed' ELSE 'same' END AS bucket
        FROM f FULL JOIN c USING (instance_id, object_a, object_b, start_step, end_step)),
    delta AS (SELECT * FROM compared WHERE bucket <> 'same')"""
DELTA = f"{EDGES}, {_COMPARED}"
STRONG_DELTA = f"{CANON}, {episodes_sql(threshold=STRONG)}, {_COMPARED}"
REACH = """arcs AS (SELECT instance_id, object_a AS node, object_b AS other, start_step AS s, end_step AS e, bucket <> 'same' AS trig FROM compared
        WHERE object_a <> 'object_6' AND object_b <> 'object_6'
        UNION ALL SELECT instance_id, object_b, object_a, start_step, end_step, bucket <> 'same' FROM compared
        WHERE object_a <> 'object_6' AND object_b <> 'object_6'),
    fwd AS (SELECT instance_id, target_id AS node, false AS trig, {start} AS t FROM targets
        UNION SELECT w.instance_id, a.other, w.trig OR a.trig, greatest(w.t, a.s) FROM fwd w JOIN arcs a
        ON a.instance_id = w.instance_id AND a.node = w.node WHERE greatest(w.t, a.s) < a.e),
    bwd AS (SELECT instance_id, node, e - 1 AS latest FROM arcs WHERE trig
        UNION SELECT b.instance_id, a.other, least(b.latest, a.e - 1) FROM bwd b JOIN arcs a
        ON a.instance_id = b.instance_id AND a.node = b.node WHERE a.s <= b.latest),
    hard AS (SELECT w.instance_id, w.node AS object_id FROM
        (SELECT instance_id, node, min(t) FILTER (NOT trig) AS plain, bool_or(trig) AS hit FROM fwd GROUP BY ALL) w
        LEFT JOIN (SELECT instance_id, node, max(latest) AS latest FROM bwd GROUP BY ALL) l USING (instance_id, node)
        WHERE (w.hit OR w.plain <= l.latest) AND w.node <> 'object_0')"""


def _forward(source: str, name: str) -> str:
    return f"""{name}_arcs AS (SELECT instance_id, object_a AS node, object_b AS other, start_step AS s, end_step AS e FROM {source} WHERE object_b <> 'object_6'
        UNION ALL SELECT instance_id, object_b, object_a, start_step, end_step FROM {source} WHERE object_a <> 'object_6'),
    {name}_walk AS (SELECT instance_id, 'object_0' AS node, 0 AS t FROM targets
        UNION SELECT w.instance_id, a.other, a.s FROM {name}_walk w JOIN {name}_arcs a ON a.instance_id = w.instance_id AND a.node = w.node WHERE a.e > w.t),
    {name} AS (SELECT instance_id, node AS object_id, min(t) AS arrival FROM {name}_walk WHERE node <> 'object_0' GROUP BY ALL)"""


def _layers(arcs: str, length: int = 12) -> str:
    """Walks of up to ``length`` edges, each open at the arrival; the smallest per node and arrival."""
    layers = ["w0 AS (SELECT instance_id, 'object_0' AS node, 0 AS t, ['object_0'] AS path FROM targets)"]
    layers += [f"""w{k} AS (SELECT w.instance_id, a.other AS node, a.s AS t, min(list_append(w.path, a.other)) AS path
        FROM w{k - 1} w JOIN {arcs} a ON a.instance_id = w.instance_id AND a.node = w.node WHERE a.e > w.t GROUP BY ALL)""" for k in range(1, length + 1)]
    return ", ".join(layers) + ", walks AS (" + " UNION ALL ".join(f"SELECT * FROM w{k}" for k in range(length + 1)) + ")"


GAPS = """sf AS (SELECT *, row_number() OVER (PARTITION BY instance_id, object_id ORDER BY step) AS idx FROM states WHERE branch = 'factual'),
    sc AS (SELECT *, row_number() OVER (PARTITION BY instance_id, object_id ORDER BY step) AS idx FROM states WHERE branch = 'counterfactual'),
    gaps AS (SELECT instance_id, object_id,
        max(sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2)) AS position_gap, max(sqrt((a.vx-b.vx)**2 + (a.vy-b.vy)**2 + (a.vz-b.vz)**2)) AS linear_gap,
        max(sqrt((a.wx-b.wx)**2 + (a.wy-b.wy)**2 + (a.wz-b.wz)**2)) AS angular_gap,
        max(2 * acos(least(1.0, abs(a.qw*b.qw + a.qx*b.qx + a.qy*b.qy + a.qz*b.qz)))) AS rotation_gap
        FROM sf a JOIN sc b USING (instance_id, object_id, {on}) {where} GROUP BY ALL),
    moved AS (SELECT instance_id, object_id FROM gaps WHERE position_gap > 1e-3 OR linear_gap > 1e-3 OR angular_gap > 1e-3 OR rotation_gap > 1e-3)"""

LATE = f"""late_points AS (SELECT * FROM canon), {episodes_sql('late_points', 0, 0, 'late')},
    late_f AS (SELECT * FROM late WHERE branch = 'factual'), late_c AS (SELECT * FROM late WHERE branch = 'counterfactual')"""

ORACLES = {
    "contact_steps": X.oracle("contacts", f"""{CANON}, agg AS (SELECT instance_id, branch, step, object_a, object_b, sum(normal_force) AS f,
        {", ".join(f"sum(normal_force * {c}) / sum(normal_force) AS {c}" for c in ("px", "py", "pz"))},
        {", ".join(f"sum(normal_force * sg * {c}) / sum(normal_force) AS {c}" for c in ("nx", "ny", "nz"))} FROM canon GROUP BY ALL)
        SELECT instance_id, branch, step, object_a, object_b, {sr('f')} AS normal_force, {sr('f / 240.0')} AS impulse,
        {", ".join(f"{sr(c)} AS {c}" for c in ("px", "py", "pz"))},
        {", ".join(f"CASE WHEN nx*nx + ny*ny + nz*nz = 0 THEN 0.0 ELSE {sr(f'{c} / sqrt(nx*nx + ny*ny + nz*nz)')} END AS {c}" for c in ("nx", "ny", "nz"))} FROM agg"""),
    "canonical_contacts": X.oracle("contacts", f"""{CANON} SELECT instance_id, branch, step, object_a, object_b, normal_force,
        {", ".join(f"{sr(c)} AS {c}" for c in ("px", "py", "pz"))}, {", ".join(f"{sr(f'sg * {c}')} AS {c}" for c in ("nx", "ny", "nz"))},
        {sr('contact_distance')} AS contact_distance FROM canon"""),
    "contact_episodes": X.oracle("contacts", f"{EDGES} SELECT instance_id, branch, object_a, object_b, start_step, end_step, {sr('total_impulse')} AS total_impulse, peak_force FROM edges"),
    "episode_members": X.oracle("contacts", f"""{EDGES} SELECT instance_id, branch, object_a, object_b, step,
        min(step) OVER (PARTITION BY instance_id, branch, object_a, object_b, g) AS start_step, f AS normal_force FROM edges_marks"""),
    "contact_nodes": X.oracle("contacts", "SELECT DISTINCT instance_id, branch, unnest([object_a, object_b]) AS node FROM contacts"),
    "contact_pair_counts": X.oracle("contacts", "SELECT instance_id, branch, least(object_a, object_b) || '|' || greatest(object_a, object_b) AS pair, count(*) AS contact_count FROM contacts GROUP BY ALL"),
    "contact_step_sets": X.oracle("contacts", "SELECT DISTINCT instance_id, branch, step FROM contacts"),
    "subject_contacts": X.oracle("contacts", """SELECT instance_id, branch, count(*) AS contact_count, sum(normal_force) AS force FROM contacts
        WHERE 'object_6' NOT IN (object_a, object_b) AND 'object_0' IN (object_a, object_b) GROUP BY ALL"""),
    "resolved_contacts": X.oracle("contacts", f"""{CANON} SELECT instance_id, step, object_a, object_b, normal_force,
        {", ".join(f"{sr(f'sg * {c}')} AS {c}" for c in ("nx", "ny", "nz"))} FROM canon WHERE branch = 'factual' AND normal_force > 5
        AND object_a <= 'object_4' AND object_b <= 'object_4'"""),
    "collision_instances": X.oracle("contacts", f"""SELECT instance_id, CASE WHEN body_b <= 4 THEN body_b ELSE -1 END AS first_instance,
        CASE WHEN body_a <= 4 THEN body_a ELSE -1 END AS second_instance, {sr('step / 20.0')} AS frame, normal_force AS force,
        {", ".join(f"{sr(c)} AS {c}" for c in ("px", "py", "pz"))} FROM contacts WHERE branch = 'factual' AND normal_force > 1e-6"""),
    "deepest_penetrations": X.oracle("contacts", f"""SELECT instance_id, step, CASE WHEN body_a = 0 THEN body_b ELSE body_a END AS peer_body,
        {sr('max(least(-contact_distance, 0.05))')} AS depth FROM contacts WHERE branch = 'factual' AND 0 IN (body_a, body_b) AND contact_distance < 0 GROUP BY ALL"""),
    "graph_delta": X.oracle("contacts", f"""{DELTA} SELECT instance_id, object_a, object_b, start_step, end_step, bucket, {sr('fi')} AS factual_total_impulse,
        {sr('fp')} AS factual_peak_force, {sr('ci')} AS counterfactual_total_impulse, {sr('cp')} AS counterfactual_peak_force FROM delta"""),
    "removed_subject_delta": X.oracle("contacts", DELTA.replace("f AS (SELECT * FROM edges WHERE branch = 'factual')",
        "f AS (SELECT * FROM edges WHERE branch = 'factual' AND 'object_0' NOT IN (object_a, object_b))")
        + " SELECT instance_id, bucket, count(*) AS edges FROM delta GROUP BY ALL"),
    "edge_union": X.oracle("contacts", f"""{DELTA} SELECT instance_id, object_a, object_b, start_step, end_step, {sr('coalesce(ci, fi)')} AS total_impulse,
        coalesce(cp, fp) AS peak_force FROM compared"""),
    "delta_categories": X.oracle("contacts", f"""{DELTA}, n AS (SELECT instance_id, count(*) FILTER (bucket = 'added') AS added,
        count(*) FILTER (bucket = 'removed') AS removed, count(*) FILTER (bucket = 'changed') AS changed FROM delta GROUP BY ALL)
        SELECT *, CASE WHEN (added > 0)::INT + (removed > 0)::INT + (changed > 0)::INT > 1 THEN 'mixed_contact_delta' WHEN added > 0 THEN 'contact_added'
        WHEN removed > 0 THEN 'contact_removed' ELSE 'contact_changed' END AS category FROM n"""),
    "bucket_overlaps": X.oracle("contacts", f"""{EDGES} SELECT instance_id, object_a, object_b, start_step, end_step, count(DISTINCT branch) AS buckets FROM edges
        GROUP BY ALL HAVING count(DISTINCT branch) > 1"""),
    "conflicting_edges": X.oracle("contacts", f"""{EDGES} SELECT instance_id, object_a, object_b, start_step, end_step, count(*) AS records FROM edges
        GROUP BY ALL HAVING count(DISTINCT peak_force) > 1"""),
    "hard_affected": X.oracle("contacts targets", f"{STRONG_DELTA}, {REACH.format(start='start_step')} SELECT * FROM hard"),
    "forward_reachable": X.oracle("contacts targets", f"""{EDGES}, picked AS (SELECT * FROM edges WHERE branch = 'factual'),
        {_forward('picked', 'reached')} SELECT instance_id, object_id, arrival FROM reached"""),
    "chain_cue": X.oracle("contacts", f"""{DELTA} SELECT instance_id, min(start_step) AS start_step FROM delta WHERE bucket IN ('added', 'changed')
        AND object_a = 'object_0' AND object_b = 'object_3' AND (instance_id, start_step) IN (SELECT (instance_id, step) FROM contacts WHERE branch = 'counterfactual') GROUP BY ALL"""),
    "affected_objects": X.oracle("contacts targets states", f"""{STRONG_DELTA}, {REACH.format(start='50')}, {GAPS.format(on='step', where='WHERE step >= 50')}
        SELECT instance_id, object_id, 'hard' AS kind FROM hard UNION ALL SELECT instance_id, object_id, 'soft' FROM moved
        WHERE object_id <> 'object_0' AND instance_id IN (SELECT instance_id FROM targets) AND (instance_id, object_id) NOT IN (SELECT (instance_id, object_id) FROM hard)"""),
    "velocity_affected": X.oracle("contacts targets states", f"""{CANON}, {LATE}, {_forward('late_f', 'rf')}, {_forward('late_c', 'rc')}, {GAPS.format(on='idx', where='')},
        either AS (SELECT instance_id, object_id FROM rf UNION SELECT instance_id, object_id FROM rc)
        SELECT instance_id, object_id, CASE WHEN (instance_id, object_id) IN (SELECT (instance_id, object_id) FROM either) THEN 'hard' ELSE 'soft' END AS kind
        FROM moved WHERE object_id <> 'object_0'"""),
    "removal_affected": X.oracle("contacts targets states", f"""{CANON}, {LATE}, {_forward('late_f', 'rf')}, {GAPS.format(on='idx', where='')}
        SELECT instance_id, object_id, CASE WHEN (instance_id, object_id) IN (SELECT (instance_id, object_id) FROM rf) THEN 'hard' ELSE 'soft' END AS kind
        FROM moved WHERE object_id <> 'object_0'"""),
    "longest_propagation": X.oracle("contacts targets", f"""{EDGES}, picked AS (SELECT * FROM edges WHERE branch = 'factual'),
        {_forward('picked', 'reached')}, {_layers('reached_arcs')},
        best AS (SELECT *, row_number() OVER (PARTITION BY instance_id, node ORDER BY len(path), path) AS n FROM walks WHERE node <> 'object_0'),
        longest AS (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY len(path) DESC, node) AS k FROM best WHERE n = 1)
        SELECT instance_id, node AS object_id, array_to_string(path, '>') AS path FROM longest WHERE k = 1"""),
}
