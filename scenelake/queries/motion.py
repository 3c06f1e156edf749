"""State trajectories, keyframes and paths."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from scenelake.functions import vectors as V
from scenelake.operators import integrity as I
from scenelake.operators import keyframes as Y
from scenelake.operators import spatial as P
from scenelake.operators import states as S
from scenelake.plans import quality as Z
from scenelake.queries import contacts as QC
from scenelake.queries import fixtures as X

RATE = 240.0
r, sr = X.rounded, X.sql_rounded


def _sides(spark, sf):
    states = X.body_states(spark, sf)
    return S.branch_states(states, "factual"), S.branch_states(states, "counterfactual")


def _paths(spark, sf):
    """The commanded path of object_0: its factual states with gaps closed."""
    return X.body_states(spark, sf).where("object_id = 'object_0' and branch = 'factual'")


def misaligned_branches(spark, sf):
    return S.misaligned(*_sides(spark, sf))


def state_gaps(spark, sf):
    gaps = S.state_gaps(*_sides(spark, sf), ("instance_id", "step", "object_id"))
    return gaps.select("instance_id", "object_id", *[r(F.col(c)).alias(c) for c in ("position_gap", "linear_gap", "angular_gap")],
                       r(F.col("rotation_gap"), 5).alias("rotation_gap"))


def diverged_objects(spark, sf):
    return S.diverged(*_sides(spark, sf), X.table(spark, sf, "state_targets")).select("instance_id", "object_id")


def diverged_shared_objects(spark, sf):
    return S.diverged_shared(*_sides(spark, sf)).select("instance_id", "object_id")


def speed_limits(spark, sf):
    return S.speed_limits(X.body_states(spark, sf)).select(
        "instance_id", "branch", *[r(F.col(c)).alias(c) for c in ("max_linear_velocity", "max_angular_velocity")])


def nonfinite_states(spark, sf):
    """Groups with a state whose position divides by zero at some rows."""
    states = X.body_states(spark, sf)
    broken = F.when(F.col("step") % 50 == 49, F.lit(float("nan"))).otherwise(F.col("position")[0])
    return S.nonfinite(states.withColumn("position", F.array(broken, F.col("position")[1], F.col("position")[2])),
                       ("instance_id", "branch", "object_id"))


def motion_modes(spark, sf):
    return S.motion_modes(X.body_states(spark, sf), RATE, minimum_travel=900.0).select(
        "instance_id", "branch", "object_id", "mode", r(F.col("path_length"), 4).alias("path_length"), r(F.col("revolutions"), 4).alias("revolutions"))


def max_displacement(spark, sf):
    return S.max_displacement(*_sides(spark, sf), X.table(spark, sf, "state_targets"), ["object_5"]).select(
        "instance_id", r(F.col("max_displacement")).alias("max_displacement"))


def commanded_velocities(spark, sf):
    return S.commanded_velocities(_paths(spark, sf), RATE).select("instance_id", "step", *X.lanes("velocity", "vx vy vz"))


def continuous_quaternions(spark, sf):
    return S.continuous_quaternions(X.body_states(spark, sf), ("instance_id", "branch", "object_id"), "step").select(
        "instance_id", "branch", "object_id", "step", *X.lanes("quaternion", "qw qx qy qz"))


def prefix_mismatches(spark, sf):
    targets = X.table(spark, sf, "state_targets").select("instance_id", "target_id", "start_step")
    return S.prefix_mismatches(*_sides(spark, sf), targets)


def prefix_contact_mismatches(spark, sf):
    points = X.contact_points(spark, sf)
    side = lambda b: points.where(F.col("branch") == b)
    targets = X.table(spark, sf, "targets").select("instance_id", "start_step")
    return S.prefix_contact_mismatches(side("factual"), side("counterfactual"), targets, ["step", "object_a", "object_b", "normal_force"])


def path_deviation(spark, sf):
    """How far every object's path leaves its own of the other branch."""
    return S.path_deviation(*_sides(spark, sf), ("instance_id", "object_id")).select("instance_id", "object_id", r(F.col("max_deviation")).alias("max_deviation"))


def scene_frame_steps(spark, sf):
    """Frames and steps of one scene per customer."""
    scenes = X.given(spark, sf, "customer").select(
        F.col("c_custkey").alias("instance_id"), F.lit(0).alias("frame_start"), (2 + F.col("c_custkey") % 5).cast("int").alias("frame_end"),
        F.lit(12).alias("frame_rate"), F.lit(240).alias("step_rate"))
    return S.frame_steps(S.duration_steps(scenes)).select("instance_id", "frame", "step", "duration_steps")


def _keyed(spark, sf, interpolation):
    keys = X.table(spark, sf, "keyframes").select("asset", "member", "frame", F.array("v").alias("value"))
    last = keys.groupBy("asset", "member").agg(F.max("frame").alias("_last"))
    asked = last.select("asset", "member", F.explode(F.sequence(F.lit(0), F.col("_last") + 2)).alias("frame"))
    return Y.values_at(keys, asked, 1, interpolation).select("asset", "frame", r(F.col("value")[0]).alias("value"))


def keyframes_linear(spark, sf):
    return _keyed(spark, sf, "linear")


def keyframes_nearest(spark, sf):
    return _keyed(spark, sf, "nearest")


def keyframes_const(spark, sf):
    return _keyed(spark, sf, "const")


def _samples(spark, sf):
    return S.with_step_index(_paths(spark, sf), ("instance_id",)).select(
        "instance_id", F.col("step_index").cast("int").alias("sample"), "position", "quaternion")


def resampled_paths(spark, sf):
    paths = _samples(spark, sf)
    return Y.resample(paths.select("instance_id", "sample", "position"), Y.uniform_times(paths, 48)).select(
        "instance_id", "sample", *X.lanes("position", "x y z"))


def resampled_poses(spark, sf):
    paths = _samples(spark, sf)
    posed = Y.resample(paths, Y.uniform_times(paths, 48), output_block=None)
    return posed.select("instance_id", "sample", *X.lanes("position", "x y z"), *X.lanes("quaternion", "qw qx qy qz", 5))


def path_violations(spark, sf):
    paths = _paths(spark, sf)
    bounds = paths.select("instance_id").distinct().select(
        "instance_id", V.vector(0.0, 0.0, 0.0).alias("lower"), V.vector(9.5, 8.7, 1.5).alias("upper"))
    return P.path_violations(paths, bounds).select("instance_id", "code")


def command_violations(spark, sf):
    """Logged poses of object_3 judged against its factual path as the command."""
    f, c = (side.where("object_id = 'object_3'") for side in _sides(spark, sf))
    ids = f.select("instance_id").distinct()
    objects = ids.select("instance_id", F.lit(0.5).alias("radius"), F.lit(0.25).alias("smallest_size"))
    none = f.select("instance_id", "step", F.lit(0.001).alias("depth")).where("step % 10 = 3")
    return S.command_violations(c, f, objects, none, RATE, 9.81).select("instance_id", "step", "reason")


def triplet_quality(spark, sf):
    states = X.body_states(spark, sf)
    third = states.where("branch = 'factual' and object_id <> 'object_0'").withColumn("branch", F.lit("subject_removed"))
    ids = X.table(spark, sf, "state_targets")
    specs = ids.select("instance_id", "subject_id", V.vector(0.0, 0.0, 0.0).alias("lower"), V.vector(9.55, 8.75, 1.2).alias("upper"))
    points = X.contact_points(spark, sf)
    verdict = Z.triplet_quality(specs, states.unionByName(third), points, RATE, ["object_5", "object_6"], linear_ceiling=1.3,
                                angular_ceiling=2.6, minimum_effect=0.001, minimum_travel=800.0)
    return verdict.select("instance_id", "accepted", F.array_join("reasons", ",").alias("reasons"), "subject_contacts",
                          r(F.col("counterfactual_displacement")).alias("counterfactual_displacement"),
                          r(F.col("removal_displacement")).alias("removal_displacement"))


def pair_quality(spark, sf):
    """Acceptance of every factual / counterfactual pair."""
    states = X.body_states(spark, sf).where("object_id in ('object_0', 'object_1', 'object_2')")
    points = X.contact_points(spark, sf).where("object_a in ('object_0', 'object_1', 'object_2') and object_b in ('object_0', 'object_1', 'object_2')")
    targets = X.table(spark, sf, "state_targets").select("instance_id", "target_id", "start_step")
    steps = states.groupBy("instance_id").agg((F.max("step") + 1).alias("step_count"))
    specs = targets.join(steps, "instance_id").select(
        "*", F.lit(60).alias("end_step"), F.lit("create_collision").alias("recipe"), F.lit(0.5).alias("magnitude"),
        F.lit("non_null").alias("expected_effect"), V.vector(-1.0, -1.0, -1.0).alias("lower"), V.vector(11.0, 11.0, 11.0).alias("upper"))
    objects = targets.select("instance_id", F.explode(F.array(*[F.lit(f"object_{i}") for i in range(3)])).alias("object_id")).select(
        "*", F.lit("cube").alias("shape"), V.vector(0.5, 0.5, 0.5).alias("size"), V.vector(4.0, 4.0, 0.5).alias("position"),
        V.vector(1.0, 0.0, 0.0, 0.0).alias("quaternion"), (F.col("object_id") == "object_2").alias("static"), F.lit(False).alias("clip_exempt"))
    paths = states.where("object_id = 'object_0'").select("instance_id", "branch", "step", "position", "quaternion")
    truth = QC.T.kinematic(points.select("instance_id", "branch", "step", "object_a", "object_b", "normal_force"), states, targets, RATE,
                           (), QC.FORCE, QC.IMPULSE)
    verdict = Z.pair_quality(specs, objects, states, points, paths, truth, targets)
    return verdict.select("instance_id", "accepted", F.array_join("reasons", ",").alias("reasons"), "affected_count", "contact_delta_count",
                          r(F.col("max_linear_velocity")).alias("max_linear_velocity"))


def state_multiset_difference(spark, sf):
    f, c = _sides(spark, sf)
    pick = lambda side: side.select("instance_id", "object_id", "step", r(F.col("position")[0]).alias("x"))
    return I.multiset_difference(pick(f), pick(c))


QUERIES = {f.__name__: f for f in (
    misaligned_branches, state_gaps, diverged_objects, diverged_shared_objects, speed_limits, nonfinite_states, motion_modes, max_displacement,
    commanded_velocities, continuous_quaternions, prefix_mismatches, prefix_contact_mismatches, path_deviation, scene_frame_steps,
    keyframes_linear, keyframes_nearest, keyframes_const, resampled_paths, resampled_poses, path_violations, command_violations,
    triplet_quality, pair_quality, state_multiset_difference,
)}

SIDES = """sf AS (SELECT * FROM states WHERE branch = 'factual'), sc AS (SELECT * FROM states WHERE branch = 'counterfactual')"""
KEYED = """asked AS (SELECT asset, unnest(range(0, CAST(max(frame) AS BIGINT) + 3)) AS frame FROM keyframes GROUP BY asset),
    a AS (SELECT q.asset, CAST(q.frame AS INT) AS frame, l.frame AS lf, l.v AS lv FROM asked q ASOF LEFT JOIN keyframes l ON q.asset = l.asset AND q.frame >= l.frame),
    b AS (SELECT a.*, n.frame AS rf, n.v AS rv FROM a ASOF LEFT JOIN keyframes n ON a.asset = n.asset AND a.frame <= n.frame)"""
SAMPLES = """src AS (SELECT instance_id, CAST(row_number() OVER (PARTITION BY instance_id ORDER BY step) - 1 AS INT) AS n, * EXCLUDE (instance_id)
        FROM states WHERE object_id = 'object_0' AND branch = 'factual'),
    lasts AS (SELECT instance_id, max(n) AS top FROM src GROUP BY ALL),
    q AS (SELECT instance_id, CAST(s AS INT) AS sample, s / 47.0::DOUBLE * top AS pos, least(CAST(floor(s / 47.0::DOUBLE * top) AS INT), top - 1) AS seg
        FROM lasts, range(0, 48) t(s))"""
QUAT = ("qw", "qx", "qy", "qz")


def _opposed(order: str) -> str:
    """1 where a quaternion opposes the one before it."""
    return "coalesce((" + " + ".join(f"{c} * lag({c}) OVER (PARTITION BY instance_id ORDER BY {order})" for c in QUAT) + " < 0)::INT, 0)"


TRIPLE = """three AS (SELECT * FROM states UNION ALL SELECT * REPLACE ('subject_removed' AS branch) FROM states WHERE branch = 'factual' AND object_id <> 'object_0'),
    facts AS (SELECT instance_id, branch, max(sqrt(vx*vx + vy*vy + vz*vz)) AS lin, max(sqrt(wx*wx + wy*wy + wz*wz)) AS ang,
        bool_or(x < -1e-6 OR x > 9.55 + 1e-6 OR y < -1e-6 OR y > 8.75 + 1e-6 OR z < -1e-6 OR z > 1.2 + 1e-6) AS outside FROM three GROUP BY ALL),
    hits AS (SELECT instance_id, count(*) AS n FROM contacts WHERE branch = 'factual' AND 'object_0' IN (object_a, object_b)
        AND 'object_5' NOT IN (object_a, object_b) AND 'object_6' NOT IN (object_a, object_b) GROUP BY ALL),
    steps AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz FROM states WHERE branch = 'factual' AND object_id NOT IN ('object_5', 'object_6')
        WINDOW w AS (PARTITION BY instance_id, object_id ORDER BY step)),
    modes AS (SELECT instance_id, object_id, sum(coalesce(sqrt((x-px)**2 + (y-py)**2 + (z-pz)**2), 0)) >= 800 AS slides,
        sum(sqrt(wx*wx + wy*wy)) / 240 / (2 * pi()) >= 0.35 AS rolls FROM steps GROUP BY ALL),
    moves AS (SELECT instance_id, bool_or(slides) AS slides, bool_or(rolls) AS rolls FROM modes GROUP BY ALL),
    at AS (SELECT *, row_number() OVER (PARTITION BY instance_id, branch, object_id ORDER BY step) AS idx FROM three WHERE object_id NOT IN ('object_0', 'object_5', 'object_6')),
    d AS (SELECT a.instance_id, b.branch, max(sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2)) AS m FROM at a JOIN at b USING (instance_id, object_id, idx)
        WHERE a.branch = 'factual' GROUP BY ALL)""".replace(" at AS", " track AS").replace("FROM at a JOIN at b", "FROM track a JOIN track b")

ORACLES = {
    "misaligned_branches": X.oracle("states", f"""{SIDES} SELECT coalesce(sf.instance_id, sc.instance_id) AS instance_id, count(*) AS unmatched_rows
        FROM sf FULL JOIN sc ON sf.instance_id = sc.instance_id AND sf.step = sc.step AND sf.object_id = sc.object_id WHERE sf.step IS NULL OR sc.step IS NULL GROUP BY ALL"""),
    "state_gaps": X.oracle("states", f"""{QC.GAPS.format(on='step', where='')} SELECT instance_id, object_id, {sr('position_gap')} AS position_gap, {sr('linear_gap')} AS linear_gap,
        {sr('angular_gap')} AS angular_gap, {sr('rotation_gap', 5)} AS rotation_gap FROM gaps"""),
    "diverged_objects": X.oracle("states", f"{QC.GAPS.format(on='step', where='WHERE step >= 40')} SELECT * FROM moved WHERE object_id <> 'object_0'"),
    "diverged_shared_objects": X.oracle("states", f"{QC.GAPS.format(on='idx', where='')} SELECT * FROM moved"),
    "speed_limits": X.oracle("states", f"""SELECT instance_id, branch, {sr('max(sqrt(vx*vx + vy*vy + vz*vz))')} AS max_linear_velocity,
        {sr('max(sqrt(wx*wx + wy*wy + wz*wz))')} AS max_angular_velocity FROM states GROUP BY ALL"""),
    "nonfinite_states": X.oracle("states", "SELECT DISTINCT instance_id, branch, object_id FROM states WHERE step % 50 = 49"),
    "motion_modes": X.oracle("states", f"""s AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz FROM states
        WINDOW w AS (PARTITION BY instance_id, branch, object_id ORDER BY step)),
        m AS (SELECT instance_id, branch, object_id, sum(coalesce(sqrt((x-px)**2 + (y-py)**2 + (z-pz)**2), 0)) AS p, sum(sqrt(wx*wx + wy*wy)) / 240 / {2 * math.pi} AS v FROM s GROUP BY ALL)
        SELECT instance_id, branch, object_id, CASE WHEN v >= 0.35 AND p >= 900 THEN 'both' WHEN v >= 0.35 THEN 'rolling' WHEN p >= 900 THEN 'sliding' ELSE 'static' END AS mode,
        {sr('p', 4)} AS path_length, {sr('v', 4)} AS revolutions FROM m"""),
    "max_displacement": X.oracle("states", f"""t AS (SELECT *, row_number() OVER (PARTITION BY instance_id, branch, object_id ORDER BY step) AS idx FROM states WHERE object_id NOT IN ('object_0', 'object_5'))
        SELECT a.instance_id, {sr('max(sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2))')} AS max_displacement FROM t a JOIN t b USING (instance_id, object_id, idx)
        WHERE a.branch = 'factual' AND b.branch = 'counterfactual' GROUP BY ALL"""),
    "commanded_velocities": X.oracle("states", f"""SELECT instance_id, step, {", ".join(f"{sr(f'coalesce(({c} - lag({c}) OVER w) * 240, 0)')} AS v{c}" for c in "xyz")} FROM states
        WHERE object_id = 'object_0' AND branch = 'factual' WINDOW w AS (PARTITION BY instance_id ORDER BY step)"""),
    "continuous_quaternions": X.oracle("states", f"""s AS (SELECT *, coalesce((qw*lag(qw) OVER w + qx*lag(qx) OVER w + qy*lag(qy) OVER w + qz*lag(qz) OVER w < 0)::INT, 0) AS o FROM states
        WINDOW w AS (PARTITION BY instance_id, branch, object_id ORDER BY step)),
        p AS (SELECT *, CASE WHEN sum(o) OVER (PARTITION BY instance_id, branch, object_id ORDER BY step) % 2 = 1 THEN -1.0 ELSE 1.0 END AS sg FROM s)
        SELECT instance_id, branch, object_id, step, {", ".join(f"{sr(f'sg * {c}')} AS {c}" for c in ("qw", "qx", "qy", "qz"))} FROM p"""),
    "prefix_mismatches": X.oracle("states", f"""{SIDES}, early AS (SELECT coalesce(sf.instance_id, sc.instance_id) AS instance_id, coalesce(sf.object_id, sc.object_id) AS object_id,
        coalesce(sf.step, sc.step) AS step, sf.step IS NOT NULL AND sc.step IS NOT NULL AND sf.x = sc.x AND sf.qw = sc.qw AS same
        FROM sf FULL JOIN sc ON sf.instance_id = sc.instance_id AND sf.step = sc.step AND sf.object_id = sc.object_id)
        SELECT instance_id, object_id, count(*) AS mismatched_steps FROM early WHERE (step < 40 OR (step = 0 AND object_id <> 'object_0')) AND NOT same GROUP BY ALL"""),
    "prefix_contact_mismatches": X.oracle("contacts", """b AS (SELECT instance_id, step, object_a, object_b, normal_force, sum(CASE WHEN branch = 'factual' THEN 1 ELSE -1 END) AS n
        FROM contacts WHERE step < 228 GROUP BY ALL) SELECT instance_id, CAST(sum(abs(n)) AS BIGINT) AS unmatched_contacts FROM b WHERE n <> 0 GROUP BY ALL"""),
    "path_deviation": X.oracle("states", f"""{SIDES} SELECT instance_id, object_id, {sr('max(sqrt((sf.x-sc.x)**2 + (sf.y-sc.y)**2 + (sf.z-sc.z)**2))')} AS max_deviation
        FROM sf JOIN sc USING (instance_id, object_id, step) GROUP BY ALL"""),
    "scene_frame_steps": """SELECT c_custkey AS instance_id, CAST(f AS INT) AS frame, CAST(f * 20 AS INT) AS step, CAST((2 + c_custkey % 5) * 20 AS INT) AS duration_steps
        FROM customer, range(0, 7) t(f) WHERE f < 2 + c_custkey % 5""",
    "keyframes_linear": X.oracle("keyframes", f"""{KEYED} SELECT asset, frame, {sr('''CASE WHEN lf IS NULL THEN rv WHEN rf IS NULL OR lf = rf THEN lv
        ELSE (1 - (frame - lf) / (rf - lf)) * lv + (frame - lf) / (rf - lf) * rv END''')} AS value FROM b"""),
    "keyframes_nearest": X.oracle("keyframes", f"""{KEYED} SELECT asset, frame, {sr('''CASE WHEN lf IS NULL THEN rv WHEN rf IS NULL OR abs(frame - lf) <= abs(frame - rf) THEN lv ELSE rv END''')} AS value FROM b"""),
    "keyframes_const": X.oracle("keyframes", f"{KEYED} SELECT asset, frame, {sr('coalesce(lv, rv)')} AS value FROM b"),
    "resampled_paths": X.oracle("states", f"""{SAMPLES} SELECT q.instance_id, sample, {", ".join(f"{sr(f'(1 - (pos - seg)) * a.{c} + (pos - seg) * b.{c}')} AS {c}" for c in "xyz")}
        FROM q JOIN src a ON a.instance_id = q.instance_id AND a.n = seg JOIN src b ON b.instance_id = q.instance_id AND b.n = seg + 1"""),
    "resampled_poses": X.oracle("states", f"""{SAMPLES},
        met AS (SELECT *, {_opposed("n")} AS o FROM src), turned AS (SELECT *, sum(o) OVER (PARTITION BY instance_id ORDER BY n) % 2 AS odd FROM met),
        even AS (SELECT instance_id, n, x, y, z, {", ".join(f"(1 - 2*odd) * {c} AS {c}" for c in QUAT)} FROM turned),
        ends AS (SELECT q.instance_id, sample, pos - seg AS t, {", ".join(f"a.{c} AS a_{c}, b.{c} AS b_{c}" for c in ("x", "y", "z", *QUAT))},
            acos(greatest(-1.0, least(1.0, a.qw*b.qw + a.qx*b.qx + a.qy*b.qy + a.qz*b.qz))) AS g
            FROM q JOIN even a ON a.instance_id = q.instance_id AND a.n = seg JOIN even b ON b.instance_id = q.instance_id AND b.n = seg + 1),
        blended AS (SELECT *, CASE WHEN cos(g) > 1 - 1e-10 THEN 1 - t ELSE sin((1 - t)*g)/sin(g) END AS wa, CASE WHEN cos(g) > 1 - 1e-10 THEN t ELSE sin(t*g)/sin(g) END AS wb FROM ends),
        posed AS (SELECT instance_id, sample, {", ".join(f"(1 - t)*a_{c} + t*b_{c} AS {c}" for c in "xyz")}, {", ".join(f"wa*a_{c} + wb*b_{c} AS {c}" for c in QUAT)} FROM blended),
        again AS (SELECT *, {_opposed("sample")} AS o FROM posed),
        whole AS (SELECT *, sqrt(qw*qw + qx*qx + qy*qy + qz*qz) AS size, sum(o) OVER (PARTITION BY instance_id ORDER BY sample) % 2 AS odd FROM again)
        SELECT instance_id, sample, {", ".join(f"{sr(c)} AS {c}" for c in "xyz")}, {", ".join(f"{sr(f'(1 - 2*odd) * {c} / size', 5)} AS {c}" for c in QUAT)} FROM whole"""),
    "path_violations": X.oracle("states", """p AS (SELECT *, qw*lag(qw) OVER w + qx*lag(qx) OVER w + qy*lag(qy) OVER w + qz*lag(qz) OVER w AS d FROM states
        WHERE object_id = 'object_0' AND branch = 'factual' WINDOW w AS (PARTITION BY instance_id ORDER BY step))
        SELECT DISTINCT instance_id, 'sign_flip' AS code FROM p WHERE d < -1e-6
        UNION ALL SELECT DISTINCT instance_id, 'outside_bounds' FROM p WHERE x < 0 OR x > 9.5 OR y < 0 OR y > 8.7 OR z < 0 OR z > 1.5"""),
    "triplet_quality": X.oracle("states contacts", f"""{TRIPLE}, codes AS (SELECT instance_id, 'linear_velocity_ceiling:' || branch AS code FROM facts WHERE lin > 1.3
        UNION ALL SELECT instance_id, 'angular_velocity_ceiling:' || branch FROM facts WHERE ang > 2.6 UNION ALL SELECT instance_id, 'out_of_bounds:' || branch FROM facts WHERE outside
        UNION ALL SELECT DISTINCT instance_id, 'no_factual_interaction' FROM states WHERE instance_id NOT IN (SELECT instance_id FROM hits)
        UNION ALL SELECT instance_id, 'null_effect' FROM d WHERE branch = 'counterfactual' AND m < 0.001
        UNION ALL SELECT instance_id, 'no_rolling_motion' FROM moves WHERE NOT rolls UNION ALL SELECT instance_id, 'no_sliding_motion' FROM moves WHERE NOT slides),
        lists AS (SELECT instance_id, string_agg(code, ',' ORDER BY code) AS reasons FROM codes GROUP BY ALL),
        ids AS (SELECT DISTINCT instance_id FROM states)
        SELECT instance_id, lists.reasons IS NULL AS accepted, coalesce(lists.reasons, '') AS reasons, coalesce(hits.n, 0) AS subject_contacts,
        {sr("(SELECT m FROM d WHERE d.instance_id = ids.instance_id AND branch = 'counterfactual')")} AS counterfactual_displacement,
        {sr("(SELECT m FROM d WHERE d.instance_id = ids.instance_id AND branch = 'subject_removed')")} AS removal_displacement
        FROM ids LEFT JOIN lists USING (instance_id) LEFT JOIN hits USING (instance_id)"""),
    "state_multiset_difference": X.oracle("states", f"""m AS (SELECT instance_id, object_id, step, {sr('x')} AS x, CASE WHEN branch = 'factual' THEN 1 ELSE -1 END AS n FROM states)
        SELECT instance_id, object_id, step, x, CAST(sum(n) AS BIGINT) AS balance FROM m GROUP BY ALL HAVING sum(n) <> 0"""),
}
