"""Scenario parameter rows: one attempt per order."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from scenelake.functions import vectors as V
from scenelake.operators import keyframes as Y
from scenelake.operators import scenarios as G
from scenelake.operators import spatial as S
from scenelake.queries import fixtures as X
from scenelake.session import spread

r, sr = X.rounded, X.sql_rounded
MASTER = 2301


def _attempts(spark, sf):
    return X.given(spark, sf, "orders").select(F.col("o_orderkey").alias("attempt_index"))


def scenario_draws(spark, sf):
    seed = G.seed_of(MASTER, F.col("attempt_index"), "scene")
    weights = {"rolling": 1.0, "sliding": 2.0, "both": 0.5}
    return _attempts(spark, sf).withColumn("seed", seed).select(
        "attempt_index", r(G.uniform(F.col("seed"), "gravity", -9.9, -9.7)).alias("gravity"), G.integer(F.col("seed"), "count", 4, 7).alias("count"),
        G.choice(F.col("seed"), "shape", ["cube", "sphere", "cylinder"]).alias("shape"), G.weighted(F.col("seed"), "mode", weights).alias("mode"),
        G.weighted(F.col("seed"), "style", weights, by_name=False).alias("style"),
        G.frequency_bands(G.H.draw(F.col("seed"), "band"), -1.0, 2.0, 5)["band"].alias("band"))


def velocity_pairs(spark, sf):
    rows = G.velocity_rows(_attempts(spark, sf), MASTER, (1.0, 3.0), (1.5, 3.5), (0.3, 1.2), minimum_delta=0.4)
    return rows.select("attempt_index", r(F.col("speed")).alias("speed"), r(F.col("counterfactual_speed")).alias("counterfactual_speed"),
                       *X.lanes("velocity", "vx vy vz"), *X.lanes("counterfactual_velocity", "cx cy cz"))


def uniform_rotations(spark, sf):
    seed = G.seed_of(MASTER, F.col("attempt_index"), "rotation")
    rows = _attempts(spark, sf).withColumn("seed", seed).withColumn("q", G.rotation(F.col("seed"))).withColumn("t", G.rotation(F.col("seed"), "z"))
    return rows.select("attempt_index", *X.lanes("q", "qw qx qy qz"), r(F.col("t")[0]).alias("turn_w"), r(F.col("t")[3]).alias("turn_z"))


def shell_points(spark, sf):
    seed = G.seed_of(MASTER, F.col("attempt_index"), "shell")
    rows = _attempts(spark, sf).withColumn("seed", seed).withColumn("p", G.half_shell_point(F.col("seed"), 7.0, 9.0))
    return rows.select("attempt_index", *X.lanes("p", "x y z"), r(V.norm(F.col("p"))).alias("radius"))


def shell_points_above(spark, sf):
    """Distance and height range of points whose direction must rise above an offset."""
    rows = G.shell_points_above(_attempts(spark, sf), 7.0, 9.0, 0.1, MASTER)
    return rows.select("attempt_index", r(V.norm(F.col("point")), 4).between(7.0, 9.0).alias("in_shell"), (F.col("point")[2] > 0).alias("above"))


def camera_motions(spark, sf):
    """Frames of linear camera motions: every position stays near the shell."""
    speed = G.uniform(G.seed_of(MASTER, F.col("attempt_index"), "speed"), "s", 0.0, 4.0)
    moves = G.linear_camera_motion(_attempts(spark, sf).where("attempt_index >= 0"), speed, MASTER)
    framed = G.camera_frames(moves, 0, 3)
    return framed.groupBy("attempt_index").agg(F.count("*").alias("frames"), r(F.max(V.norm(F.col("position"))), 4).between(6.0, 12.001).alias("in_reach"))


def look_at_motions(spark, sf):
    moves = G.linear_look_at_motion(_attempts(spark, sf), MASTER)
    return moves.select("attempt_index", (V.norm(F.col("look_at_start")) <= 4.0001).alias("start_near"), (V.norm(F.col("look_at_end")) <= 4.0001).alias("end_near"))


def object_rows(spark, sf):
    rows = G.object_rows(_attempts(spark, sf), MASTER, (2, 4), ["cube", "sphere", "capsule"], (0.1, 0.4), (-2.0, -2.0, 0.0), (2.0, 2.0, 1.0))
    return rows.select("attempt_index", "object_id", "shape", *X.lanes("size", "sx sy sz"), *X.lanes("position", "x y z"))


def clear_layouts(spark, sf):
    """Attempts whose sampled objects do not overlap."""
    attempts = _attempts(spark, sf)
    # An attempt's objects are drawn in the task that compares them, once.
    rows = G.object_rows(spread(attempts, "attempt_index", size=G.DRAWN).distinct(), MASTER, (2, 4), ["cube", "sphere", "capsule"], (0.1, 0.4), (-2.0, -2.0, 0.0), (2.0, 2.0, 1.0))
    boxes = rows.select(F.col("attempt_index").alias("instance_id"), "object_id", "position", "size").withColumnRenamed("size", "extent")
    bad = S.crowded(boxes).withColumnRenamed("instance_id", "attempt_index")
    return attempts.join(bad, "attempt_index", "left_anti")


def block_looks(spark, sf):
    seed = G.seed_of(MASTER, F.col("attempt_index"), "look")
    rows = _attempts(spark, sf).withColumn("seed", seed).withColumns({
        "c": G.object_color(F.col("seed"), "clevr"), "s": G.object_size(F.col("seed"), "clevr"), "u": G.object_size(F.col("seed"), "uniform"), "h": G.object_color(F.col("seed"), "uniform_hue")})
    physics = G.metal_or_rubber(G.H.draw(F.col("seed"), "metal") < 0.5)
    return rows.select("attempt_index", F.col("c.label").alias("color"), r(F.col("c.rgb")[0]).alias("red"), F.col("s.label").alias("size_label"), F.col("s.size").alias("size"),
                       r(F.col("u.size")).alias("free_size"), r(F.col("h.rgb")[1]).alias("green"), physics["friction"].alias("friction"))


def appearance_rows(spark, sf):
    seed = G.seed_of(MASTER, F.col("attempt_index"), "appearance")
    color = G.appearance_color(F.col("seed"), {"hsv": 0.5, "palette": 0.3, "neutral": 0.2}, (0.0, 1.0), (0.4, 0.9), (0.5, 1.0), [(0.1, 0.2, 0.3, 1.0), (0.9, 0.8, 0.7, 1.0)], (0.3, 0.8))
    families = list(G.MATERIALS)
    rows = _attempts(spark, sf).withColumn("seed", seed).withColumn("rgba", color).withColumn("family", G.choice(F.col("seed"), "family", families)).withColumn(
        "m", G.material(F.col("seed"), F.col("family")))
    return rows.select("attempt_index", *X.lanes("rgba", "r g b a"), "family", *[r(F.col(f"m.{c}")).alias(c) for c in ("metallic", "roughness", "ior", "transmission")])


def light_rows(spark, sf):
    rig = {n: {"position": ((-3.0, -3.0, 4.0), (3.0, 3.0, 7.0)), "intensity": (50.0 * (i + 1), 90.0 * (i + 1)), "size": (0.5, 2.0)} for i, n in enumerate(("key", "fill", "rim"))}
    rows = G.light_rows(_attempts(spark, sf), rig, MASTER)
    return rows.select("attempt_index", "light_id", *X.lanes("position", "x y z"), r(F.col("intensity")).alias("intensity"), r(F.col("width")).alias("width"), r(F.col("height")).alias("height"))


def _edits(spark, sf):
    recipes = ["create_collision", "remove_collision", "break_contact", "maintain_contact"]
    paths = X.body_states(spark, sf).where("object_id = 'object_0' and branch = 'factual'").select("instance_id", "step", "position")
    ends = paths.groupBy("instance_id").agg(F.min("step").alias("first_step"), F.max("step").alias("last_step"))
    picked = F.array(*[F.lit(x) for x in recipes])[F.col("instance_id") % 4]
    return paths, ends.select("*", F.col("instance_id").alias("attempt_index"), picked.alias("recipe"), F.lit(0.5).alias("magnitude"))


def perturbed_paths(spark, sf):
    paths, edits = _edits(spark, sf)
    moved = G.perturb_paths(paths, edits, MASTER)
    return moved.select("instance_id", "step", *X.lanes("position", "x y z"))


def retimed_paths(spark, sf):
    paths, edits = _edits(spark, sf)
    sampled = paths.join(edits.select("instance_id", "first_step"), "instance_id").select("instance_id", (F.col("step") - F.col("first_step")).alias("sample"), "position")
    queries = G.retimed_queries(sampled, edits, MASTER, strength=0.5)
    return Y.resample(sampled, queries).select("instance_id", "sample", *X.lanes("position", "x y z", 5))


def promoted_objects(spark, sf):
    """Objects of an attempt frozen into obstacles, those in the corridor excepted."""
    rows = G.object_rows(_attempts(spark, sf), MASTER, (2, 4), ["cube"], (0.1, 0.4), (-2.0, -2.0, 0.0), (2.0, 2.0, 1.0)).select(
        F.col("attempt_index").alias("instance_id"), "attempt_index", "object_id", "position")
    corridor = rows.where(F.abs(F.col("position")[1]) < 0.5)
    return G.promote_static(rows, corridor, (0.3, 0.9), MASTER).select("instance_id", "object_id", "static")


QUERIES = {f.__name__: f for f in (
    scenario_draws, velocity_pairs, uniform_rotations, shell_points, shell_points_above, camera_motions, look_at_motions, object_rows, clear_layouts, block_looks,
    appearance_rows, light_rows, perturbed_paths, retimed_paths, promoted_objects,
)}


def _seeded(domain: str, source: str = "orders", key: str = "o_orderkey", alias: str = "attempt_index") -> str:
    """Attempts with the seed ``s`` of one domain."""
    return f"a AS (SELECT {key} AS {alias}, (('0x' || substr(sha256('{MASTER}' || chr(0) || {key} || chr(0) || '{domain}'), 1, 16))::UBIGINT % 9223372036854775808)::BIGINT AS s FROM {source})"


def _d(lane: str, seed: str = "s") -> str:
    return f"(('0x' || substr(sha256({seed}::VARCHAR || ':{lane}'), 1, 14))::BIGINT / 72057594037927936.0)"


def _u(lane: str, low: float, high: float, seed: str = "s") -> str:
    return f"({low}::DOUBLE + {_d(lane, seed)} * ({high}::DOUBLE - {low}::DOUBLE))"


def _arms(lane: str, weights: list[tuple[str, float]], sign: str) -> str:
    whole, cursor, arms = sum(w for _, w in weights), 0.0, []
    for name, weight in weights:
        cursor += weight / whole
        arms.append(f"WHEN {_d(lane)} {sign} {cursor!r} THEN '{name}'")
    return f"CASE {' '.join(arms)} ELSE '{weights[-1][0]}' END"


_PI2 = repr(2 * math.pi)
_W = {"rolling": 1.0, "sliding": 2.0, "both": 0.5}
_OBJ = f"""{_seeded('scene')}, o AS (SELECT attempt_index, s, CAST(i AS INT) AS i, s::VARCHAR || '/' || i AS k FROM a, range(0, 4) t(i) WHERE i < floor({_d('count')} * 3) + 2),
    obj AS (SELECT attempt_index, i, 'object_' || i AS object_id, ['cube', 'sphere', 'capsule'][CAST(floor({_d('shape', 'k')} * 3) AS INT) + 1] AS shape, {_u('size0', 0.1, 0.4, 'k')} AS h0, {_u('size1', 0.1, 0.4, 'k')} AS h1,
    {_u('p0', -2.0, 2.0, 'k')} AS x, {_u('p1', -2.0, 2.0, 'k')} AS y, {_u('p2', 0.0, 1.0, 'k')} AS z FROM o)"""


def _normal(lane: str) -> str:
    return f"(sqrt(-2.0 * ln(1.0 - {_d(f'{lane}/r')})) * cos({_PI2} * {_d(f'{lane}/a')}))"


_COLORS = {n: c for n, c in G.color.BLOCK_COLORS.items()}
_FAM = list(G.MATERIALS)
_HUE_GREEN = f"""(CASE CAST(floor({_d('hue')} * 6) AS INT) WHEN 0 THEN {_d('hue')} * 6 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 1 - ({_d('hue')} * 6 - 3) ELSE 0 END)::DOUBLE"""


def _prior(field: str) -> str:
    low, high = ([G.MATERIALS[f][field][side] for f in _FAM] for side in (0, 1))
    return f"(({low}[fam])::DOUBLE + {_d(f'material/{field}')} * (({high}[fam])::DOUBLE - ({low}[fam])::DOUBLE))"


_H, _S, _V = _u("hue", 0.0, 1.0), _u("saturation", 0.4, 0.9), _u("value", 0.5, 1.0)
_EDITS = f"""p AS (SELECT instance_id, step, x, y, z, min(step) OVER i AS s0, max(step) OVER i AS s1 FROM states WHERE object_id = 'object_0' AND branch = 'factual' WINDOW i AS (PARTITION BY instance_id)),
    q AS (SELECT DISTINCT instance_id FROM p)"""

ORACLES = {
    "scenario_draws": f"""WITH {_seeded('scene')} SELECT attempt_index, {sr(_u('gravity', -9.9, -9.7))} AS gravity, CAST(floor({_d('count')} * 3) + 4 AS INT) AS count,
        ['cube', 'sphere', 'cylinder'][CAST(floor({_d('shape')} * 3) AS INT) + 1] AS shape, {_arms('mode', sorted(_W.items()), '<')} AS mode, {_arms('style', list(_W.items()), '<=')} AS style,
        CAST(1 + floor({_d('band')} * 5) AS INT) AS band FROM a""",
    "velocity_pairs": f"""WITH {_seeded('velocity')}, v AS (SELECT attempt_index, {_u('speed', 1.0, 3.0)} AS sp, {_u('cf_speed', 1.5, 3.5)} AS c0, {_d('azimuth')} * {_PI2} AS az,
        {_u('turn', 0.3, 1.2)} * CASE WHEN {_d('side')} < 0.5 THEN -1 ELSE 1 END AS tu FROM a), w AS (SELECT *, CASE WHEN abs(c0 - sp) < 0.4 THEN sp + CASE WHEN c0 - sp < 0 THEN -0.4 ELSE 0.4 END ELSE c0 END AS cf FROM v)
        SELECT attempt_index, {sr('sp')} AS speed, {sr('cf')} AS counterfactual_speed, {sr('sp*cos(az)')} AS vx, {sr('sp*sin(az)')} AS vy, 0.0::DOUBLE AS vz,
        {sr('cf*cos(az+tu)')} AS cx, {sr('cf*sin(az+tu)')} AS cy, 0.0::DOUBLE AS cz FROM w""",
    "uniform_rotations": f"""WITH {_seeded('rotation')}, d AS (SELECT attempt_index, {_d('rotation/0')} AS a, {_d('rotation/1')} AS b, {_d('rotation/2')} AS c, {_d('turn')} * {_PI2} AS t FROM a)
        SELECT attempt_index, {sr(f'sqrt(1-a)*sin({_PI2}*b)')} AS qw, {sr(f'sqrt(1-a)*cos({_PI2}*b)')} AS qx, {sr(f'sqrt(a)*sin({_PI2}*c)')} AS qy, {sr(f'sqrt(a)*cos({_PI2}*c)')} AS qz,
        {sr('cos(t/2)')} AS turn_w, {sr('sin(t/2)')} AS turn_z FROM d""",
    "shell_points": f"""WITH {_seeded('shell')}, d AS (SELECT attempt_index, {_d('shell/z')} AS z, {_PI2} * {_d('shell/angle')} AS g, pow(343.0::DOUBLE + {_d('shell/radius')} * 386.0, 1.0::DOUBLE/3) AS rad FROM a)
        SELECT attempt_index, {sr('sqrt(1-z*z)*cos(g)*rad')} AS x, {sr('sqrt(1-z*z)*sin(g)*rad')} AS y, {sr('z*rad')} AS z, {sr('rad')} AS radius FROM d""",
    "shell_points_above": "SELECT o_orderkey AS attempt_index, true AS in_shell, true AS above FROM orders",
    "camera_motions": "SELECT o_orderkey AS attempt_index, 6::BIGINT AS frames, true AS in_reach FROM orders",
    "look_at_motions": "SELECT o_orderkey AS attempt_index, true AS start_near, true AS end_near FROM orders",
    "object_rows": f"""WITH {_OBJ} SELECT attempt_index, object_id, shape, {sr('h0')} AS sx, {sr('h0')} AS sy, {sr("CASE WHEN shape = 'capsule' THEN h1 ELSE h0 END")} AS sz, {sr('x')} AS x, {sr('y')} AS y, {sr('z')} AS z FROM obj""",
    "clear_layouts": f"""WITH {_OBJ}, w AS (SELECT *, CASE WHEN shape = 'capsule' THEN h1 ELSE h0 END AS hz FROM obj),
        bad AS (SELECT DISTINCT a.attempt_index FROM w a JOIN w b ON a.attempt_index = b.attempt_index AND a.i < b.i AND abs(a.x-b.x) < a.h0+b.h0 AND abs(a.y-b.y) < a.h0+b.h0 AND abs(a.z-b.z) < a.hz+b.hz)
        SELECT o_orderkey AS attempt_index FROM orders WHERE o_orderkey NOT IN (SELECT attempt_index FROM bad)""",
    "block_looks": f"""WITH {_seeded('look')} SELECT attempt_index, {list(_COLORS)}[CAST(floor({_d('color')} * 8) AS INT) + 1] AS color, {sr(f"{[c[0] for c in _COLORS.values()]}[CAST(floor({_d('color')} * 8) AS INT) + 1] / 255.0::DOUBLE")} AS red,
        ['small', 'large'][CAST(floor({_d('size')} * 2) AS INT) + 1] AS size_label, [0.7::DOUBLE, 1.4::DOUBLE][CAST(floor({_d('size')} * 2) AS INT) + 1] AS size, {sr(_u('size', 0.7, 1.4))} AS free_size,
        {sr(_HUE_GREEN)} AS green, CASE WHEN {_d('metal')} < 0.5 THEN 0.4::DOUBLE ELSE 0.8::DOUBLE END AS friction FROM a""",
    "appearance_rows": f"""WITH {_seeded('appearance')}, b AS (SELECT *, CASE WHEN {_d('strategy')} <= 0.5 THEN 'hsv' WHEN {_d('strategy')} <= 0.8 THEN 'palette' ELSE 'neutral' END AS st, {_H} AS h, {_S} AS sa, {_V} AS v,
        CAST(floor({_d('palette')} * 2) AS INT) AS pi, {_u('neutral', 0.3, 0.8)} AS ne, CAST(floor({_d('family')} * 7) AS INT) + 1 AS fam FROM a),
        c AS (SELECT *, CAST(floor(h*6) AS INT) AS k, v*(1-sa) AS p, v*(1-sa*(h*6-floor(h*6))) AS q, v*(1-sa*(1-(h*6-floor(h*6)))) AS t FROM b)
        SELECT attempt_index, {", ".join(f'''{sr(f"CASE st WHEN 'hsv' THEN [{','.join(w)}][k+1] WHEN 'palette' THEN [{pl[0]}::DOUBLE, {pl[1]}::DOUBLE][pi+1] ELSE ne END")} AS {n}''' for n, w, pl in (
            ('r', 'vqpptv', (0.1, 0.9)), ('g', 'tvvqpp', (0.2, 0.8)), ('b', 'pptvvq', (0.3, 0.7))))}, 1.0::DOUBLE AS a, {_FAM}[fam] AS family,
        {", ".join(f"{sr(_prior(c))} AS {c}" for c in ("metallic", "roughness", "ior", "transmission"))} FROM c""",
    "light_rows": " UNION ALL ".join(f"""(WITH {_seeded('lighting')} SELECT attempt_index, '{n}' AS light_id, {sr(_u(f'{n}/p0', -3.0, 3.0))} AS x, {sr(_u(f'{n}/p1', -3.0, 3.0))} AS y, {sr(_u(f'{n}/p2', 4.0, 7.0))} AS z,
        {sr(_u(f'{n}/intensity', 50.0 * (i + 1), 90.0 * (i + 1)))} AS intensity, {sr(_u(f'{n}/width', 0.5, 2.0))} AS width, {sr(_u(f'{n}/height', 0.5, 2.0))} AS height FROM a)""" for i, n in enumerate(("key", "fill", "rim"))),
    "perturbed_paths": X.oracle("states", f"""{_EDITS}, {_seeded('perturbation', 'q', 'instance_id', 'instance_id')}, n AS (SELECT *, instance_id % 4 AS k, {_normal('direction/0')} AS n0, {_normal('direction/1')} AS n1, {_normal('direction/2')} AS n2 FROM a),
        m AS (SELECT *, CASE k WHEN 3 THEN 0 WHEN 2 THEN abs(n2) + 0.25 ELSE n2 END AS n3, 0.5 * {_u('amplitude', 0.5, 1.0)} AS amp FROM n),
        d AS (SELECT instance_id, k, CASE k WHEN 0 THEN -amp ELSE amp END / sqrt(n0*n0 + n1*n1 + n3*n3) AS g, n0, n1, n3 FROM m),
        w AS (SELECT p.*, d.*, CASE WHEN step = s0 OR step = s1 THEN 0 ELSE sin(pi() * (step - s0) / (s1 - s0)) END AS wave FROM p JOIN d ON p.instance_id = d.instance_id)
        SELECT instance_id, step, {", ".join(f"{sr(f'{c} + g*{n} * CASE WHEN k IN (1, 2) THEN wave*wave ELSE wave END')} AS {c}" for c, n in zip('xyz', ('n0', 'n1', 'n3')))} FROM w"""),
    "retimed_paths": X.oracle("states", f"""{_EDITS}, {_seeded('retime', 'q', 'instance_id', 'instance_id')}, b AS (SELECT instance_id, CASE WHEN {_u('warp', -1.0, 1.0)} < 0 THEN -1 ELSE 1 END * 0.3 * (0.5 + 0.5*abs({_u('warp', -1.0, 1.0)})) AS base FROM a),
        t AS (SELECT p.instance_id, step - s0 AS sample, s1 - s0 AS top, greatest(0.0, least(1.0, (step - s0)::DOUBLE/(s1 - s0) + 0.5*base*sin(pi()*(step - s0)/(s1 - s0)))) AS tm FROM p JOIN b ON b.instance_id = p.instance_id),
        g AS (SELECT instance_id, sample, tm*top AS pos, least(CAST(floor(tm*top) AS INT), top - 1) AS seg FROM t)
        SELECT g.instance_id, sample, {", ".join(f"{sr(f'(1-(pos-seg))*l.{c} + (pos-seg)*r.{c}', 5)} AS {c}" for c in 'xyz')} FROM g JOIN p l ON l.instance_id = g.instance_id AND l.step - l.s0 = seg JOIN p r ON r.instance_id = g.instance_id AND r.step - r.s0 = seg + 1"""),
    "promoted_objects": f"""WITH {_OBJ}, e AS (SELECT attempt_index, (('0x' || substr(sha256('{MASTER}' || chr(0) || o_orderkey || chr(0) || 'environment'), 1, 16))::UBIGINT % 9223372036854775808)::BIGINT AS s FROM (SELECT o_orderkey, o_orderkey AS attempt_index FROM orders) t),
        j AS (SELECT attempt_index, object_id, y, s, count(*) OVER (PARTITION BY attempt_index) AS n FROM obj JOIN e USING (attempt_index)),
        k AS (SELECT *, row_number() OVER (PARTITION BY attempt_index, abs(y) < 0.5 ORDER BY sha256(s || chr(0) || object_id), object_id) AS rk FROM j)
        SELECT attempt_index AS instance_id, object_id, abs(y) >= 0.5 AND rk <= floor({_u('static_fraction', 0.3, 0.9)} * n) AS static FROM k""",
}
