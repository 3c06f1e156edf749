"""Geometry, cameras, spatial predicates and point tracks."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import functions as F

from scenelake.functions import camera as C
from scenelake.functions import quaternions as Q
from scenelake.functions import shapes as H
from scenelake.functions import vectors as V
from scenelake.operators import pixels as P
from scenelake.operators import sampling as M
from scenelake.operators import spatial as S
from scenelake.plans import annotations as N
from scenelake.plans import tracks as T
from scenelake.queries import fixtures as X

r, sr = X.rounded, X.sql_rounded
SEED = 7


def _e(i):
    return F.col("e")[i - 1].cast("double")


def _views(spark, sf):
    """One camera per frame, posed by the numbers of its embedding."""
    raw = X.table(spark, sf, "frame_rows")
    q = F.array(*[_e(i) + 0.01 for i in range(4, 8)])
    return raw.select(
        "scene", "frame", "e", F.array(_e(1) * 10, _e(2) * 10, _e(3) + 3.0).alias("position"), Q.unit(q).alias("quaternion"),
        F.lit(35.0).alias("focal_length"), F.lit(32.0).alias("sensor_width"), F.lit(8).alias("height"), F.lit(8).alias("width"))


def _lens():
    return C.intrinsics(F.col("focal_length"), F.col("sensor_width"), F.col("width"), F.col("height"))


def projected_points(spark, sf):
    point = F.array(_e(8) * 5, _e(9) * 5, _e(10) * 5)
    return _views(spark, sf).withColumn("lens", _lens()).withColumn("image", C.project(point, F.col("position"), F.col("quaternion"), F.col("lens"))).select(
        "scene", "frame", r(F.col("image")[0], 4).alias("u"), r(F.col("image")[1], 4).alias("v"), r(F.col("image")[2]).alias("side"),
        r(C.field_of_view(F.col("focal_length"), F.col("sensor_width"))).alias("fov"))


def unprojected_points(spark, sf):
    depth = 1.0 + F.abs(_e(11)) * 10
    return _views(spark, sf).withColumn("lens", _lens()).withColumn("point", C.unproject(
        F.lit(3), F.lit(4), depth, F.lit(8), F.lit(8), F.col("position"), F.col("quaternion"), F.col("lens"))).select("scene", "frame", *X.lanes("point", "x y z", 5))


def look_at_views(spark, sf):
    """Cameras turned to the origin see it in the middle of the image, in front of them."""
    views = _views(spark, sf).withColumn("quaternion", Q.look_at(F.col("position"), V.vector(0.0, 0.0, 0.0))).withColumn("lens", _lens())
    return views.withColumn("image", C.project(V.vector(0.0, 0.0, 0.0), F.col("position"), F.col("quaternion"), F.col("lens"))).select(
        "scene", "frame", r(F.col("image")[0]).alias("u"), r(F.col("image")[1]).alias("v"), r(F.col("image")[2]).alias("side"))


def look_at_axes(spark, sf):
    """The right and up axes of cameras turned to the origin."""
    views = _views(spark, sf).withColumn("q", Q.look_at(F.col("position"), V.vector(0.0, 0.0, 0.0)))
    turned = views.select("scene", "frame", Q.rotate(F.col("q"), V.vector(1.0, 0.0, 0.0)).alias("right"), Q.rotate(F.col("q"), V.vector(0.0, 1.0, 0.0)).alias("up"))
    return turned.select("scene", "frame", *X.lanes("right", "rx ry rz"), *X.lanes("up", "ux uy uz"))


def euler_rotations(spark, sf):
    angles = [_e(i) * 4 for i in (1, 2, 3)]
    turned = X.table(spark, sf, "frame_rows").withColumn("q", Q.from_euler(*angles)).withColumn("v", Q.rotate(F.col("q"), V.vector(1.0, 2.0, 3.0)))
    back = Q.unrotate(F.col("q"), F.col("v"))
    return turned.select("scene", "frame", *X.lanes("v", "x y z"), r(V.norm(F.col("v"))).alias("length"), r(back[2]).alias("restored"))


def shape_measures(spark, sf):
    b = X.bodies(spark, sf)
    return b.select(
        "instance_id", "object_id", r(H.proxy_volume(F.col("shape"), F.col("size"))).alias("volume"), r(H.circumradius(F.col("shape"), F.col("size"))).alias("radius"),
        r(H.rotated_extents(F.col("shape"), F.col("size"), F.col("quaternion"))[0]).alias("extent_x"))


def oriented_boxes(spark, sf):
    b = X.bodies(spark, sf).withColumn("box", H.oriented_bounds(F.col("shape"), F.col("size"), F.col("position"), F.col("quaternion")))
    return b.select("instance_id", "object_id", *[r(F.col("box.lower")[i]).alias(f"low_{a}") for i, a in enumerate("xyz")],
                    *[r(F.col("box.upper")[i]).alias(f"high_{a}") for i, a in enumerate("xyz")])


def box_overlaps(spark, sf):
    b = X.bodies(spark, sf).select("instance_id", "object_id", "position", F.array(*[F.col("size")[0]] * 3).alias("extent"))
    return S.overlaps(b, cell=2.0)


def _moving(spark, sf):
    states = X.body_states(spark, sf).where("object_id = 'object_0'")
    ids = X.table(spark, sf, "state_targets").select("instance_id", "target_id", F.lit("cube").alias("shape"), V.vector(0.3, 0.2, 0.1).alias("size"))
    return states, ids


def static_clips(spark, sf):
    states, ids = _moving(spark, sf)
    solid = X.bodies(spark, sf).where("is_static").select("instance_id", "object_id", "position", F.array(*[F.col("size")[0]] * 3).alias("extent"),
                                                           (F.col("k") % 10 == 0).alias("clip_exempt"))
    return S.static_clips(states, ids, solid)


def out_of_bounds_steps(spark, sf):
    states, ids = _moving(spark, sf)
    bounds = ids.select("instance_id", V.vector(0.3, 0.3, -0.2).alias("lower"), V.vector(9.3, 8.5, 1.4).alias("upper"))
    return S.out_of_bounds(states, ids, bounds)


def swept_hits(spark, sf):
    states, _ = _moving(spark, sf)
    boxes = X.bodies(spark, sf).where("is_static").select("instance_id", "object_id", V.subtract(F.col("position"), F.array(*[F.col("size")[0]] * 3)).alias("lower"),
                                                           V.add(F.col("position"), F.array(*[F.col("size")[0]] * 3)).alias("upper"))
    closed = S.swept_hits(states.where("branch = 'factual'"), boxes, clearance=0.05)
    return closed.select("instance_id", "step", "obstacle_id")


def _walls(spark, sf):
    """Every body as a box, and one floor of a thousand units in each scene."""
    wide = lambda turn: turn(F.col("position"), F.array(*[F.col("size")[0]] * 3))
    bodies = X.bodies(spark, sf).select("instance_id", "object_id", wide(V.subtract).alias("lower"), wide(V.add).alias("upper"))
    floor = bodies.select("instance_id").distinct().select(
        "instance_id", F.lit("floor").alias("object_id"), V.vector(-500.0, -500.0, -1.0).alias("lower"), V.vector(500.0, 500.0, 0.25).alias("upper"))
    return bodies.unionByName(floor)


def swept_hits_open(spark, sf):
    """Segments of both branches through the inside of a body or of the floor; touching does not count."""
    states, _ = _moving(spark, sf)
    return S.swept_hits(states, _with_branches(_walls(spark, sf)), closed=False, keys=("instance_id", "branch")).select("instance_id", "branch", "step", "obstacle_id")


def _with_branches(boxes):
    return boxes.withColumn("branch", F.explode(F.array(F.lit("factual"), F.lit("counterfactual"))))


def blocked_paths(spark, sf):
    """Rules broken by each path among the bodies of its scene."""
    states, _ = _moving(spark, sf)
    keys = ("instance_id", "branch")
    walls = _with_branches(X.bodies(spark, sf).where("is_static").select(
        "instance_id", "object_id", V.subtract(F.col("position"), F.array(*[F.col("size")[0]] * 3)).alias("lower"), V.add(F.col("position"), F.array(*[F.col("size")[0]] * 3)).alias("upper")))
    return S.path_violations(states.select(*keys, "step", "position"), boxes=walls, clearance=0.02, keys=keys)


def camera_framing(spark, sf):
    b = X.bodies(spark, sf)
    targets = b.select("instance_id", F.explode(H.corner_targets(F.col("position"), H.circumradius(F.col("shape"), F.col("size")))).alias("target"))
    cameras = b.select(
        "instance_id", F.col("object_id").alias("camera"), F.array(F.col("position")[0] + 10, F.col("position")[1] - 8, F.col("position")[2] + 4).alias("position"),
        V.vector(5.0, 4.5, 1.0).alias("look_at"), (F.lit(14.0) + F.col("k") % 12).alias("focal_length"), F.lit(36.0).alias("sensor_width"), F.lit(1.5).alias("aspect"))
    return S.framing(cameras, targets, 0.05)


def coarse_framing(spark, sf):
    b = X.bodies(spark, sf)
    cameras = b.select("instance_id", F.col("object_id").alias("camera"), F.array(F.col("position")[0] + 16, F.col("position")[1] - 9, F.col("position")[2] + 4).alias("position"),
                       V.vector(5.0, 4.5, 1.0).alias("look_at"))
    scenes = b.select("instance_id").distinct().select("instance_id", V.vector(0.0, 0.0, 0.0).alias("lower"), V.vector(11.0, 9.0, 2.0).alias("upper"))
    return S.coarse_camera_fit(cameras, scenes, 0.6)


def hidden_points(spark, sf):
    raw = X.table(spark, sf, "frame_rows")
    each = raw.select("scene", "frame", "e", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    at = lambda shift: F.col("e")[F.col("i") + shift].cast("double")
    points = each.select("scene", "frame", F.col("i").alias("point"), (F.abs(at(0)) * 30).alias("px"), (F.abs(at(19)) * 30).alias("py"),
                         (1.0 + F.abs(at(29)) * 10).alias("limit"), F.col("i").alias("label"))
    return P.with_hidden(points, X.frames(spark, sf)).select("scene", "frame", "point", "hidden")


def _objects(spark, sf):
    """Five boxes per scene and frame, placed by the frame's embedding."""
    raw = X.table(spark, sf, "frame_rows")
    each = raw.select("scene", "frame", "e", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("object_index"))
    at = lambda shift: F.col("e")[F.col("object_index") * 7 + shift].cast("double")
    posed = each.select("scene", "frame", "object_index", F.array(at(0) * 8, at(1) * 8, at(2) + 1.0).alias("position"),
                        Q.unit(F.array(at(3) + 0.01, at(4), at(5), at(6))).alias("quaternion"))
    half = V.vector(0.5, 0.4, 0.3)
    return posed.withColumn("corners", H.box_corners(F.col("position"), F.col("quaternion"), V.scale(half, -1.0), half))


def box_local_points(spark, sf):
    world = _objects(spark, sf).withColumn("world", T.box_to_world(V.vector(0.25, -0.5, 0.1), F.col("corners")))
    return world.select("scene", "frame", "object_index", *X.lanes("world", "x y z"))


def grid_samples(spark, sf):
    scenes = X.frames(spark, sf).select("scene").distinct().select("scene", F.array(*[F.lit(v) for v in (0, 1, 8, 8)]).alias("window"))
    return M.on_grid(X.frames(spark, sf), M.grid_starts(scenes, 2, SEED), 2, ("segmentation",))


def sample_quotas(spark, sf):
    counts = P.segment_histogram(P.to_pixels(X.frames(spark, sf)))
    return M.quotas(counts, 300, 0.15)


def crop_windows(spark, sf):
    scenes = X.frames(spark, sf).select("scene").distinct().select("scene", F.lit(64).alias("height"), F.lit(96).alias("width"))
    cropped = M.crop_windows(scenes, SEED)
    w = F.col("window")
    return cropped.select("scene", (w[2] - w[0]).alias("rows"), (w[3] - w[1]).alias("columns"), w[0].alias("top"), w[1].alias("left"))


def _video(spark, sf):
    normal = F.flatten(F.transform("e", lambda v: F.array(v, F.abs(v), 1.0 - F.abs(v))))
    code = F.transform("e", lambda v: F.floor(F.abs(v) * 60000).cast("int"))
    return X.frames(spark, sf).withColumns({
        "normal": normal, "object_coordinates": F.flatten(F.transform(code, lambda v: F.array(v, 65535 - v, v)))})


def point_tracks(spark, sf):
    """Tracks of 32 sampled points per scene through all its frames."""
    windows = X.frames(spark, sf).groupBy("scene").agg((F.max("frame") + 1).alias("frame_count")).withColumn("window", F.array(*[F.lit(v) for v in (0, 0, 8, 8)]))
    tracks = T.track_table(_video(spark, sf), _views(spark, sf).drop("e"), _objects(spark, sf), windows, tracks=32, stride=2, seed=SEED)
    return tracks.select("scene", "point", "frame", "label", "query_t", r(F.col("query_y")).alias("query_y"), r(F.col("query_x")).alias("query_x"),
                         r(F.col("target_x"), 3).alias("target_x"), r(F.col("target_y"), 3).alias("target_y"), "occluded", r(F.col("relative_depth"), 4).alias("relative_depth"))


def snapped_tracks(spark, sf):
    """Occluded share of tracks sampled away from depth edges, with random crops and output scaling."""
    scenes = X.frames(spark, sf).groupBy("scene").agg((F.max("frame") + 1).alias("frame_count")).withColumns({"height": F.lit(8), "width": F.lit(8)})
    windows = M.crop_windows(scenes, SEED).drop("height", "width")
    tracks = T.track_table(_video(spark, sf), _views(spark, sf).drop("e"), _objects(spark, sf), windows, tracks=16, stride=1, snap=True,
                           train_size=(256, 256), flip=True, seed=SEED)
    return tracks.groupBy("scene").agg(F.count("*").alias("rows"), F.count_if("occluded").alias("occluded"), r(F.min("query_y"), 3).alias("top"))


def padded_points(spark, sf):
    """Each scene's labels padded to eight rows."""
    listed = X.table(spark, sf, "scene_instances").select("scene", F.when(F.col("label") == 9, 4).otherwise(F.col("label") - 1).alias("position"), "label")
    return M.pad(listed, 8, ["scene"])


def scene_boundaries(spark, sf):
    regions = X.bodies(spark, sf).select("instance_id", "object_id", F.col("position").alias("lower"), V.add(F.col("position"), F.col("size")).alias("upper"),
                                         F.when(F.col("k") % 2 == 0, F.col("position")[2]).otherwise(F.lit(0.0)).alias("floor_top"))
    return S.scene_boundaries(regions).select("instance_id", "object_id", *X.lanes("boundary_lower", "low_x low_y low_z"), *X.lanes("boundary_upper", "high_x high_y high_z"), "floor_matches")


def scene_metadata(spark, sf):
    """Frames, visibility side and height of every object over its scene."""
    poses = _objects(spark, sf)
    listed = poses.select("scene", "object_index").distinct().select("*", F.array(V.vector(-0.5, -0.5, -0.5), V.vector(0.5, 0.5, 0.5)).alias("bounds"), V.vector(1.0, 0.8, 0.6).alias("scale"))
    shown = N.instance_frames(poses.drop("corners"), _views(spark, sf), listed)
    return shown.groupBy("scene", "object_index").agg(
        (F.max("frame") - F.min("frame") + 1).alias("num_frames"), F.count_if("in_front").alias("in_front"),
        r(F.max(F.col("position")[2]), 5).alias("top"))


def shrunk_layers(spark, sf):
    """Two layers of every frame at half size: one averaged, one picked."""
    label = X.frames(spark, sf).select("scene", "frame", "height", "width", F.lit(1).alias("channels"), F.col("segmentation").alias("values"))
    both = label.withColumn("layer", F.explode(F.array(F.lit("rgba"), F.lit("segmentation"))))
    small = N.layers_at(both, 4).select("scene", "layer", "frame", F.posexplode("values").alias("at", "value"))
    return small.groupBy("scene", "layer", "frame").agg(F.count("*").alias("pixel_count"), F.sum(F.col("value") * (F.col("at") + 1)).alias("weighted"))


QUERIES = {f.__name__: f for f in (
    projected_points, unprojected_points, look_at_views, look_at_axes, euler_rotations, shape_measures, oriented_boxes, box_overlaps, static_clips, out_of_bounds_steps,
    swept_hits, swept_hits_open, blocked_paths, camera_framing, coarse_framing, hidden_points, box_local_points, grid_samples, sample_quotas, crop_windows, point_tracks, snapped_tracks,
    padded_points, scene_boundaries, scene_metadata, shrunk_layers,
)}


def _matrix(q: str = "q") -> list[list[str]]:
    w, x, y, z = (f"{q}{c}" for c in "wxyz")
    return [[f"(1 - 2*({y}*{y} + {z}*{z}))", f"(2*({x}*{y} - {z}*{w}))", f"(2*({x}*{z} + {y}*{w}))"],
            [f"(2*({x}*{y} + {z}*{w}))", f"(1 - 2*({x}*{x} + {z}*{z}))", f"(2*({y}*{z} - {x}*{w}))"],
            [f"(2*({x}*{z} - {y}*{w}))", f"(2*({y}*{z} + {x}*{w}))", f"(1 - 2*({x}*{x} + {y}*{y}))"]]


def _turn(v: list[str], q: str = "q", inverse: bool = False) -> list[str]:
    m = _matrix(q)
    return [" + ".join(f"{m[j][i] if inverse else m[i][j]} * ({v[j]})" for j in range(3)) for i in range(3)]


VIEWS = """raw AS (SELECT scene, frame, e, e[1]::DOUBLE * 10 AS cx, e[2]::DOUBLE * 10 AS cy, e[3]::DOUBLE + 3.0 AS cz,
    e[4]::DOUBLE + 0.01::DOUBLE AS a, e[5]::DOUBLE + 0.01::DOUBLE AS b, e[6]::DOUBLE + 0.01::DOUBLE AS c, e[7]::DOUBLE + 0.01::DOUBLE AS d FROM frame_rows),
    views AS (SELECT *, a/n AS qw, b/n AS qx, c/n AS qy, d/n AS qz FROM (SELECT *, sqrt(a*a + b*b + c*c + d*d) AS n FROM raw) t)"""


def _projection(point: list[str]) -> str:
    local = _turn([f"{p} - {c}" for p, c in zip(point, ("cx", "cy", "cz"))], inverse=True)
    return f"{local[0]} AS lx, {local[1]} AS ly, {local[2]} AS lz"


F0 = "(35.0::DOUBLE / 32.0)"
U, W = f"({F0} * lx - 0.5 * lz) / (-lz)", f"(-{F0} * ly - 0.5 * lz) / (-lz)"
SIZE = "CASE WHEN shape IN ('cylinder', 'capsule') THEN sz ELSE sx END"
OBJECTS = """things AS (SELECT scene, frame, o, e[o*7+1]::DOUBLE * 8 AS x, e[o*7+2]::DOUBLE * 8 AS y, e[o*7+3]::DOUBLE + 1.0 AS z,
    e[o*7+4]::DOUBLE + 0.01::DOUBLE AS a, e[o*7+5]::DOUBLE AS b, e[o*7+6]::DOUBLE AS c, e[o*7+7]::DOUBLE AS d FROM frame_rows, range(0, 5) t(o)),
    posed AS (SELECT *, a/n AS qw, b/n AS qx, c/n AS qy, d/n AS qz FROM (SELECT *, sqrt(a*a + b*b + c*c + d*d) AS n FROM things) t)"""
YAWED = f"""solid AS (SELECT *, cos(yaw/2) AS qw, 0.0 AS qx, 0.0 AS qy, sin(yaw/2) AS qz, {SIZE} AS hz0, CASE WHEN shape = 'capsule' THEN sz + sx ELSE {SIZE} END AS hz FROM boxes)"""


def _draw(seed: str, lane: str) -> str:
    return f"(('0x' || substr(sha256({seed}::VARCHAR || ':' || '{lane}'), 1, 14))::BIGINT / 72057594037927936.0)"


def _seed(*parts: str) -> str:
    text = " || chr(0) || ".join(f"({p})::VARCHAR" for p in parts)
    return f"(('0x' || substr(sha256({text}), 1, 16))::UBIGINT % 9223372036854775808)::BIGINT"


def _bounds(axis: int) -> tuple[str, str]:
    corners = [_turn([f"{s[0]} * sx", f"{s[1]} * sx", f"{s[2]} * hz"])[axis] for s in itertools.product((-1, 1), repeat=3)]
    place = "xyz"[axis]
    return (f"least({', '.join(corners)}) + {place}", f"greatest({', '.join(corners)}) + {place}")


MOVING = """mover AS (SELECT * FROM states WHERE object_id = 'object_0'),
    reach AS (SELECT *, {x} AS ex, {y} AS ey, {z} AS ez FROM mover)""".format(**{
    a: " + ".join(f"abs({_matrix()[i][j]}) * {h}" for j, h in enumerate((0.3, 0.2, 0.1))) for i, a in enumerate("xyz")})


def _hit(axis: str, wide: float = 0.05, box: tuple[str, str] | None = None, strict: bool = False) -> str:
    low, high = (f"({side})" for side in box) if box else (f"(o.{axis} - o.sx - {wide})", f"(o.{axis} + o.sx + {wide})")
    out = "=" if strict else ""
    return (f"CASE WHEN m.n{axis} = m.{axis} THEN 0.0 ELSE least(({low} - m.{axis}) / (m.n{axis} - m.{axis}), ({high} - m.{axis}) / (m.n{axis} - m.{axis})) END",
            f"CASE WHEN m.n{axis} = m.{axis} THEN 1.0 ELSE greatest(({low} - m.{axis}) / (m.n{axis} - m.{axis}), ({high} - m.{axis}) / (m.n{axis} - m.{axis})) END",
            f"(m.n{axis} = m.{axis} AND (m.{axis} <{out} {low} OR m.{axis} >{out} {high}))")


HITS = [_hit(a) for a in "xyz"]
INSIDE = [_hit(a, box=(f"o.low_{a}", f"o.high_{a}"), strict=True) for a in "xyz"]
NEAR = [_hit(a, 0.02) for a in "xyz"]
STEPS = """p AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(z) OVER w AS nz FROM states WHERE object_id = 'object_0'
    WINDOW w AS (PARTITION BY instance_id, branch ORDER BY step))"""
FWD = "sqrt((lx-px)**2 + (ly-py)**2 + (lz-pz)**2)"

ORACLES = {
    "projected_points": X.oracle("frame_rows", f"""{VIEWS}, l AS (SELECT scene, frame, {_projection([f'(e[{i}]::DOUBLE * 5)' for i in (8, 9, 10)])} FROM views)
        SELECT scene, frame, {sr(U, 4)} AS u, {sr(W, 4)} AS v, {sr('sign(-lz)')} AS side, {sr('2 * atan2(16.0, 35.0)')} AS fov FROM l"""),
    "unprojected_points": X.oracle("frame_rows", f"""{VIEWS}, k AS (SELECT *, (1.0 + abs(e[11]::DOUBLE) * 10) / sqrt(rx*rx + ry*ry + 1) AS s FROM
        (SELECT *, (3.5/8 - 0.5)::DOUBLE / {F0} AS rx, (4.5/8 - 0.5)::DOUBLE / -{F0} AS ry FROM views) t)
        SELECT scene, frame, {", ".join(f"{sr(f'{t} + {c}', 5)} AS {n}" for t, c, n in zip(_turn(['rx*s', 'ry*s', '-s']), ('cx', 'cy', 'cz'), 'xyz'))} FROM k"""),
    "look_at_views": "SELECT CAST(vec_id // 25 AS INT) AS scene, CAST(vec_id % 25 AS INT) AS frame, 0.5::DOUBLE AS u, 0.5::DOUBLE AS v, 1.0::DOUBLE AS side FROM embeddings",
    "look_at_axes": X.oracle("frame_rows", f"""{VIEWS}, f AS (SELECT scene, frame, -cx/n AS fx, -cy/n AS fy, -cz/n AS fz FROM (SELECT scene, frame, cx, cy, cz, sqrt(cx*cx + cy*cy + cz*cz) AS n FROM views) t),
        h AS (SELECT *, sqrt(fx*fx + fy*fy) AS h FROM f) SELECT scene, frame, {sr("fy/h")} AS rx, {sr("-fx/h")} AS ry, {sr("0.0::DOUBLE")} AS rz,
        {sr("-fz*fx/h")} AS ux, {sr("-fz*fy/h")} AS uy, {sr("h")} AS uz FROM h"""),
    "euler_rotations": X.oracle("frame_rows", f"""a AS (SELECT scene, frame, e[1]::DOUBLE*4 AS p, e[2]::DOUBLE*4 AS q, e[3]::DOUBLE*4 AS s FROM frame_rows),
        rx AS (SELECT *, 1.0::DOUBLE AS x1, 2*cos(p) - 3*sin(p) AS y1, 2*sin(p) + 3*cos(p) AS z1 FROM a), ry AS (SELECT *, x1*cos(q) + z1*sin(q) AS x2, y1 AS y2, -x1*sin(q) + z1*cos(q) AS z2 FROM rx)
        SELECT scene, frame, {sr('x2*cos(s) - y2*sin(s)')} AS x, {sr('x2*sin(s) + y2*cos(s)')} AS y, {sr('z2')} AS z, {sr('sqrt(14.0::DOUBLE)')} AS length, 3.0::DOUBLE AS restored FROM ry"""),
    "shape_measures": X.oracle("boxes", f"""{YAWED} SELECT instance_id, object_id, {sr('''CASE shape WHEN 'cube' THEN 8*sx*sx*sx WHEN 'sphere' THEN 4.0/3.0*pi()*sx**3
        WHEN 'cylinder' THEN pi()*sx*sx*2*sz ELSE pi()*sx*sx*2*sz + 4.0/3.0*pi()*sx**3 END''')} AS volume, {sr("CASE WHEN shape = 'sphere' THEN sx ELSE sqrt(2*sx*sx + hz*hz) END")} AS radius,
        {sr("CASE WHEN shape = 'sphere' THEN sx ELSE abs(cos(yaw))*sx + abs(sin(yaw))*sx END")} AS extent_x FROM solid"""),
    "oriented_boxes": X.oracle("boxes", f"""{YAWED} SELECT instance_id, object_id, {", ".join(f"{sr(_bounds(i)[0])} AS low_{a}, {sr(_bounds(i)[1])} AS high_{a}" for i, a in enumerate('xyz'))} FROM solid"""),
    "box_overlaps": X.oracle("boxes", """SELECT a.instance_id, a.object_id AS object_a, b.object_id AS object_b FROM boxes a JOIN boxes b ON a.instance_id = b.instance_id AND a.object_id < b.object_id
        AND abs(a.x-b.x) < a.sx+b.sx AND abs(a.y-b.y) < a.sx+b.sx AND abs(a.z-b.z) < a.sx+b.sx"""),
    "static_clips": X.oracle("states boxes", f"""{MOVING} SELECT m.instance_id, branch, step, o.object_id AS obstacle_id FROM reach m JOIN boxes o USING (instance_id) WHERE is_static AND k % 10 <> 0
        AND ex + sx - abs(m.x - o.x) > 1e-9 AND ey + sx - abs(m.y - o.y) > 1e-9 AND ez + sx - abs(m.z - o.z) > 1e-9"""),
    "out_of_bounds_steps": X.oracle("states", f"""{MOVING} SELECT instance_id, branch, step FROM reach WHERE x-ex < 0.3-1e-9 OR y-ey < 0.3-1e-9 OR z-ez < -0.2-1e-9
        OR x+ex > 9.3+1e-9 OR y+ey > 8.5+1e-9 OR z+ez > 1.4+1e-9"""),
    "swept_hits": X.oracle("states boxes", f"""p AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(z) OVER w AS nz FROM states WHERE object_id = 'object_0' AND branch = 'factual'
        WINDOW w AS (PARTITION BY instance_id ORDER BY step)) SELECT m.instance_id, m.step, o.object_id AS obstacle_id FROM p m JOIN boxes o USING (instance_id) WHERE nx IS NOT NULL AND is_static
        AND greatest(0.0, {", ".join(h[0] for h in HITS)}) <= least(1.0, {", ".join(h[1] for h in HITS)}) AND NOT ({" OR ".join(h[2] for h in HITS)})"""),
    "swept_hits_open": X.oracle("states boxes", f"""{STEPS}, walls AS (SELECT instance_id, object_id, {", ".join(f"{a} - sx AS low_{a}, {a} + sx AS high_{a}" for a in "xyz")} FROM boxes
        UNION ALL SELECT DISTINCT instance_id, 'floor', -500.0, 500.0, -500.0, 500.0, -1.0, 0.25 FROM boxes)
        SELECT m.instance_id, m.branch, m.step, o.object_id AS obstacle_id FROM p m JOIN walls o USING (instance_id) WHERE nx IS NOT NULL
        AND greatest(0.0, {", ".join(h[0] for h in INSIDE)}) < least(1.0, {", ".join(h[1] for h in INSIDE)}) AND NOT ({" OR ".join(h[2] for h in INSIDE)})"""),
    "blocked_paths": X.oracle("states boxes", f"""{STEPS} SELECT DISTINCT m.instance_id, m.branch, 'hits_static' AS code FROM p m JOIN boxes o USING (instance_id) WHERE nx IS NOT NULL AND is_static
        AND greatest(0.0, {", ".join(h[0] for h in NEAR)}) <= least(1.0, {", ".join(h[1] for h in NEAR)}) AND NOT ({" OR ".join(h[2] for h in NEAR)})
        UNION ALL SELECT instance_id, branch, 'too_short' FROM states WHERE object_id = 'object_0' GROUP BY ALL HAVING count(*) < 2"""),
    "camera_framing": X.oracle("boxes", f"""{YAWED}, cam AS (SELECT instance_id, object_id AS camera, x+10 AS px, y-8 AS py, z+4 AS pz, 5.0::DOUBLE AS lx, 4.5::DOUBLE AS ly, 1.0::DOUBLE AS lz, 14.0::DOUBLE + k % 12 AS f
        FROM boxes), ax AS (SELECT *, (lx-px)/{FWD} AS fx, (ly-py)/{FWD} AS fy, (lz-pz)/{FWD} AS fz FROM cam),
        ay AS (SELECT *, fy/sqrt(fx*fx+fy*fy) AS rx, -fx/sqrt(fx*fx+fy*fy) AS ry FROM ax),
        s AS (SELECT unnest([-1,-1,-1,-1,1,1,1,1]) AS a, unnest([-1,-1,1,1,-1,-1,1,1]) AS b, unnest([-1,1,-1,1,-1,1,-1,1]) AS c),
        t AS (SELECT instance_id, x + a*rad AS tx, y + b*rad AS ty, z + c*rad AS tz FROM (SELECT *, CASE WHEN shape = 'sphere' THEN sx ELSE sqrt(2*sx*sx + hz*hz) END AS rad FROM solid) o, s),
        j AS (SELECT camera, f, ay.instance_id, (tx-px)*fx + (ty-py)*fy + (tz-pz)*fz AS depth, (tx-px)*rx + (ty-py)*ry AS h, (tx-px)*(ry*fz) + (ty-py)*(-rx*fz) + (tz-pz)*(rx*fy - ry*fx) AS v
        FROM ay JOIN t USING (instance_id))
        SELECT instance_id, camera, bool_and(depth > 1e-3 AND abs(h)/depth <= 18.0/f*0.95 AND abs(v)/depth <= 18.0/f/1.5*0.95) AS frames_all, count(*) AS target_count FROM j GROUP BY ALL"""),
    "coarse_framing": X.oracle("boxes", f"""cam AS (SELECT instance_id, object_id AS camera, x+16 AS px, y-9 AS py, z+4 AS pz, 5.0::DOUBLE AS lx, 4.5::DOUBLE AS ly, 1.0::DOUBLE AS lz FROM boxes),
        ax AS (SELECT *, (lx-px)/{FWD} AS fx, (ly-py)/{FWD} AS fy, (lz-pz)/{FWD} AS fz FROM cam), ay AS (SELECT *, -fy/sqrt(fx*fx+fy*fy) AS rx, fx/sqrt(fx*fx+fy*fy) AS ry FROM ax),
        c AS (SELECT a*11.0 AS tx, b*9.0 AS ty, d*2.0 AS tz FROM range(0,2) t1(a), range(0,2) t2(b), range(0,2) t3(d)),
        j AS (SELECT instance_id, camera, (tx-px)*fx + (ty-py)*fy + (tz-pz)*fz AS depth, (tx-px)*rx + (ty-py)*ry AS h, (tx-px)*(-fz*ry) + (ty-py)*(fz*rx) + (tz-pz)*(fx*ry - fy*rx) AS v FROM ay, c)
        SELECT instance_id, camera, bool_and(depth > 0 AND abs(h) <= depth*0.6 AND abs(v) <= depth*0.6) AS fits FROM j GROUP BY ALL"""),
    "hidden_points": X.oracle("frame_rows", f"""{X.PIXELS}, pt AS (SELECT scene, frame, CAST(i AS INT) AS point, abs(e[i+1]::DOUBLE)*30 AS px, abs(e[i+20]::DOUBLE)*30 AS py, 1.0 + abs(e[i+30]::DOUBLE)*10 AS lim FROM frame_rows, range(0, 4) t(i)),
        n AS (SELECT pt.*, greatest(0, least(7, CAST(floor(px-0.5) AS INT) + a)) AS x, greatest(0, least(7, CAST(floor(py-0.5) AS INT) + b)) AS y FROM pt, range(0,2) t1(a), range(0,2) t2(b))
        SELECT n.scene, n.frame, point, max(depth) < any_value(lim) OR bool_and(segmentation <> point) AS hidden FROM n JOIN pixels p ON p.scene = n.scene AND p.frame = n.frame AND p.x = n.x AND p.y = n.y GROUP BY ALL"""),
    "box_local_points": X.oracle("frame_rows", f"""{OBJECTS} SELECT scene, frame, CAST(o AS INT) AS object_index, {", ".join(f"{sr(f'{t} + {a}')} AS {a}" for t, a in zip(_turn(['0.25', '-0.4', '0.06']), 'xyz'))} FROM posed"""),
    "grid_samples": X.oracle("frame_rows", f"""{X.PIXELS}, g AS (SELECT scene, CAST(floor({_draw('s', 't')}*2) AS INT) AS t0, CAST(floor({_draw('s', 'y')}*2) AS INT) AS y0, 1 + CAST(floor({_draw('s', 'x')}*2) AS INT) AS x0
        FROM (SELECT DISTINCT scene, {_seed('7', 'scene', "'grid'")} AS s FROM frame_rows) t)
        SELECT scene, frame, y, x, segmentation FROM pixels JOIN g USING (scene) WHERE frame >= t0 AND (frame - t0) % 2 = 0 AND y >= y0 AND (y - y0) % 2 = 0 AND x >= x0 AND (x - x0) % 2 = 0"""),
    "sample_quotas": X.oracle("frame_rows", f"""{X.PIXELS}, c AS (SELECT scene, CAST(l AS INT) AS label, (SELECT count(*) FROM pixels p WHERE p.scene = s.scene AND p.segmentation = l) AS n
        FROM (SELECT scene, max(segmentation) AS top FROM pixels GROUP BY ALL) s, range(0, 6) t(l) WHERE l <= top),
        o AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY n, label) AS i, count(*) OVER (PARTITION BY scene) AS k FROM c),
        w AS (SELECT scene, 0::BIGINT AS i, 300 AS remaining, -1 AS label, 0 AS quota FROM (SELECT DISTINCT scene FROM c) t
        UNION ALL SELECT w.scene, o.i, w.remaining - q, o.label, q FROM (SELECT w.scene AS ws, w.i AS wi, o.*, w.remaining AS rem,
            least(CAST(round_even(w.remaining::FLOAT * (1.0 / (o.k - o.i + 1))::FLOAT, 0) AS INT), CAST(round_even(o.n::FLOAT * 0.15::FLOAT, 0) AS INT)) AS q FROM w JOIN o ON o.scene = w.scene AND o.i = w.i + 1) z
            JOIN w ON w.scene = z.ws AND w.i = z.wi JOIN o ON o.scene = z.scene AND o.i = z.i) SELECT scene, label, quota FROM w WHERE label >= 0"""),
    "padded_points": X.oracle("scene_instances", """l AS (SELECT scene, label FROM scene_instances) SELECT scene, CAST(p AS INT) AS position,
        CAST(CASE WHEN p < 4 THEN p + 1 WHEN p = 4 THEN 9 ELSE 4 END AS INT) AS label FROM (SELECT DISTINCT scene FROM l) t, range(0, 8) u(p)"""),
    "scene_boundaries": X.oracle("boxes", f"""{YAWED} SELECT instance_id, object_id, {sr('x-0.1')} AS low_x, {sr('y-0.1')} AS low_y, {sr('z-0.1')} AS low_z, {sr('x+sx+0.1')} AS high_x, {sr('y+sx+0.1')} AS high_y,
        {sr('z+hz0+0.1')} AS high_z, k % 2 = 0 OR abs(z) <= 1e-8 + 1e-5*abs(z) AS floor_matches FROM solid"""),
    "scene_metadata": X.oracle("frame_rows", f"""{VIEWS}, {OBJECTS}, l AS (SELECT scene, frame, o, z, {_turn(['x - cx', 'y - cy', 'z - cz'], 'v', True)[2]} AS lz FROM
        (SELECT p.scene, p.frame, o, x, y, z, cx, cy, cz, v.qw AS vw, v.qx AS vx, v.qy AS vy, v.qz AS vz FROM posed p JOIN views v USING (scene, frame)) t)
        SELECT scene, CAST(o AS INT) AS object_index, max(frame) - min(frame) + 1 AS num_frames, count(*) FILTER (lz < 0) AS in_front, {sr('max(z)', 5)} AS top FROM l GROUP BY ALL"""),
    "shrunk_layers": X.oracle("frame_rows", f"""{X.PIXELS}, s AS (SELECT scene, 'segmentation' AS layer, frame, y // 2 AS y, x // 2 AS x, segmentation AS v FROM pixels WHERE y % 2 = 0 AND x % 2 = 0
        UNION ALL SELECT scene, 'rgba', frame, y // 2, x // 2, CAST(round_even(avg(segmentation), 0) AS INT) FROM pixels GROUP BY scene, frame, y // 2, x // 2)
        SELECT scene, layer, frame, count(*) AS pixel_count, CAST(sum(v * (y * 4 + x + 1)) AS BIGINT) AS weighted FROM s GROUP BY ALL"""),
    "crop_windows": X.oracle("frame_rows", f"""g AS (SELECT DISTINCT scene, {_seed('7', 'scene', "'crop'")} AS o, ln(96.0::DOUBLE / 64) AS shape FROM frame_rows),
        b AS (SELECT *, greatest({math.log(0.5)!r}::DOUBLE, shape + {math.log(0.3)!r}::DOUBLE) AS low, least({math.log(2.0)!r}::DOUBLE, shape - {math.log(0.3)!r}::DOUBLE) AS high FROM g),
        u AS (SELECT *, low + {_draw('o', '1')} * (high - low) AS slant FROM b),
        d AS (SELECT *, sqrt((0.3::DOUBLE + {_draw('o', '0')} * (least(1.0::DOUBLE, exp(shape - slant), exp(slant - shape)) - 0.3::DOUBLE)) * 64 * 96 / exp(slant)) AS tall FROM u),
        f AS (SELECT *, CAST(least(64, greatest(1, round_even(tall, 0))) AS INT) AS h, CAST(least(96, greatest(1, round_even(tall * exp(slant), 0))) AS INT) AS w FROM d)
        SELECT scene, h AS rows, w AS columns, CAST(floor({_draw('o', '2')}*(64-h+1)) AS INT) AS top, CAST(floor({_draw('o', '3')}*(96-w+1)) AS INT) AS left_edge FROM f""".replace("AS left_edge", 'AS "left"')),
}
