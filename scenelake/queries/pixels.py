"""Pixel layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenelake.functions import camera as C
from scenelake.functions import raster as R
from scenelake.operators import pixels as P
from scenelake.queries import fixtures as X

r, sr = X.rounded, X.sql_rounded


def _listed(spark, sf):
    return X.table(spark, sf, "scene_instances")


def visibility(spark, sf):
    return P.visibility(X.frames(spark, sf), _listed(spark, sf))


def visible_labels(spark, sf):
    return P.visible_labels(P.visibility(X.frames(spark, sf), _listed(spark, sf)))


def normalised_boxes(spark, sf):
    return P.normalised_boxes(X.frames(spark, sf), _listed(spark, sf))


def tracking_boxes(spark, sf):
    return P.tracking_boxes(X.frames(spark, sf), _listed(spark, sf))


def segment_histogram(spark, sf):
    pixels = P.to_pixels(X.frames(spark, sf)).withColumn("segmentation", F.col("segmentation") - 1)
    return P.segment_histogram(pixels)


def _mapping(spark, sf):
    """Assets 0 to 4 per scene; asset 1 has its own id, assets 3 and 2 form the new list."""
    scenes = X.table(spark, sf, "frame_rows").select("scene").distinct()
    numbered = scenes.select("scene", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("position"))
    old = numbered.select("scene", "position", F.concat(F.lit("asset_"), F.col("position").cast("string")).alias("asset"),
                          F.when(F.col("position") == 1, 77).alias("segmentation_id"))
    new = scenes.select("scene", F.explode(F.array(F.struct(F.lit(0).alias("position"), F.lit("asset_3").alias("asset")),
                                                   F.struct(F.lit(1).alias("position"), F.lit("asset_2").alias("asset")))).alias("_n")).select("scene", "_n.*")
    return P.label_map(old, new, ignored=99)


def remapped_labels(spark, sf):
    remapped = P.remap_labels(X.frames(spark, sf), _mapping(spark, sf))
    return P.to_pixels(remapped).groupBy("scene", "frame", "segmentation").agg(F.count("*").alias("pixel_count"), F.sum("x").alias("x_sum"))


def layer_ranges(spark, sf):
    return P.layer_ranges(X.frames(spark, sf), "e", scale=2.0).select("scene", r(F.col("low")).alias("low"), r(F.col("high")).alias("high"))


def encoded_layer(spark, sf):
    """Codes of depths over a scene's own range; the smallest and largest code are exact."""
    encoded = P.encode_layer(X.frames(spark, sf), "depth")
    return encoded.groupBy("scene").agg(F.min(F.array_min("depth")).alias("low_code"), F.max(F.array_max("depth")).alias("high_code"),
                                        F.sum(F.aggregate("depth", F.lit(0), lambda a, c: a + c)).alias("code_sum"))


def quantised_depth(spark, sf):
    pixels = P.to_pixels(X.frames(spark, sf), ("depth", "segmentation"))
    code = R.quantise(F.col("depth"), F.lit(1.0), F.lit(9.0))
    back = R.dequantise(code, F.lit(1.0), F.lit(9.0))
    wrong = R.rescale(code, F.lit(16), F.lit(1.0), F.lit(9.0))
    return pixels.groupBy("scene", "frame").agg(
        F.sum(code).alias("code_sum"), r(F.max(F.abs(back - F.col("depth"))), 3).alias("worst"), r(F.sum(wrong), 4).alias("rescaled"),
        F.sum(R.to_eight_bit(code)).alias("eight_bit"))


def encoded_normals(spark, sf):
    pixels = P.to_pixels(X.frames(spark, sf), ("e", "segmentation"))
    return pixels.groupBy("scene", "frame").agg(F.sum(R.encode_normal(F.col("e") * 3)).alias("normal_sum"), F.sum(R.encode_unit(F.col("e"))).alias("unit_sum"),
                                                r(F.max(R.decode_normal(R.encode_normal(F.col("e"))))).alias("decoded"))


def processed_layers(spark, sf):
    pixels = P.to_pixels(X.frames(spark, sf), ("e", "segmentation")).withColumn(
        "layer", F.array(*[F.lit(n) for n in ("uv", "normal", "object_coordinates", "z", "rgba", "other")])[F.col("segmentation")])
    return pixels.groupBy("scene", "layer").agg(r(F.sum(R.process_layer(F.col("layer"), F.col("e"))), 3).alias("value"))


def subsampled_nearest(spark, sf):
    return P.subsample_nearest(P.to_pixels(X.frames(spark, sf)), 4, 2)


def subsampled_average(spark, sf):
    return P.subsample_average(P.to_pixels(X.frames(spark, sf)), "segmentation", 4, 2)


def multi_resolution(spark, sf):
    return P.multi_resolution(P.to_pixels(X.frames(spark, sf)), (1, 2, 4)).groupBy("scene", "frame", "factor").agg(
        F.count("*").alias("pixel_count"), F.sum(F.col("segmentation") * (F.col("y") * 8 + F.col("x") + 1)).alias("check"))


def exported_flow(spark, sf):
    pixels = P.to_pixels(X.frames(spark, sf), ("e", "depth"))
    flow = pixels.withColumn("flow", R.reorder_flow(F.col("e"), F.col("depth"))).select("scene", "frame", "y", "x", "flow.*")
    ends = X.frames(spark, sf).groupBy("scene").agg(F.max("frame").alias("last_frame")).withColumn("height", F.lit(8))
    both = [P.export_flow(flow, ends, d).withColumn("direction", F.lit(d)) for d in ("forward", "backward")]
    return both[0].unionByName(both[1]).select("scene", "frame", "direction", "y", "x", r(F.col("u")).alias("u"), r(F.col("v")).alias("v"))


def cropped_pixels(spark, sf):
    boxes = P.label_boxes(P.to_pixels(X.frames(spark, sf))).where("label = 5")
    return P.crop(P.to_pixels(X.frames(spark, sf)), boxes.drop("label")).select("scene", "frame", "y", "x", "segmentation")


def palette_violations(spark, sf):
    wide = X.frames(spark, sf).withColumn("segmentation", F.transform("segmentation", lambda s: s * F.when(F.col("frame") % 3 == 0, 60).when(F.col("frame") % 3 == 1, 20000).otherwise(1)))
    return P.palette_violations(wide)


def image_violations(spark, sf):
    """Frames whose depth, in tens of metres from the nearest plane, is no fraction, and those with a label that is no code."""
    frames = X.frames(spark, sf).withColumn("depth", F.transform("depth", lambda d: (d - 1.0) / 3.0))
    wide = X.frames(spark, sf).withColumn("segmentation", F.transform("segmentation", lambda s: s * F.when(F.col("frame") % 3 == 0, -1).when(F.col("frame") % 3 == 1, 20000).otherwise(1)))
    found = {"depth": P.image_violations(frames, "depth"), "segmentation": P.image_violations(wide, "segmentation")}
    parts = [df.select("scene", "frame", F.lit(name).alias("layer"), r(F.col("low").cast("double")).alias("low"), r(F.col("high").cast("double")).alias("high")) for name, df in found.items()]
    return parts[0].unionByName(parts[1])


def eroded_labels(spark, sf):
    return P.to_pixels(P.erode(X.frames(spark, sf))).groupBy("scene", "frame", "segmentation").agg(
        F.count("*").alias("pixel_count"), F.sum(F.col("y") * 8 + F.col("x")).alias("place_sum"))


def trusted_normals(spark, sf):
    normals = X.frames(spark, sf).withColumn("normal", F.flatten(F.transform("e", lambda v: F.array(v, v * 0.5, v * 0.25))))
    trusted = P.trusted_normals(normals).select("scene", "frame", F.posexplode("trusted").alias("at", "trusted"))
    return trusted.groupBy("scene", "frame").agg(F.count_if("trusted").alias("trusted_pixels"), F.sum(F.when(F.col("trusted"), F.col("at")).otherwise(0)).alias("place_sum"))


def depth_from_z(spark, sf):
    pixels = P.to_pixels(X.frames(spark, sf), ("depth", "segmentation"))
    depth = C.z_to_depth(F.col("depth"), F.col("x"), F.col("y"), F.lit(8), F.lit(8), F.lit(35.0), F.lit(32.0))
    return pixels.select("scene", "frame", "y", "x", r(depth).alias("depth"))


QUERIES = {f.__name__: f for f in (
    visibility, visible_labels, normalised_boxes, tracking_boxes, segment_histogram, remapped_labels, layer_ranges, encoded_layer, quantised_depth,
    encoded_normals, processed_layers, subsampled_nearest, subsampled_average, multi_resolution, exported_flow, cropped_pixels, palette_violations, image_violations,
    eroded_labels, trusted_normals, depth_from_z,
)}


def _sql(select: str, tables: str = "frame_rows") -> str:
    return X.oracle(tables, f"{X.PIXELS}, {select}" if " AS (" in select.split("SELECT")[0] else f"{X.PIXELS} {select}")


GRID = """grid AS (SELECT DISTINCT frame_rows.scene, frame, label FROM frame_rows JOIN scene_instances ON frame_rows.scene = scene_instances.scene),
    found AS (SELECT scene, frame, segmentation AS label, min(y) AS y0, min(x) AS x0, max(y) AS y1, max(x) AS x1, count(*) AS n FROM pixels GROUP BY ALL),
    seen AS (SELECT scene, frame, label, coalesce(n, 0) AS visibility, coalesce(y0, -1) AS y_min, coalesce(x0, -1) AS x_min, coalesce(y1, -1) AS y_max, coalesce(x1, -1) AS x_max
        FROM grid LEFT JOIN found USING (scene, frame, label))"""
BOTH = "frame_rows scene_instances"
CODE = "CAST(round_even((depth - 1.0) / 8.0 * 65535, 0) AS BIGINT)"

ORACLES = {
    "visibility": _sql(f"{GRID} SELECT scene, frame, label, visibility FROM seen", BOTH),
    "visible_labels": _sql(f"""{GRID}, t AS (SELECT scene, label, CAST(sum(visibility) AS BIGINT) AS total FROM seen GROUP BY ALL HAVING max(visibility) > 0)
        SELECT *, CAST(row_number() OVER (PARTITION BY scene ORDER BY total DESC, label) AS INT) AS new_label FROM t""", BOTH),
    "normalised_boxes": _sql(f"""{GRID} SELECT scene, frame, label, y_min / 8.0::DOUBLE AS y_min, x_min / 8.0::DOUBLE AS x_min, (y_max + 1) / 8.0::DOUBLE AS y_max, (x_max + 1) / 8.0::DOUBLE AS x_max
        FROM seen WHERE visibility > 0""", BOTH),
    "tracking_boxes": _sql(f"{GRID} SELECT scene, frame, label, y_min, x_min, y_max, x_max, visibility AS pixel_count FROM seen", BOTH),
    "segment_histogram": _sql("""tops AS (SELECT scene, max(segmentation) - 1 AS top FROM pixels GROUP BY ALL), ids AS (SELECT scene, CAST(l AS INT) AS label FROM tops, range(0, 6) t(l) WHERE l <= top)
        SELECT ids.scene, ids.label, count(p.scene) AS pixel_count FROM ids LEFT JOIN pixels p ON p.scene = ids.scene AND p.segmentation - 1 = ids.label GROUP BY ALL"""),
    "remapped_labels": _sql("""SELECT scene, frame, CASE segmentation WHEN 0 THEN 0 WHEN 2 THEN 77 WHEN 4 THEN 1 WHEN 3 THEN 2 ELSE 99 END AS segmentation,
        count(*) AS pixel_count, CAST(sum(x) AS BIGINT) AS x_sum FROM pixels GROUP BY ALL"""),
    "layer_ranges": _sql(f"SELECT scene, {sr('min(v) / 2')} AS low, {sr('max(v) / 2')} AS high FROM pixels GROUP BY ALL"),
    "encoded_layer": _sql("""w AS (SELECT scene, CAST(floor((depth - min(depth) OVER s) * 65535 / (max(depth) OVER s - min(depth) OVER s)) AS INT) AS code FROM pixels WINDOW s AS (PARTITION BY scene))
        SELECT scene, min(code) AS low_code, max(code) AS high_code, CAST(sum(code) AS BIGINT) AS code_sum FROM w GROUP BY ALL"""),
    "quantised_depth": _sql(f"""SELECT scene, frame, CAST(sum({CODE}) AS BIGINT) AS code_sum, {sr(f'max(abs(1.0 + {CODE} / 65535.0 * 8.0 - depth))', 3)} AS worst,
        {sr(f'sum({CODE} / 65536.0::DOUBLE * 8.0 + 1.0)', 4)} AS rescaled, CAST(sum({CODE} // 257) AS BIGINT) AS eight_bit FROM pixels GROUP BY ALL"""),
    "encoded_normals": _sql(f"""SELECT scene, frame, CAST(sum(floor((greatest(-1.0, least(1.0, v * 3)) + 1.0) * 65535 / 2.0)) AS BIGINT) AS normal_sum,
        CAST(sum(floor(greatest(0.0, least(1.0, v)) * 65535)) AS BIGINT) AS unit_sum, {sr('max(floor((greatest(-1.0, least(1.0, v)) + 1.0) * 65535 / 2.0) / 65535.0 * 2 - 1)')} AS decoded
        FROM pixels GROUP BY ALL"""),
    "processed_layers": _sql(f"""SELECT scene, CASE segmentation WHEN 0 THEN 'uv' WHEN 1 THEN 'normal' WHEN 2 THEN 'object_coordinates' WHEN 3 THEN 'z' WHEN 4 THEN 'rgba' ELSE 'other' END AS layer,
        {sr('''sum(CASE WHEN segmentation IN (0, 2) THEN floor(greatest(0.0, least(1.0, v)) * 65535) WHEN segmentation = 1 THEN floor((greatest(-1.0, least(1.0, v)) + 1.0) * 65535 / 2.0) ELSE v END)''', 3)} AS value
        FROM pixels GROUP BY scene, segmentation"""),
    "subsampled_nearest": _sql("SELECT scene, frame, CAST((y - 1) // 4 AS INT) AS y, CAST(x // 2 AS INT) AS x, segmentation FROM pixels WHERE y % 4 = 1 AND x % 2 = 0"),
    "subsampled_average": _sql("SELECT scene, frame, CAST(y // 4 AS INT) AS y, CAST(x // 2 AS INT) AS x, CAST(round_even(avg(segmentation), 0) AS INT) AS segmentation FROM pixels GROUP BY scene, frame, y // 4, x // 2"),
    "multi_resolution": _sql("""f AS (SELECT unnest([1, 2, 4]) AS factor), k AS (SELECT scene, frame, factor, (y - (factor - 1) // 2) // factor AS y, (x - (factor - 1) // 2) // factor AS x, segmentation
        FROM pixels, f WHERE y >= (factor - 1) // 2 AND x >= (factor - 1) // 2 AND (y - (factor - 1) // 2) % factor = 0 AND (x - (factor - 1) // 2) % factor = 0)
        SELECT scene, frame, factor, count(*) AS pixel_count, CAST(sum(segmentation * (y * 8 + x + 1)) AS BIGINT) AS check FROM k GROUP BY ALL""".replace("AS check", 'AS "check"')),
    "exported_flow": _sql(f"""l AS (SELECT scene, max(frame) AS last FROM pixels GROUP BY ALL)
        SELECT scene, frame, 'forward' AS direction, 7 - y AS y, x, {sr('-v * 256')} AS u, {sr('depth * 256')} AS v FROM pixels JOIN l USING (scene) WHERE frame < last
        UNION ALL SELECT scene, frame - 1, 'backward', 7 - y, x, {sr('v * 256')}, {sr('-depth * 256')} FROM pixels WHERE frame > 0"""),
    "cropped_pixels": _sql("""b AS (SELECT scene, frame, min(y) AS y0, min(x) AS x0, max(y) AS y1, max(x) AS x1 FROM pixels WHERE segmentation = 5 GROUP BY ALL)
        SELECT scene, frame, y - y0 AS y, x - x0 AS x, segmentation FROM pixels JOIN b USING (scene, frame) WHERE y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1"""),
    "palette_violations": _sql("""m AS (SELECT scene, frame, max(segmentation) * CASE frame % 3 WHEN 0 THEN 60 WHEN 1 THEN 20000 ELSE 1 END AS max_label FROM pixels GROUP BY scene, frame)
        SELECT *, CASE WHEN max_label > 65535 THEN 'invalid' ELSE 'wraps' END AS verdict FROM m WHERE max_label > 255"""),
    "image_violations": _sql(f"""d AS (SELECT scene, frame, min((depth - 1.0) / 3.0) AS low, max((depth - 1.0) / 3.0) AS high FROM pixels GROUP BY ALL),
        s AS (SELECT scene, frame, min(segmentation * k) AS low, max(segmentation * k) AS high FROM (SELECT *, CASE frame % 3 WHEN 0 THEN -1 WHEN 1 THEN 20000 ELSE 1 END AS k FROM pixels) GROUP BY ALL)
        SELECT scene, frame, 'depth' AS layer, {sr("low")} AS low, {sr("high")} AS high FROM d WHERE low < 0 OR high > 1
        UNION ALL SELECT scene, frame, 'segmentation', {sr("low::DOUBLE")}, {sr("high::DOUBLE")} FROM s WHERE low < 0 OR high > 65535"""),
    "eroded_labels": _sql("""n AS (SELECT p.scene, p.frame, p.y, p.x, p.segmentation, bool_or(q.depth < p.depth * 0.95) AS hit FROM pixels p JOIN pixels q ON p.scene = q.scene AND p.frame = q.frame
        AND abs(p.y - q.y) <= 1 AND abs(p.x - q.x) <= 1 GROUP BY ALL)
        SELECT scene, frame, CASE WHEN hit THEN -1 ELSE segmentation END AS segmentation, count(*) AS pixel_count, CAST(sum(y * 8 + x) AS BIGINT) AS place_sum FROM n GROUP BY ALL"""),
    "trusted_normals": _sql("""d AS (SELECT unnest([-1, -1, 1, 1]) AS dy, unnest([-1, 1, -1, 1]) AS dx),
        n AS (SELECT p.scene, p.frame, p.y, p.x, count(*) FILTER ((coalesce(q.v, 0) - p.v)**2 * 1.3125 > 0.0025) AS rough FROM pixels p CROSS JOIN d
        LEFT JOIN pixels q ON q.scene = p.scene AND q.frame = p.frame AND q.y = p.y + dy AND q.x = p.x + dx GROUP BY ALL)
        SELECT scene, frame, count(*) FILTER (rough <= 2) AS trusted_pixels, CAST(coalesce(sum(y * 8 + x) FILTER (rough <= 2), 0) AS BIGINT) AS place_sum FROM n GROUP BY ALL"""),
    "depth_from_z": _sql(f"SELECT scene, frame, y, x, {sr('depth * sqrt(1 + (((x - 3.5) / 8 * 32)**2 + ((y - 3.5) / 8 * 32)**2) / 1225.0::DOUBLE)')} AS depth FROM pixels"),
}
