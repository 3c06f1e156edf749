"""Asset manifests and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenelake.functions import color, hashing
from scenelake.operators import assets as A
from scenelake.operators import scenarios as G
from scenelake.queries import fixtures as X

r, sr = X.rounded, X.sql_rounded


def _parts(spark, sf):
    return X.given(spark, sf, "part")


def _manifest(spark, sf):
    """One manifest per brand: a map from part to its entry."""
    entry = F.struct(
        F.lit("FileBasedObject").alias("asset_type"), F.lit("CC-BY").alias("license"),
        F.when(F.col("p_partkey") % 3 == 0, "").when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("sub/"), F.col("p_name"))).alias("path"),
        F.struct((F.col("p_retailprice") / 100).alias("mass"), F.lit("{asset_dir}/visual.glb").alias("render_filename"), F.lit("kwargs").alias("category")).alias("kwargs"),
        F.struct(F.col("p_type").alias("category"), F.col("p_size").alias("nr_faces")).alias("metadata"))
    pairs = F.collect_list(F.struct(F.concat(F.lit("asset_"), F.col("p_partkey").cast("string")), entry))
    # The manifest of a brand is cut into folders of 50 parts, so that no map grows with the table.
    folder = F.concat_ws("/", F.lit("/data"), "p_brand", F.floor(F.col("p_partkey") / 50).cast("string"))
    return _parts(spark, sf).groupBy(F.col("p_brand").alias("name"), folder.alias("data_dir")).agg(F.map_from_entries(pairs).alias("assets"))


def flattened_assets(spark, sf):
    flat = A.flatten(_manifest(spark, sf))
    asset_dir = F.concat_ws("/", "data_dir", "id")
    return flat.select("name", "id", "category", "nr_faces", r(F.col("mass")).alias("mass"),
                       A.resolve_path(F.col("path"), F.col("data_dir"), F.col("id")).alias("path"),
                       A.substitute_asset_dir(F.col("render_filename"), asset_dir).alias("render_filename"))


def nested_paths(spark, sf):
    """Substitution through a map of structs."""
    inner = F.struct(F.lit("{asset_dir}/a.obj").alias("file"), F.col("p_size").alias("size"))
    raw = _parts(spark, sf).select("p_partkey", F.create_map(F.lit("visual"), inner).alias("files"))
    kind = raw.schema["files"].dataType
    done = raw.withColumn("files", A.substitute_in_struct(F.col("files"), kind, F.concat(F.lit("/d/"), F.col("p_partkey").cast("string"))))
    return done.select("p_partkey", F.col("files")["visual"]["file"].alias("file"), F.col("files")["visual"]["size"].alias("size"))


def category_ids(spark, sf):
    named = _parts(spark, sf).select("p_partkey", F.when(F.col("p_size") == 7, "").when(F.col("p_size") == 8, None).otherwise(F.col("p_type")).alias("category"))
    return A.category_ids(named)


def allowed_assets(spark, sf):
    parts = _parts(spark, sf).select("p_partkey", F.concat_ws("/", F.lit("/mnt/models"), "p_brand", F.col("p_partkey").cast("string")).alias("path"))
    denied = parts.where("p_partkey % 97 = 0").select(A.path_suffix(F.col("path")).alias("suffix"))
    return A.without_denied(parts, "path", denied)


def described_assets(spark, sf):
    """Every line item looked up by faces, category and leading description."""
    keyed = _parts(spark, sf).groupBy(F.col("p_size").cast("bigint").alias("nr_faces"), F.col("p_type").alias("category"), F.substring("p_name", 1, 15).alias("description_key")).agg(
        F.min("p_partkey").alias("asset_id"))
    lines = X.given(spark, sf, "lineitem").join(_parts(spark, sf), F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey", "l_linenumber", (F.col("p_size") + F.when(F.col("l_quantity") > 40, 100).otherwise(0)).cast("bigint").alias("nr_faces"), F.col("p_type").alias("category"),
        F.col("p_name").alias("description"))
    return A.lookup_by_description(lines, keyed).groupBy("asset_id").agg(F.count("*").alias("instances"))


def scaled_instances(spark, sf):
    table = _parts(spark, sf).select(F.col("p_partkey").alias("asset_id"), F.col("p_type").alias("category"), (F.col("p_size") / 4.0).alias("scale_factor"))
    instances = X.given(spark, sf, "lineitem").select(F.col("l_partkey").alias("asset_id"), "l_orderkey", F.col("l_quantity").alias("scale"))
    return A.lookup_scale(instances, table).groupBy("category").agg(F.count("*").alias("instances"), r(F.sum("scale"), 3).alias("scale"))


def categories_from_paths(spark, sf):
    names = X.given(spark, sf, "region").select(F.col("r_regionkey").cast("string").alias("category_code"), F.col("r_name").alias("category"))
    folders = _parts(spark, sf).select("p_partkey", F.concat_ws("/", F.lit("/m"), (F.col("p_partkey") % 6).cast("string"), F.concat(F.lit("a"), F.col("p_partkey").cast("string"))).alias("path"))
    return A.category_from_path(folders, "path", names).select("p_partkey", "asset_id", "category")


def held_out_combinations(spark, sf):
    """Brand, type and size combinations that no pattern withholds."""
    patterns = spark.createDataFrame([("Brand#1", None, None), (None, "ECONOMY", 11), ("Brand#3", "STANDARD", None)], "p_brand STRING, p_type STRING, p_size INT")
    return A.without_held_out(_parts(spark, sf), patterns, ["p_brand", "p_type", "p_size"]).select("p_partkey", "p_brand", "p_type", "p_size")


def suggested_assets(spark, sf):
    """The closest distinct part name for names with a letter lost or doubled."""
    names = _parts(spark, sf).select(F.concat_ws("_", "p_name", "p_type").alias("id")).distinct()
    broken = names.select(F.concat(F.substring("id", 1, 4), F.substring("id", 6, 100)).alias("id"))
    return A.did_you_mean(broken.join(names, "id", "left_anti"), names)


def batch_manifest(spark, sf):
    """Complete brands keep their manifest; a brand with a failed entry keeps nothing."""
    entries = _parts(spark, sf).select("p_brand", "p_partkey", F.when(F.col("p_partkey") % 1 == 0, F.struct("p_size", "p_type")).alias("properties"))
    whole = A.batch_manifest(entries)
    broken = A.batch_manifest(entries.withColumn("properties", F.when(F.col("p_partkey") != 5, F.col("properties"))))
    return whole.withColumn("run", F.lit("whole")).unionByName(broken.withColumn("run", F.lit("broken"))).groupBy("run", "p_brand").agg(F.count("*").alias("entries"))


def instance_fields(spark, sf):
    """Per-variant instance fields zipped by position from two arrays of a scene."""
    scenes = X.given(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("instances"))
    zipped = scenes.select("l_orderkey", F.posexplode("instances").alias("position", "item"))
    palette = F.array(*[F.lit(c) for c in color.NAMED_COLORS])
    label = palette[(F.col("item.l_partkey") % len(color.NAMED_COLORS)).cast("int")]
    rgba = color.from_name(label)
    return zipped.select("l_orderkey", "position", label.alias("color_label"), color.to_hex(rgba).alias("hex"), color.to_hex(rgba, short=True).alias("short_hex"),
                         (F.col("item.l_quantity") > 25).alias("is_dynamic"))


def color_conversions(spark, sf):
    """Colours of packed integers through hue, saturation and value and back."""
    packed = _parts(spark, sf).select("p_partkey", ((F.col("p_partkey") * 7919) % 16777216).cast("int").alias("packed"))
    rgba = color.from_hexint(F.col("packed"))
    staged = packed.withColumn("rgba", rgba).withColumn("hsv", color.to_hsv(F.col("rgba")))
    again = color.from_hsv(F.col("hsv")[0], F.col("hsv")[1], F.col("hsv")[2])
    text = color.from_hex(F.concat(F.lit("#"), F.lpad(F.hex("packed"), 6, "0")))
    return staged.select("p_partkey", *X.lanes("rgba", "r g b a"), r(F.col("hsv")[1]).alias("saturation"), r(F.col("hsv")[2]).alias("value"),
                         r(again[0] - F.col("rgba")[0], 5).alias("drift"), r(text[2]).alias("blue"))


def palettes(spark, sf):
    rows = _parts(spark, sf).select("p_partkey", F.col("p_partkey").cast("int").alias("label"))
    lanes = color.palette(F.col("label"), F.lit(5000.0))
    return rows.select("p_partkey", lanes[0].alias("r"), lanes[1].alias("g"), lanes[2].alias("b"))


def matte_ids(spark, sf):
    """Matte identifier of every distinct asset name."""
    names = _parts(spark, sf).select(F.concat(F.lit("Object_"), F.col("p_partkey").cast("string")).alias("name")).distinct()
    return names.select("name", hashing.matte_hash("name").alias("matte"))


def digests(spark, sf):
    """Record digests: our own over sorted columns, and the canonical-JSON form."""
    parts = _parts(spark, sf)
    body = F.to_json(F.struct("p_partkey", "p_name", "p_size"))
    return parts.select("p_partkey", hashing.struct_digest("p_size", "p_partkey", "p_name").alias("digest"), hashing.canonical_json_digest(body).alias("canonical"))


def material_physics(spark, sf):
    """Density-coupled mass of every part by its family."""
    families = F.array(*[F.lit(f) for f in G.MATERIALS])
    seed = G.seed_of(11, F.col("p_partkey"), "materials")
    parts = _parts(spark, sf).withColumn("family", families[(F.col("p_partkey") % len(G.MATERIALS)).cast("int")]).withColumn("seed", seed)
    physics = G.coupled_physics(F.col("seed"), F.col("family"), F.col("p_size") / 100.0, (0.25, 4.0))
    return parts.withColumn("p", physics).select("p_partkey", "family", *[r(F.col(f"p.{c}")).alias(c) for c in ("effective_density", "unclamped_mass", "mass", "friction", "restitution")])


QUERIES = {f.__name__: f for f in (
    flattened_assets, nested_paths, category_ids, allowed_assets, described_assets, scaled_instances, categories_from_paths, held_out_combinations, suggested_assets,
    batch_manifest, instance_fields, color_conversions, palettes, matte_ids, digests, material_physics,
)}



def _murmur_sql(names: str) -> str:
    """The 32-bit hash of ``name`` in ``names``, block by block, as SQL over 64-bit integers."""
    low = "4294967295::UBIGINT"
    turned = lambda x, n: f"((({x} << {n}) | ({x} >> {32 - n})) & {low})"
    times = lambda x, factor: f"(({x} * {factor}::UBIGINT) & {low})"
    mix = lambda x: times(turned(times(x, 0xCC9E2D51), 15), 0x1B873593)
    step = turned(f"xor(h, {mix('k')})", 13)
    return f"""b AS (SELECT name, list_transform(range(1, length(name) + 1), lambda i: ascii(substring(name, i, 1))::UBIGINT) AS b FROM {names}),
        k AS (SELECT name, len(b)::UBIGINT AS n, list_transform(range(0, len(b) // 4), lambda i: b[4 * i + 1] + b[4 * i + 2] * 256 + b[4 * i + 3] * 65536 + b[4 * i + 4] * 16777216) AS ks,
            coalesce(b[len(b) // 4 * 4 + 1], 0) + coalesce(b[len(b) // 4 * 4 + 2], 0) * 256 + coalesce(b[len(b) // 4 * 4 + 3], 0) * 65536 AS k FROM b),
        h0 AS (SELECT name, n, k, list_reduce(ks, lambda h, k: ({times(step, 5)} + 3864292196) & {low}, 0::UBIGINT) AS h FROM k),
        h1 AS (SELECT name, xor(xor(h, {mix('k')}), n) AS h FROM h0),
        h2 AS (SELECT name, {times('xor(h, h >> 16)', 0x85EBCA6B)} AS h FROM h1),
        h3 AS (SELECT name, {times('xor(h, h >> 13)', 0xC2B2AE35)} AS h FROM h2),
        hashed AS (SELECT name, xor(h, h >> 16) AS h FROM h3)"""


_FAMILY = list(G.MATERIALS)


def _drawn(field: str) -> str:
    low, high = ([G.MATERIALS[f][field][side] for f in _FAMILY] for side in (0, 1))
    draw = f"(('0x' || substr(sha256(s::VARCHAR || ':physics/{field}'), 1, 14))::BIGINT / 72057594037927936.0)"
    return f"(({low}[f + 1])::DOUBLE + {draw} * (({high}[f + 1])::DOUBLE - ({low}[f + 1])::DOUBLE))"


_HUE = "((p_partkey - 1) / 5000.0 + 0.01 - floor((p_partkey - 1) / 5000.0 + 0.01))"


def _palette_lane(offset: str) -> str:
    h = f"(({_HUE} + {offset}) - floor({_HUE} + {offset}))"
    return f"""CAST(CASE WHEN p_partkey = 0 THEN 0 ELSE round_even((CASE WHEN {h} < 1/6 THEN 0.15 + 0.7*{h}*6 WHEN {h} < 1/2 THEN 0.85 WHEN {h} < 2/3 THEN 0.15 + 0.7*(2/3 - {h})*6 ELSE 0.15 END)*255, 0) END AS INT)"""


_HEX = {n: c for n, c in color.NAMED_COLORS.items()}

ORACLES = {
    "matte_ids": f"""n AS (SELECT DISTINCT 'Object_' || p_partkey AS name FROM part), {_murmur_sql('n')}
        SELECT name, (CASE WHEN (h >> 23) & 255 IN (0, 255) THEN xor(h, 8388608::UBIGINT) ELSE h END)::BIGINT AS matte FROM hashed""",
    "flattened_assets": f"""SELECT p_brand AS name, 'asset_' || p_partkey AS id, p_type AS category, p_size AS nr_faces, {sr('p_retailprice / 100')} AS mass,
        CASE p_partkey % 3 WHEN 0 THEN '/data/' || p_brand || '/' || p_partkey // 50 || '/asset_' || p_partkey || '.tar.gz' WHEN 1 THEN '/data/' || p_brand || '/' || p_partkey // 50 || '/sub/' || p_name END AS path,
        '/data/' || p_brand || '/' || p_partkey // 50 || '/asset_' || p_partkey || '/visual.glb' AS render_filename FROM part""",
    "nested_paths": "SELECT p_partkey, '/d/' || p_partkey || '/a.obj' AS file, p_size AS size FROM part",
    "category_ids": """c AS (SELECT p_partkey, CASE p_size WHEN 7 THEN '' WHEN 8 THEN NULL ELSE p_type END AS category FROM part)
        SELECT p_partkey, c.category, CAST(i AS INT) AS category_id FROM c LEFT JOIN (SELECT category, row_number() OVER (ORDER BY category) - 1 AS i FROM
        (SELECT DISTINCT category FROM c WHERE category <> '') t) d ON c.category = d.category""",
    "allowed_assets": "SELECT p_partkey, '/mnt/models/' || p_brand || '/' || p_partkey AS path FROM part WHERE p_partkey % 97 <> 0",
    "described_assets": """k AS (SELECT p_size, p_type, substr(p_name, 1, 15) AS d, min(p_partkey) AS asset_id FROM part GROUP BY ALL)
        SELECT k.asset_id, count(*) AS instances FROM lineitem JOIN part p ON l_partkey = p_partkey LEFT JOIN k ON l_quantity <= 40 AND k.p_size = p.p_size AND k.p_type = p.p_type AND k.d = substr(p.p_name, 1, 15) GROUP BY ALL""",
    "scaled_instances": f"SELECT p_type AS category, count(*) AS instances, {sr('sum(l_quantity * p_size / 4.0)', 3)} AS scale FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY ALL",
    "categories_from_paths": "SELECT p_partkey, 'a' || p_partkey AS asset_id, r_name AS category FROM part LEFT JOIN region ON r_regionkey = p_partkey % 6",
    "held_out_combinations": """SELECT p_partkey, p_brand, p_type, p_size FROM part WHERE NOT (p_brand = 'Brand#1' OR (p_type = 'ECONOMY' AND p_size = 11) OR (p_brand = 'Brand#3' AND p_type = 'STANDARD'))""",
    "batch_manifest": "SELECT 'whole' AS run, p_brand, count(*) AS entries FROM part GROUP BY ALL",
    "instance_fields": f"""n AS (SELECT {list(_HEX)} AS names, {list(_HEX.values())} AS codes), i AS (SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) - 1 AS INT) AS position,
        CAST(l_partkey % 16 + 1 AS INT) AS c, l_quantity FROM lineitem)
        SELECT l_orderkey, position, names[c] AS color_label, codes[c] || 'ff' AS hex,
        '#' || list_aggregate(list_transform([2, 4, 6], lambda k: lower(to_hex(CAST(floor(('0x' || substr(codes[c], k, 2))::INT / 255.0::DOUBLE * 15) AS INT)))), 'string_agg', '') || 'f' AS short_hex,
        l_quantity > 25 AS is_dynamic FROM i, n""",
    "color_conversions": f"""c AS (SELECT p_partkey, CAST((p_partkey * 7919) % 16777216 AS INT) AS k FROM part), d AS (SELECT p_partkey, (k >> 16 & 255) / 255.0::DOUBLE AS r, (k >> 8 & 255) / 255.0::DOUBLE AS g, (k & 255) / 255.0::DOUBLE AS b FROM c)
        SELECT p_partkey, {sr('r')} AS r, {sr('g')} AS g, {sr('b')} AS b, 1.0::DOUBLE AS a, {sr('CASE WHEN greatest(r,g,b) = 0 THEN 0 ELSE (greatest(r,g,b) - least(r,g,b)) / greatest(r,g,b) END')} AS saturation,
        {sr('greatest(r,g,b)')} AS value, 0.0::DOUBLE AS drift, {sr('b')} AS blue FROM d""",
    "palettes": f"SELECT p_partkey, {_palette_lane('1/3')} AS r, {_palette_lane('0')} AS g, {_palette_lane('-1/3')} AS b FROM part",
    "digests": """SELECT p_partkey, sha256('{"p_name":"' || p_name || '","p_partkey":' || p_partkey || ',"p_size":' || p_size || '}') AS digest,
        sha256('{"p_name":"' || p_name || '","p_partkey":' || p_partkey || ',"p_size":' || p_size || '}' || chr(10)) AS canonical FROM part""",
    "material_physics": f"""b AS (SELECT p_partkey, p_size, CAST(p_partkey % 7 AS INT) AS f, (('0x' || substr(sha256('11' || chr(0) || p_partkey || chr(0) || 'materials'), 1, 16))::UBIGINT % 9223372036854775808)::BIGINT AS s FROM part),
        v AS (SELECT *, {_drawn('density')} AS d, {_drawn('friction')} AS fr, {_drawn('restitution')} AS re FROM b)
        SELECT p_partkey, {_FAMILY}[f + 1] AS family, {sr('d')} AS effective_density, {sr('d * (p_size / 100.0)')} AS unclamped_mass, {sr('least(greatest(d * (p_size / 100.0), 0.25), 4.0)')} AS mass,
        {sr('fr')} AS friction, {sr('re')} AS restitution FROM v""",
}
ORACLES = {name: sql if sql.lstrip().upper().startswith("SELECT") else "WITH " + sql for name, sql in ORACLES.items()}
