"""Domain tables derived from the given tables by SQL that both engines run.

Braces name a given table. The number of instances, scenes and assets grows with the
tables, so no key becomes denser as the data grows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GIVEN = ("lineitem", "orders", "part", "events", "embeddings", "customer", "supplier", "documents")

TABLES = {
    # Contact points with unordered endpoints; two branches that share most rows.
    "contact_rows": """
        SELECT CAST(floor(l_suppkey / 5) AS INT) AS instance_id, CAST(l_orderkey % 240 AS INT) AS step,
               concat('object_', CAST(l_partkey % 6 AS STRING)) AS object_a,
               concat('object_', CAST((l_partkey + l_linenumber) % 7 AS STRING)) AS object_b,
               CAST(l_partkey % 6 AS INT) AS body_a, CAST((l_partkey + l_linenumber) % 7 AS INT) AS body_b,
               l_quantity AS normal_force, l_returnflag AS flag,
               CAST(l_partkey % 10 AS DOUBLE) AS px, CAST(l_suppkey % 10 AS DOUBLE) AS py, CAST(l_linenumber AS DOUBLE) AS pz,
               CAST(l_linenumber - 4 AS DOUBLE) AS nx, CAST(l_partkey % 3 - 1 AS DOUBLE) AS ny, CAST(1 AS DOUBLE) AS nz,
               CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_discount - l_tax END AS contact_distance
        FROM {lineitem} WHERE l_partkey % 6 <> (l_partkey + l_linenumber) % 7""",
    "contacts": """
        SELECT 'factual' AS branch, * FROM contact_rows WHERE flag <> 'R'
        UNION ALL SELECT 'counterfactual' AS branch, * FROM contact_rows WHERE flag <> 'A'""",
    "targets": """
        SELECT DISTINCT instance_id, 'object_0' AS target_id, 'object_0' AS subject_id, 228 AS start_step FROM contact_rows""",
    # Rigid-body states; the counterfactual shifts or re-signs some objects after step 40.
    "track_rows": """
        SELECT CAST(floor(o_custkey / 75) AS INT) AS instance_id, concat('object_', CAST(o_orderkey % 6 AS STRING)) AS object_id,
               CAST(row_number() OVER (PARTITION BY floor(o_custkey / 75), o_orderkey % 6 ORDER BY o_orderkey) - 1 AS INT) AS step,
               o_orderkey AS k, o_custkey AS c, o_orderstatus AS s,
               (floor(o_custkey / 75) * 7 + o_orderkey % 6) % 3 AS grp,
               CAST(1.37 AS DOUBLE) + o_orderkey % 5 AS rw, CAST(0.11 AS DOUBLE) + o_custkey % 4 AS rx,
               o_orderkey % 7 - CAST(2.83 AS DOUBLE) AS ry, o_custkey % 3 - CAST(0.59 AS DOUBLE) AS rz
        FROM {orders}""",
    "track_unit": """
        SELECT *, sqrt(rw * rw + rx * rx + ry * ry + rz * rz) AS rn FROM track_rows""",
    "track_states": """
        SELECT instance_id, object_id, step, k, c, s, grp,
               (k % 97) / 10.0 AS x, (c % 89) / 10.0 AS y, (k % 13) / 10.0 AS z,
               rw / rn AS qw, rx / rn AS qx, ry / rn AS qy, rz / rn AS qz,
               (k % 11) / 5.0 - 1.0 AS vx, (c % 7) / 5.0 - 0.6 AS vy, (k % 3) / 10.0 AS vz,
               (k % 9) / 30.0 AS wx, (c % 5) / 40.0 AS wy, CAST(k % 2 AS DOUBLE) AS wz
        FROM track_unit""",
    "states": """
        SELECT instance_id, 'factual' AS branch, object_id, step,
               CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z, qw, qx, qy, qz,
               CAST(vx AS DOUBLE) AS vx, CAST(vy AS DOUBLE) AS vy, CAST(vz AS DOUBLE) AS vz,
               CAST(wx AS DOUBLE) AS wx, CAST(wy AS DOUBLE) AS wy, wz
        FROM track_states
        UNION ALL
        SELECT instance_id, 'counterfactual' AS branch, object_id, step,
               CAST(x AS DOUBLE) + CASE WHEN grp = 0 AND s = 'F' AND (step >= 40 OR k % 97 = 5) THEN CAST(0.002 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS x,
               CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z,
               sgn * qw AS qw, sgn * qx AS qx, sgn * qy AS qy, sgn * qz AS qz,
               CAST(vx AS DOUBLE) AS vx, CAST(vy AS DOUBLE) AS vy, CAST(vz AS DOUBLE) AS vz,
               CAST(wx AS DOUBLE) AS wx, CAST(wy AS DOUBLE) AS wy, wz
        FROM (SELECT *, CAST(CASE WHEN grp = 1 AND s = 'P' AND step >= 40 THEN -1 ELSE 1 END AS DOUBLE) AS sgn FROM track_states) t
        WHERE k % 1501 <> 7""",
    "state_targets": """
        SELECT DISTINCT instance_id, 'object_0' AS target_id, 'object_0' AS subject_id, 40 AS start_step FROM track_rows""",
    # Sparse keyframes of one channel per user: every third frame.
    "keyframes": """
        SELECT concat('asset_', CAST(user_id AS STRING)) AS asset, 'value' AS member,
               CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 3 AS INT) AS frame, value AS v
        FROM {events}""",
    # One 8x8 frame per embedding, 25 frames per scene; an embedding's numbers make the pixels.
    "frame_rows": """
        SELECT CAST(floor(vec_id / 25) AS INT) AS scene, CAST(vec_id % 25 AS INT) AS frame, vec_id, label AS tag, embedding AS e
        FROM {embeddings}""",
    "scene_instances": """
        SELECT DISTINCT scene, label FROM (SELECT scene, 1 AS label FROM frame_rows UNION ALL SELECT scene, 2 FROM frame_rows
        UNION ALL SELECT scene, 3 FROM frame_rows UNION ALL SELECT scene, 4 FROM frame_rows UNION ALL SELECT scene, 9 FROM frame_rows) t""",
    # Boxes: one body per part in scenes of 40 parts.
    "boxes": """
        SELECT CAST(floor(p_partkey / 40) AS INT) AS instance_id, concat('body_', CAST(p_partkey % 40 AS STRING)) AS object_id,
               CAST(p_partkey * 7 % 23 AS DOUBLE) / 2.0 AS x, CAST(p_partkey * 11 % 19 AS DOUBLE) / 2.0 AS y,
               CAST(p_partkey * 3 % 17 AS DOUBLE) / 4.0 AS z,
               CAST(0.25 AS DOUBLE) + p_size % 5 / CAST(8.0 AS DOUBLE) AS sx, CAST(0.25 AS DOUBLE) + p_size % 3 / CAST(8.0 AS DOUBLE) AS sz,
               CASE p_partkey % 4 WHEN 0 THEN 'cube' WHEN 1 THEN 'sphere' WHEN 2 THEN 'cylinder' ELSE 'capsule' END AS shape,
               CAST(p_partkey % 16 AS DOUBLE) / 8.0 AS yaw, p_partkey % 5 = 0 AS is_static, p_partkey AS k
        FROM {part}""",
    # Journal of attempts and their candidates.
    "attempts": """
        SELECT o_orderkey AS attempt_index, concat('instance_', CAST(o_orderkey AS STRING)) AS instance_id,
               CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'rejected' ELSE 'error' END AS status,
               o_orderpriority AS category, CASE WHEN o_custkey % 5 >= 3 THEN '3+' ELSE CAST(o_custkey % 5 AS STRING) END AS hop_bucket,
               concat('topology_', CAST(o_custkey AS STRING)) AS topology_signature, o_custkey AS custkey
        FROM {orders}""",
}


def _needed(names: tuple[str, ...]) -> list[str]:
    found: list[str] = []

    def visit(name: str) -> None:
        for other in TABLES:
            if other != name and re.search(rf"\b(FROM|JOIN)\s+{other}\b", TABLES[name]):
                visit(other)
        if name not in found:
            found.append(name)

    for name in names:
        visit(name)
    return found


def given(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A derived table as a lazy DataFrame."""
    ctes = _needed((name,))
    text = "WITH " + ", ".join(f"{n} AS ({TABLES[n]})" for n in ctes) + f" SELECT * FROM {name}"
    used = {g: given(spark, folder, g) for g in GIVEN if "{%s}" % g in text}
    return spark.sql(text, **used)


def oracle(names: str, select: str) -> str:
    """SQL for the second engine: the derived tables as common table expressions, then ``select``.

    ``select`` may open with further ``name AS (...)`` expressions ending in the final SELECT.
    """
    ctes = ", ".join(f"{n} AS ({TABLES[n].format(**{g: g for g in GIVEN})})" for n in _needed(tuple(names.split())))
    body = select.strip()
    joiner = " " if re.match(r"(?i)select\b", body) else ", "
    return f"WITH RECURSIVE {ctes}{joiner}{body}"


def rounded(value: Column, digits: int = 6) -> Column:
    """Rounded for comparison; negative zero becomes zero."""
    return F.round(value, digits) + F.lit(0.0)


def sql_rounded(expression: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0"


def lanes(column: str, names: str, digits: int = 6) -> list[Column]:
    """Array components as separate rounded columns."""
    return [rounded(F.col(column)[i], digits).alias(n) for i, n in enumerate(names.split())]


def contact_points(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "contacts")
    return raw.select("instance_id", "branch", "step", "object_a", "object_b", "normal_force",
                      F.array("px", "py", "pz").alias("position"), F.array("nx", "ny", "nz").alias("normal"), "contact_distance")


def raw_contacts(spark: SparkSession, folder: str) -> DataFrame:
    """The factual branch before its bodies are named."""
    raw = table(spark, folder, "contacts").where("branch = 'factual'")
    return raw.select("instance_id", "step", "body_a", "body_b", "normal_force", "contact_distance",
                      F.array("px", "py", "pz").alias("position"), F.array("nx", "ny", "nz").alias("normal"))


def body_states(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "states")
    return raw.select("instance_id", "branch", "object_id", "step", F.array("x", "y", "z").alias("position"),
                      F.array("qw", "qx", "qy", "qz").alias("quaternion"), F.array("vx", "vy", "vz").alias("linear_velocity"),
                      F.array("wx", "wy", "wz").alias("angular_velocity"))


def bodies(spark: SparkSession, folder: str) -> DataFrame:
    """Static boxes with shape, size and yaw as a quaternion."""
    from scenelake.functions import quaternions as Q

    raw = table(spark, folder, "boxes")
    return raw.select(
        "instance_id", "object_id", "shape", "is_static", "k", F.array("x", "y", "z").alias("position"),
        F.when(F.col("shape").isin("cylinder", "capsule"), F.array("sx", "sx", "sz")).otherwise(F.array("sx", "sx", "sx")).alias("size"),
        Q.yaw(F.col("yaw")).alias("quaternion"))


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """8x8 frames with labels 0 to 5 and depths above 1."""
    raw = table(spark, folder, "frame_rows")
    label = F.transform("e", lambda v: (F.floor(F.abs(v.cast("double")) * 40) % 6).cast("int"))
    depth = F.transform("e", lambda v: 1.0 + F.abs(v.cast("double")) * 10)
    return raw.select("scene", "frame", "vec_id", F.lit(8).alias("height"), F.lit(8).alias("width"),
                      label.alias("segmentation"), depth.alias("depth"), F.transform("e", lambda v: v.cast("double")).alias("e"))


# The second engine's long pixel table, for use after ``frame_rows``.
PIXELS = """pixels AS (SELECT scene, frame, vec_id, CAST((i - 1) // 8 AS INT) AS y, CAST((i - 1) % 8 AS INT) AS x,
    CAST(floor(abs(CAST(e[i] AS DOUBLE)) * 40) AS INT) % 6 AS segmentation, 1.0::DOUBLE + abs(CAST(e[i] AS DOUBLE)) * 10 AS depth,
    CAST(e[i] AS DOUBLE) AS v FROM (SELECT *, unnest(range(1, 65)) AS i FROM frame_rows) t)"""
