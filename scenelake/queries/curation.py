"""Selection, splits and dataset statistics."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from scenelake.functions import hashing as H
from scenelake.operators import contacts as K
from scenelake.operators import curation as C
from scenelake.operators import sampling as M
from scenelake.operators import topology as T
from scenelake.queries import fixtures as X
from scenelake.sources import manifests as N

r, sr = X.rounded, X.sql_rounded
FRACTIONS = {"train": 0.8, "val": 0.1, "test": 0.1}


def _attempts(spark, sf):
    return X.table(spark, sf, "attempts")


def _candidates(spark, sf):
    return _attempts(spark, sf).where("status = 'accepted'").select("instance_id", "attempt_index", "category", "hop_bucket", "topology_signature")


def balanced_selection(spark, sf):
    return C.select_balanced(_candidates(spark, sf), 1000, seed=99).select("instance_id", "category", "hop_bucket", "selection_rank")


def hash_splits(spark, sf):
    return X.given(spark, sf, "orders").select("o_orderkey", C.hash_split(F.col("o_orderkey"), FRACTIONS, 2301).alias("split"))


def weighted_hash_splits(spark, sf):
    """Unnormalised weights with extra names, counted per split."""
    weights = {"test": 1.0, "train": 2.0, "beta": 0.5, "alpha": 0.0}
    return X.given(spark, sf, "orders").select(C.hash_split(F.col("o_orderkey"), weights, 5).alias("split")).groupBy("split").agg(F.count("*").alias("instances"))


def grouped_splits(spark, sf):
    return C.grouped_split(_candidates(spark, sf), FRACTIONS, seed=12).select("instance_id", "topology_signature", "split")


def ratio_splits(spark, sf):
    return C.ratio_split(X.given(spark, sf, "part").select("p_partkey"), "p_partkey", 0.025)


def held_out_assets(spark, sf):
    return C.held_out_split(X.given(spark, sf, "part").select("p_partkey"), "p_partkey", 0.1)


def held_out_assets_rounded_up(spark, sf):
    return C.held_out_split(X.given(spark, sf, "part").select("p_partkey"), "p_partkey", 0.1003, seed=3, round_up=True)


def frame_splits(spark, sf):
    return C.frame_split(X.table(spark, sf, "frame_rows").select("scene", "frame"), 0.7, seed=4)


def view_splits(spark, sf):
    return X.table(spark, sf, "frame_rows").select("scene", "frame", C.view_split(F.col("frame")).alias("split"))


def numeric_order(spark, sf):
    return C.numeric_order(X.given(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("name")))


def outcome_counts(spark, sf):
    return C.outcome_counts(_attempts(spark, sf), 5000)


def reason_counts(spark, sf):
    codes = F.array("category", F.when(F.col("hop_bucket") == "3+", "too_deep"))
    return C.reason_counts(_attempts(spark, sf).where("status = 'rejected'").select(F.array_compact(codes).alias("reasons")))


def seeds_and_ids(spark, sf):
    index = F.col("o_orderkey")
    return X.given(spark, sf, "orders").select("o_orderkey", H.derive_seed(2301, index, "physics").alias("seed"), H.instance_id(2301, index).alias("instance_id"),
                                               H.sha_text(5, index, F.col("o_orderpriority")).alias("order_hash"), r(H.draw(H.derive_seed(1, index, "a"), "u"), 9).alias("draw"))


def content_ids(spark, sf):
    """Ids that change with any field of an instance, however deep."""
    key, share = F.col("o_orderkey"), F.col("o_custkey") / 8.0
    scene = F.struct(F.array(F.lit(0.0), F.lit(0.0), -share).alias("gravity"), F.struct(F.col("o_orderstatus").alias("shape"), F.lit(None).cast("string").alias("label")).alias("body"))
    path = F.array(F.struct(F.lit(0).alias("step"), share.alias("x")), F.struct(F.lit(1).alias("step"), (share + 0.5).alias("x")))
    change = F.struct(F.lit("retime").alias("recipe"), F.array(F.lit(3), F.lit(9)).alias("window"))
    return X.given(spark, sf, "orders").select("o_orderkey", H.content_instance_id(key, H.derive_seed(7, key, "instance"), scene, path, change, F.lit("non_null")).alias("instance_id"))


def shuffled_batches(spark, sf):
    return M.batches(X.given(spark, sf, "supplier").select("s_suppkey"), "s_suppkey", 16, epochs=3, seed=8)


def drawn_samples(spark, sf):
    """How often each user's events are drawn, with replacement."""
    events = X.given(spark, sf, "events").select("user_id", "event_id")
    wanted = events.groupBy("user_id").agg((F.count("*") / 4).cast("int").alias("quota"))
    return M.draw_with_replacement(events, wanted, ("user_id",), ("event_id",), 3).groupBy("user_id").agg(F.count("*").alias("draws"))


def refined_objects(spark, sf):
    """Objects of each instance and branch that no pattern of contacts tells apart: pairs are labelled by how many steps they touch."""
    steps = K.canonicalise(X.contact_points(spark, sf).select("instance_id", "branch", "step", "object_a", "object_b", "normal_force"))
    pairs = steps.groupBy(F.concat_ws("_", F.col("instance_id").cast("string"), "branch").alias("scene"), "object_a", "object_b").agg((F.countDistinct("step") % 3).alias("label"))
    pairs = pairs.where("label > 0")
    nodes = pairs.select("scene", F.explode(F.array("object_a", "object_b")).alias("node")).distinct().withColumn("colour", F.lit("object"))
    return T.refined_classes(T.refined(nodes, pairs)).select("scene", F.col("node").alias("object_id"), F.col("like").alias("class"), "members")


def topology_signatures(spark, sf):
    """Every scene's signature from all its factual contacts."""
    points = X.contact_points(spark, sf).where("branch = 'factual'")
    targets = X.table(spark, sf, "targets").select("instance_id", "target_id")
    objects = targets.select("instance_id", F.explode(F.array(*[F.lit(f"object_{i}") for i in range(7)])).alias("object_id")).select(
        "*", F.lit("cube").alias("shape"), (F.col("object_id") == "object_6").alias("static"))
    return T.signatures(objects, targets, points, max_nodes=None)


def _instances(spark, sf):
    return _candidates(spark, sf).select("instance_id", C.hash_split(F.col("attempt_index"), FRACTIONS, 1).alias("split"), F.col("attempt_index").alias("index"),
                                         (F.col("attempt_index") % 3 + 5).alias("num_objects"))


def split_index(spark, sf):
    return N.split_index(_instances(spark, sf))


def dataset_card(spark, sf):
    ranges = N.object_range(_instances(spark, sf))
    return ranges.crossJoin(F.broadcast(N.split_counts_text(_instances(spark, sf)))).crossJoin(
        F.broadcast(N.size_summary(X.given(spark, sf, "documents").select(F.col("n_chars").alias("size")))))


def transform_descriptors(spark, sf):
    frames = X.table(spark, sf, "frame_rows").select("scene", "frame", C.view_split(F.col("frame") % 5).alias("split"), F.lit(0.75).alias("fov"),
                                                      F.concat(F.lit("f_"), F.col("frame").cast("string")).alias("file_path"), F.array("frame", "scene").alias("matrix"))
    return N.transforms(frames)


QUERIES = {f.__name__: f for f in (
    balanced_selection, hash_splits, weighted_hash_splits, grouped_splits, ratio_splits, held_out_assets, held_out_assets_rounded_up, frame_splits, view_splits, numeric_order,
    outcome_counts, reason_counts, seeds_and_ids, content_ids, shuffled_batches, drawn_samples, topology_signatures, refined_objects, split_index, dataset_card, transform_descriptors,
)}


def _unit(text: str) -> str:
    return f"(('0x' || substr(sha256({text}), 1, 14))::BIGINT / 72057594037927936.0)"


def _split_sql(key: str, seed: int, fractions: dict[str, float]) -> str:
    names = [*[n for n in C.SPLITS if n in fractions], *sorted(n for n in fractions if n not in C.SPLITS)]
    whole, cursor, arms = sum(fractions.values()), 0.0, []
    for name in names:
        cursor += fractions[name] / whole
        arms.append(f"WHEN {_unit(f'''{seed} || ':' || {key}''')} < {cursor!r} THEN '{name}'")
    return f"CASE {' '.join(arms)} ELSE '{names[-1]}' END"


_ORDER = sorted(C.SPLITS, key=lambda n: hashlib.sha256(f"12\0{n}".encode()).hexdigest())
_COST = {n: " + ".join(f"pow({o} + {'g.n' if o == n else '0'} - {FRACTIONS[o]!r} * total, 2)" for o in C.SPLITS) for n in C.SPLITS}
ACCEPTED = "cand AS (SELECT * FROM attempts WHERE status = 'accepted')"
INSTANCES = f"{ACCEPTED}, inst AS (SELECT instance_id, {_split_sql('attempt_index', 1, FRACTIONS)} AS split, attempt_index AS index, attempt_index % 3 + 5 AS num_objects FROM cand)"

ORACLES = {
    "balanced_selection": X.oracle("attempts", f"""{ACCEPTED}, n AS (SELECT *, row_number() OVER (PARTITION BY category, hop_bucket ORDER BY sha256('99' || chr(0) || instance_id), instance_id) AS round FROM cand),
        s AS (SELECT category, hop_bucket, row_number() OVER (ORDER BY sha256('99' || chr(0) || category || chr(0) || hop_bucket)) AS k FROM (SELECT DISTINCT category, hop_bucket FROM cand) t)
        SELECT instance_id, category, hop_bucket, row_number() OVER (ORDER BY round, k) AS selection_rank FROM n JOIN s USING (category, hop_bucket) QUALIFY selection_rank <= 1000"""),
    "hash_splits": f"SELECT o_orderkey, {_split_sql('o_orderkey', 2301, FRACTIONS)} AS split FROM orders",
    "weighted_hash_splits": f"SELECT {_split_sql('o_orderkey', 5, {'test': 1.0, 'train': 2.0, 'beta': 0.5, 'alpha': 0.0})} AS split, count(*) AS instances FROM orders GROUP BY ALL",
    "grouped_splits": X.oracle("attempts", f"""{ACCEPTED}, sizes AS (SELECT topology_signature AS sig, count(*) AS n, sum(count(*)) OVER () AS total FROM cand GROUP BY ALL),
        g AS (SELECT *, row_number() OVER (ORDER BY n DESC, sha256('12' || chr(0) || sig), sig) AS i FROM sizes),
        walk AS (SELECT 0::BIGINT AS i, ''::VARCHAR AS sig, ''::VARCHAR AS pick, 0::DOUBLE AS train, 0::DOUBLE AS val, 0::DOUBLE AS test
        UNION ALL SELECT i, sig, pick, train + (pick = 'train')::INT * n, val + (pick = 'val')::INT * n, test + (pick = 'test')::INT * n FROM
            (SELECT g.i, g.sig, g.n, train, val, test, CASE {" ".join(f"WHEN {_COST[n]} <= least({', '.join(_COST[o] for o in C.SPLITS)}) + 1e-6 THEN '{n}'" for n in _ORDER)} END AS pick
             FROM walk w JOIN g ON g.i = w.i + 1) z)
        SELECT instance_id, topology_signature, pick AS split FROM cand JOIN walk ON sig = topology_signature"""),
    "ratio_splits": """WITH n AS (SELECT p_partkey, row_number() OVER (ORDER BY sha256('42' || chr(0) || p_partkey)) AS k, count(*) OVER () AS c FROM part)
        SELECT p_partkey, CASE WHEN k > c - greatest(1, round_even(c * 0.025, 0)) THEN 'validation' ELSE 'train' END AS split FROM n""",
    "held_out_assets": """WITH n AS (SELECT p_partkey, row_number() OVER (ORDER BY sha256('42' || chr(0) || p_partkey)) AS k, count(*) OVER () AS c FROM part)
        SELECT p_partkey, CASE WHEN k <= round_even(c * 0.1, 0) THEN 'test' ELSE 'train' END AS split FROM n""",
    "held_out_assets_rounded_up": """WITH n AS (SELECT p_partkey, row_number() OVER (ORDER BY sha256('3' || chr(0) || p_partkey)) AS k, count(*) OVER () AS c FROM part)
        SELECT p_partkey, CASE WHEN k <= ceil(c * 0.1003) THEN 'test' ELSE 'train' END AS split FROM n""",
    "frame_splits": X.oracle("frame_rows", """n AS (SELECT scene, frame, row_number() OVER (PARTITION BY scene ORDER BY sha256('4' || chr(0) || scene || chr(0) || frame)) AS k, count(*) OVER (PARTITION BY scene) AS c FROM frame_rows)
        SELECT scene, frame, CASE WHEN k <= floor(c * 0.7) THEN 'train' ELSE 'test' END AS split FROM n"""),
    "view_splits": X.oracle("frame_rows", "SELECT scene, frame, CASE WHEN frame = 0 THEN 'validation' ELSE 'train' END AS split FROM frame_rows"),
    "numeric_order": "SELECT s_suppkey::VARCHAR AS name FROM supplier ORDER BY s_suppkey",
    "outcome_counts": X.oracle("attempts", """n AS (SELECT count(*) AS attempts, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'rejected') AS rejected,
        count(*) FILTER (status = 'error') AS errors FROM attempts) SELECT *, CASE WHEN accepted >= 5000 THEN 'complete' ELSE 'capacity_exhausted' END AS status FROM n"""),
    "reason_counts": X.oracle("attempts", """e AS (SELECT category AS reason FROM attempts WHERE status = 'rejected' UNION ALL SELECT 'too_deep' FROM attempts WHERE status = 'rejected' AND hop_bucket = '3+')
        SELECT reason, count(*) AS attempts FROM e GROUP BY ALL"""),
    "refined_objects": X.oracle("contacts", """pairs AS (SELECT instance_id || '_' || branch AS scene, least(object_a, object_b) AS a, greatest(object_a, object_b) AS b, count(DISTINCT step) % 3 AS label FROM contacts GROUP BY ALL),
        ways AS (SELECT scene, a AS node, b AS other, label FROM pairs WHERE label > 0 UNION ALL SELECT scene, b, a, label FROM pairs WHERE label > 0),
        col AS (SELECT DISTINCT scene, node, 'object' AS colour, 0 AS i FROM ways
            UNION ALL SELECT c.scene, c.node, sha256(c.colour || '|' || n || '|' || s), c.i + 1
            FROM col c JOIN (SELECT w.scene, w.node, count(*) AS n, sum(('0x' || substr(sha256(w.label || '|' || o.colour), 1, 15))::BIGINT::HUGEINT) AS s
                FROM ways w JOIN col o ON o.scene = w.scene AND o.node = w.other GROUP BY ALL) m ON m.scene = c.scene AND m.node = c.node WHERE c.i < 8)
        SELECT scene, node AS object_id, min(node) OVER (PARTITION BY scene, colour) AS class, count(*) OVER (PARTITION BY scene, colour) AS members FROM col WHERE i = 8"""),
    "content_ids": """WITH s AS (SELECT o_orderkey, o_orderstatus, o_custkey / 8.0::DOUBLE AS v,
            ('0x' || substr(sha256('7' || chr(0) || o_orderkey || chr(0) || 'instance'), 1, 16))::UBIGINT % 9223372036854775808 AS seed FROM orders)
        SELECT o_orderkey, 'instance_' || substr(sha256('{"attempt_index":' || o_orderkey || ',"expected_effect":"non_null","factual_path":[{"step":0,"x":' || v || '},{"step":1,"x":' || (v + 0.5)
            || '}],"instance_seed":' || seed || ',"intervention":{"recipe":"retime","window":[3,9]},"scene_config":{"body":{"label":null,"shape":"' || o_orderstatus
            || '"},"gravity":[0.0,0.0,' || (-v) || ']}}' || chr(10)), 1, 20) AS instance_id FROM s""",
    "seeds_and_ids": f"""WITH s AS (SELECT *, (('0x' || substr(sha256('1' || chr(0) || o_orderkey || chr(0) || 'a'), 1, 16))::UBIGINT % 9223372036854775808)::BIGINT AS a FROM orders)
        SELECT o_orderkey, (('0x' || substr(sha256('2301' || chr(0) || o_orderkey || chr(0) || 'physics'), 1, 16))::UBIGINT % 9223372036854775808)::BIGINT AS seed,
        'instance_' || substr(sha256('velocity/2301/' || o_orderkey), 1, 20) AS instance_id, sha256('5' || chr(0) || o_orderkey || chr(0) || o_orderpriority) AS order_hash,
        {sr(_unit("a::VARCHAR || ':u'"), 9)} AS draw FROM s""",
    "shuffled_batches": """WITH n AS (SELECT s_suppkey, CAST(e AS INT) AS epoch, row_number() OVER (PARTITION BY e ORDER BY sha256('8' || chr(0) || e || chr(0) || s_suppkey)) - 1 AS k FROM supplier, range(0, 3) t(e))
        SELECT s_suppkey, epoch, k // 16 AS batch, k % 16 AS slot FROM n""",
    "drawn_samples": "SELECT user_id, count(*) // 4 AS draws FROM events GROUP BY ALL HAVING count(*) >= 4",
    "split_index": X.oracle("attempts", f"{INSTANCES} SELECT instance_id, split, index, num_objects, 'instances/' || instance_id AS path FROM inst ORDER BY split, instance_id"),
    "dataset_card": X.oracle("attempts", f"""{INSTANCES} SELECT min(num_objects) - 1 AS low, max(num_objects) - 1 AS high, (min(num_objects) - 1) || '-' || (max(num_objects) - 1) AS object_range,
        (SELECT string_agg(n || ' ' || split, ', ' ORDER BY split) FROM (SELECT split, count(*) AS n FROM inst GROUP BY ALL) t) AS counts,
        (SELECT count(*) FROM documents) AS files, (SELECT CAST(sum(n_chars) AS BIGINT) FROM documents) AS total_bytes, (SELECT round_even(sum(n_chars) / 1048576.0, 1) FROM documents) AS total_mib FROM inst"""),
    "transform_descriptors": X.oracle("frame_rows", """f AS (SELECT scene, frame, CASE WHEN frame % 5 = 0 THEN 'validation' ELSE 'train' END AS split,
        '{"file_path":"f_' || frame || '","transform_matrix":[' || frame || ',' || scene || ']}' AS body FROM frame_rows)
        SELECT scene, split, '{"camera_angle_x":0.75,"frames":[' || string_agg(body, ',' ORDER BY frame) || ']}' AS descriptor FROM f GROUP BY ALL"""),
}
