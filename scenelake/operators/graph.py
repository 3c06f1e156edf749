"""Temporal contact graphs: delta, set algebra and time-respecting reachability."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scenelake.session import cut_lineage, spread

IDENTITY = ("instance_id", "object_a", "object_b", "start_step", "end_step")


def branch_edges(edges: DataFrame, branch: str) -> DataFrame:
    return edges.where(F.col("branch") == branch).drop("branch")


def edge_delta(factual: DataFrame, counterfactual: DataFrame, tolerance: float = 1e-6,
               keep_same: bool = False) -> DataFrame:
    """Full outer comparison of edges by identity: added, removed or changed.

    Equal edges are dropped unless ``keep_same``; a metric counts as changed when it
    differs by strictly more than ``tolerance``.
    """
    metrics = ("total_impulse", "peak_force")
    left = factual.select(*IDENTITY, *[F.col(m).alias(f"factual_{m}") for m in metrics])
    right = counterfactual.select(*IDENTITY, *[F.col(m).alias(f"counterfactual_{m}") for m in metrics])
    drift = [F.abs(F.col(f"factual_{m}") - F.col(f"counterfactual_{m}")) > tolerance for m in metrics]
    bucket = (
        F.when(F.col("factual_peak_force").isNull(), "added")
        .when(F.col("counterfactual_peak_force").isNull(), "removed")
        .when(drift[0] | drift[1], "changed")
        .otherwise("same")
    )
    compared = spread(left, *IDENTITY).join(spread(right, *IDENTITY), list(IDENTITY), "full").withColumn("bucket", bucket)
    return compared if keep_same else compared.where(F.col("bucket") != "same")


def union_edges(factual: DataFrame, counterfactual: DataFrame) -> DataFrame:
    """One row per edge identity; the counterfactual metrics win where both exist."""
    tagged = factual.withColumn("_rank", F.lit(0)).unionByName(
        counterfactual.withColumn("_rank", F.lit(1)), allowMissingColumns=False
    )
    rest = [c for c in factual.columns if c not in IDENTITY]
    newest = F.max_by(F.struct(*rest), F.col("_rank")).alias("_row") if rest else F.max("_rank").alias("_row")
    merged = spread(tagged, *IDENTITY).groupBy(*IDENTITY).agg(newest)
    return merged.select(*IDENTITY, *[F.col("_row")[c].alias(c) for c in rest])


def union_nodes(factual: DataFrame, counterfactual: DataFrame) -> DataFrame:
    return factual.unionByName(counterfactual).distinct()


def without_node(edges: DataFrame, node: Column | str) -> DataFrame:
    """Edges not incident on ``node``."""
    value = node if isinstance(node, Column) else F.lit(node)
    return edges.where((F.col("object_a") != value) & (F.col("object_b") != value))


def overlapping_buckets(delta: DataFrame) -> DataFrame:
    """Edge identities filed under more than one bucket."""
    return spread(delta, *IDENTITY).groupBy(*IDENTITY).agg(F.countDistinct("bucket").alias("buckets")).where("buckets > 1")


def conflicting_records(records: DataFrame, identity: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """Identities that carry more than one distinct payload."""
    digest = F.struct(*payload)
    return (
        spread(records, *identity).groupBy(*identity)
        .agg((F.min(digest) != F.max(digest)).alias("_conflict"), F.count("*").alias("records"))
        .where("_conflict").drop("_conflict")
    )


def _directed(edges: DataFrame, excluded: Sequence[str]) -> DataFrame:
    """Both directions of every edge whose endpoints are not excluded."""
    kept = edges
    if excluded:
        kept = kept.where(~F.col("object_a").isin(*excluded) & ~F.col("object_b").isin(*excluded))
    extra = [c for c in ("trigger",) if c in edges.columns]
    forward = kept.select("instance_id", F.col("object_a").alias("node"), F.col("object_b").alias("other"),
                          "start_step", "end_step", *extra)
    backward = kept.select("instance_id", F.col("object_b").alias("node"), F.col("object_a").alias("other"),
                           "start_step", "end_step", *extra)
    return forward.unionByName(backward)


#: Rounds after which the rows written so far are merged into one table.
COMPACT = 8
#: Steps in a block of the index of openings.
SPAN = 256


def _fixpoint(seed: DataFrame, expand, keys: Sequence[str], value: str, smallest: bool) -> DataFrame:
    """Repeats ``expand`` on improved rows until nothing improves; one row per key.

    Semi-naive: a round joins only the rows that the round before improved, and writes only those that improve again,
    to reliable storage, so the plan stays flat and a lost executor only repeats the round in flight. The value of a key
    is the best of all rounds; every COMPACT rounds these are merged.
    """
    pick = F.min if smallest else F.max
    merged = lambda layers: reduce(DataFrame.unionByName, layers).groupBy(*keys).agg(pick(value).alias(value))
    frontier = cut_lineage(seed.groupBy(*keys).agg(pick(value).alias(value)))
    layers = [frontier]
    while True:
        offered = expand(frontier).groupBy(*keys).agg(pick(value).alias("_offer"))
        better = F.col("_offer") < F.col(value) if smallest else F.col("_offer") > F.col(value)
        asked = reduce(DataFrame.unionByName, layers).join(offered.select(*keys), list(keys), "left_semi")
        frontier = cut_lineage(
            offered.join(asked.groupBy(*keys).agg(pick(value).alias(value)), list(keys), "left")
            .where(F.col(value).isNull() | better).select(*keys, F.col("_offer").alias(value))
        )
        if frontier.isEmpty():
            return merged(layers)
        layers.append(frontier)
        if len(layers) > COMPACT:
            layers = [cut_lineage(merged(layers))]


def opening_index(openings: DataFrame, group: Sequence[str]) -> DataFrame:
    """Blocks in which an as-of lookup finds the least ``value`` of a group's openings whose ``key`` lies beyond a moment.

    ``openings`` holds the group's columns and integers key and value. A moment falls into one block of each group, from
    ``low`` (null: the first block) to before ``high``; it carries the block's openings and the least value after it.
    """
    rows = openings.groupBy(*group, "key").agg(F.min("value").alias("value"))
    blocks = rows.groupBy(*group, F.floor(F.col("key") / SPAN).alias("_block")).agg(
        F.collect_list(F.struct("key", "value")).alias("here"), F.min("value").alias("_least"), F.max("key").alias("high"))
    window = W.partitionBy(*group).orderBy("_block")
    return blocks.withColumns({"low": F.lag("high").over(window), "later": F.min("_least").over(window.rowsBetween(1, W.unboundedFollowing))}).drop("_block", "_least")


def first_opening(moment: Column) -> Column:
    """The moment at which the first opening beyond ``moment`` can be used, from a block of :func:`opening_index`."""
    return F.greatest(moment, _beyond(moment))


def _beyond(moment: Column) -> Column:
    beyond = F.array_min(F.transform(F.filter("here", lambda opening: opening["key"] > moment), lambda opening: opening["value"]))
    return F.least(beyond, F.col("later"))


def _marked(edges: DataFrame, delta: DataFrame) -> DataFrame:
    triggers = delta.select(*IDENTITY).distinct().withColumn("_hit", F.lit(True))
    return edges.select(*IDENTITY).distinct().join(triggers, list(IDENTITY), "left").select(
        *IDENTITY, F.coalesce("_hit", F.lit(False)).alias("trigger")
    )


def causal_arcs(edges: DataFrame, delta: DataFrame, targets: DataFrame, excluded: Sequence[str] = ()) -> DataFrame:
    """Both directions of every usable edge, marked as trigger where the edge changed.

    Edges touching an excluded node are unusable; the target itself is never excluded.
    The result is written once, for every sweep to share.
    """
    active = _marked(edges, delta).join(targets.select("instance_id", "target_id"), "instance_id")
    if excluded:
        outside = lambda side: ~F.col(side).isin(*excluded) | (F.col(side) == F.col("target_id"))
        active = active.where(outside("object_a") & outside("object_b"))
    return cut_lineage(_directed(active.drop("target_id"), ()))


# What a search knows of a node: its earliest arrival without and with a changed edge, and the latest arrival, negated,
# from which a changed edge can still be used.
_PLAIN, _TRIGGERED, _DEADLINE = 0, 1, 2
# Edges to take: any, changed ones, and any backwards in time.
_ANY, _CHANGED, _BACK = 0, 1, 2


def _ways(arcs: DataFrame) -> DataFrame:
    """The index of all arcs by lane. Going forward an arc is open until its end, and used at its start or later.

    Backwards the same holds for negated steps: it can be used by who is there at its start or later, and arrivals up to
    its last step will do.
    """
    side = lambda rows, lane, key, value: rows.select("instance_id", "node", "other", F.lit(lane).alias("lane"), key.cast("long").alias("key"), value.cast("long").alias("value"))
    forward = (F.col("end_step"), F.col("start_step"))
    openings = side(arcs, _ANY, *forward).unionByName(side(arcs.where("trigger"), _CHANGED, *forward)).unionByName(
        side(arcs, _BACK, 1 - F.col("start_step"), 1 - F.col("end_step")))
    return opening_index(openings, ("instance_id", "node", "other", "lane"))


def hard_affected(edges: DataFrame, delta: DataFrame, targets: DataFrame,
                  excluded: Sequence[str] = (), arcs: DataFrame | None = None) -> DataFrame:
    """Nodes on a time-respecting walk from the target that uses a changed edge.

    ``edges`` is the union of both branches, ``targets`` holds instance_id, target_id and
    start_step. A walk may wait at a node; taking an edge at arrival ``t`` happens at
    ``max(t, start)`` and needs that to be before the exclusive end. The changed edge may
    come before or after the node on the walk, hence two sweeps: the earliest arrival
    forward with and without a trigger, and the latest arrival from which a trigger can
    still be used backward. ``arcs`` may pass on the result of :func:`causal_arcs`.
    """
    arcs = causal_arcs(edges, delta, targets, excluded) if arcs is None else arcs
    ways = cut_lineage(_ways(arcs))

    def expand(frontier: DataFrame) -> DataFrame:
        step = frontier.withColumn("lane", F.explode(F.when(F.col("mode") == _PLAIN, F.array(F.lit(_ANY), F.lit(_CHANGED))).when(F.col("mode") == _TRIGGERED, F.array(F.lit(_ANY))).otherwise(F.array(F.lit(_BACK)))))
        met = step.join(ways, ["instance_id", "node", "lane"]).where((F.col("low").isNull() | (F.col("moment") >= F.col("low"))) & (F.col("moment") < F.col("high")))
        return met.select("instance_id", F.col("other").alias("node"), F.when(F.col("lane") == _CHANGED, _TRIGGERED).otherwise(F.col("mode")).alias("mode"),
                          first_opening(F.col("moment")).alias("moment"))

    origin = targets.select("instance_id", F.col("target_id").alias("node"), F.lit(_PLAIN).alias("mode"), F.col("start_step").cast("long").alias("moment"))
    usable = arcs.where("trigger").select("instance_id", "node", F.lit(_DEADLINE).alias("mode"), (1 - F.col("end_step")).cast("long").alias("moment"))
    # Both sweeps in the same rounds.
    best = cut_lineage(_fixpoint(origin.unionByName(usable), expand, ("instance_id", "node", "mode"), "moment", smallest=True))
    reached = best.where(F.col("mode") != _DEADLINE).groupBy("instance_id", "node").agg(
        F.min(F.when(F.col("mode") == _PLAIN, F.col("moment"))).alias("plain"),
        F.max((F.col("mode") == _TRIGGERED).cast("int")).alias("triggered"),
    )
    deadlines = best.where(F.col("mode") == _DEADLINE).select("instance_id", "node", (-F.col("moment")).alias("latest"))
    return (
        reached.join(deadlines, ["instance_id", "node"], "left")
        .where((F.col("triggered") == 1) | (F.col("plain") <= F.col("latest")))
        .join(targets.select("instance_id", F.col("target_id").alias("node")), ["instance_id", "node"], "left_anti")
        .select("instance_id", F.col("node").alias("object_id"))
    )


def witness_paths(edges: DataFrame, delta: DataFrame, targets: DataFrame, candidates: DataFrame,
                  excluded: Sequence[str] = (), arcs: DataFrame | None = None) -> DataFrame:
    """The minimal proof (arrival, hops, path) of each candidate, cut at its first visit.

    Search labels live in a DataFrame keyed by (instance, candidate, node, seen,
    triggered) and grow by one hop per round. A label dies when its state was already
    reached no later with fewer hops, when a same-length label is no later and no larger,
    or when the candidate already has a smaller proof.
    """
    arcs = causal_arcs(edges, delta, targets, excluded) if arcs is None else arcs
    state = ("instance_id", "candidate", "node", "seen", "triggered")
    scope = ["instance_id", "candidate"]

    frontier = cut_lineage(
        candidates.select("instance_id", F.col("object_id").alias("candidate"))
        .join(targets, "instance_id")
        .select("instance_id", "candidate", F.col("target_id").alias("node"), F.lit(False).alias("seen"),
                F.lit(False).alias("triggered"), F.col("start_step").alias("arrival"),
                F.array("target_id").alias("path"))
    )
    earliest = frontier.select(*state, "arrival")
    proofs = None
    while not frontier.isEmpty():
        moment = F.greatest("arrival", "start_step")
        moved = (
            frontier.join(arcs, ["instance_id", "node"]).where(moment < F.col("end_step"))
            .select(
                "instance_id", "candidate", F.col("other").alias("node"),
                (F.col("seen") | (F.col("other") == F.col("candidate"))).alias("seen"),
                (F.col("triggered") | F.col("trigger")).alias("triggered"),
                moment.alias("arrival"), F.concat("path", F.array("other")).alias("path"),
            )
            .distinct()
        )
        fresh = moved.join(earliest.withColumnRenamed("arrival", "_known"), list(state), "left").where(
            F.col("_known").isNull() | (F.col("arrival") < F.col("_known"))
        ).drop("_known")
        if proofs is not None:
            bound = proofs.select(*scope, F.col("proof.arrival").alias("_bound"))
            fresh = fresh.join(bound, scope, "left").where(
                F.col("_bound").isNull() | (F.col("arrival") < F.col("_bound"))
            ).drop("_bound")
        # Same number of hops: keep a label only if no earlier-or-equal one has a path no larger.
        front = W.partitionBy(*state).orderBy("arrival", "path")
        smallest = F.min("path").over(front.rowsBetween(W.unboundedPreceding, -1))
        frontier = cut_lineage(
            fresh.withColumn("_smallest", smallest)
            .where(F.col("_smallest").isNull() | (F.col("_smallest") > F.col("path"))).drop("_smallest")
        )
        earliest = cut_lineage(
            earliest.unionByName(frontier.select(*state, "arrival"))
            .groupBy(*state).agg(F.min("arrival").alias("arrival"))
        )
        label = F.struct("arrival", F.size("path").alias("hops"), "path")
        found = frontier.where(F.col("seen") & F.col("triggered")).select(*scope, label.alias("proof"))
        pool = found if proofs is None else proofs.unionByName(found)
        proofs = cut_lineage(pool.groupBy(*scope).agg(F.min("proof").alias("proof")))
    if proofs is None:
        proofs = frontier.select(*scope, F.struct("arrival", F.lit(0).alias("hops"), "path").alias("proof"))
    path = F.col("proof.path")
    return proofs.select(
        "instance_id", F.col("candidate").alias("object_id"),
        F.slice(path, F.lit(1), F.array_position(path, F.col("candidate")).cast("int")).alias("path"),
    )


def forward_openings(edges: DataFrame, excluded: Sequence[str] = ()) -> DataFrame:
    """The index of all edges by node and neighbour, for walks that arrive at an edge's start.

    From one arrival the edge to a neighbour that starts first leaves every later choice open, so a round needs that one alone.
    """
    arcs = _directed(edges.select(*IDENTITY), ()).where(~F.col("other").isin(*excluded) if excluded else F.lit(True))
    return opening_index(arcs.select("instance_id", "node", "other", F.col("end_step").alias("key"), F.col("start_step").alias("value")), ("instance_id", "node", "other"))


def _entered(walks: DataFrame, ways: DataFrame) -> DataFrame:
    """Walks joined with the first start of an edge to each neighbour that is open after their arrival, as ``_start``."""
    met = walks.join(ways, ["instance_id", "node"]).where((F.col("low").isNull() | (F.col("arrival") >= F.col("low"))) & (F.col("arrival") < F.col("high")))
    return met.withColumn("_start", _beyond(F.col("arrival")))


def forward_reachable(edges: DataFrame, sources: DataFrame, excluded: Sequence[str] = ()) -> DataFrame:
    """Contact reachability on one graph, with its own arrival rule.

    An edge is open while its end lies after the arrival, and arrival becomes the edge's
    start, so arrival can move back in time. ``hops`` is the fewest edges to a node.
    """
    ways = cut_lineage(forward_openings(edges, excluded))
    origin = sources.select("instance_id", F.col("subject_id").alias("node"), F.lit(0).alias("arrival"))

    def expand(frontier: DataFrame) -> DataFrame:
        return _entered(frontier, ways).select("instance_id", F.col("other").alias("node"), F.col("_start").alias("arrival"))

    reached = _fixpoint(origin, expand, ("instance_id", "node"), "arrival", smallest=True)
    return reached.join(
        sources.select("instance_id", F.col("subject_id").alias("node")), ["instance_id", "node"], "left_anti"
    ).select("instance_id", F.col("node").alias("object_id"), "arrival")


def forward_paths(edges: DataFrame, sources: DataFrame, reachable: DataFrame,
                  excluded: Sequence[str] = ()) -> DataFrame:
    """Fewest-edge, then smallest, walk to each reachable node, every edge open when it is entered.

    A walk enters an edge that ends after its arrival and arrives at the edge's start. All
    walks of one length advance together, each by the first start to a neighbour; per node and arrival the smallest is kept, and
    one that arrives no earlier than a shorter walk can lead nowhere new.
    """
    ways = cut_lineage(
        forward_openings(edges, excluded)
        .join(reachable.select("instance_id", F.col("object_id").alias("other")), ["instance_id", "other"], "left_semi")
    )
    state = ["instance_id", "node"]
    walks = cut_lineage(sources.select("instance_id", F.col("subject_id").alias("node"), F.lit(0).alias("arrival"), F.array("subject_id").alias("path")))
    earliest, found = walks.select(*state, F.col("arrival").alias("_earliest")), None
    origin = walks.select(*state)
    while not walks.isEmpty():
        longer = _entered(walks, ways).groupBy("instance_id", F.col("other").alias("_next"), "_start").agg(
            F.min(F.concat("path", F.array("other"))).alias("path"))
        longer = longer.select("instance_id", F.col("_next").alias("node"), F.col("_start").alias("arrival"), "path")
        # A row is written only where it comes earlier than anything shorter.
        walks = cut_lineage(longer.join(earliest, state, "left").where(F.col("_earliest").isNull() | (F.col("arrival") < F.col("_earliest"))))
        first = walks.where(F.col("_earliest").isNull()).groupBy(*state).agg(F.min("path").alias("path"))
        found = first if found is None else found.unionByName(first)
        walks = walks.drop("_earliest")
        earliest = cut_lineage(earliest.unionByName(walks.select(*state, F.col("arrival").alias("_earliest"))).groupBy(*state).agg(F.min("_earliest").alias("_earliest")))
    if found is None:
        found = walks.select(*state, "path")
    return found.join(origin, state, "left_anti").select("instance_id", F.col("node").alias("object_id"), "path")
