"""Identifier-free signature of a scene's contact topology."""

from __future__ import annotations

import hashlib
import itertools
import json
import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenelake.session import cut_lineage

PERMUTATION_LIMIT = 100_000


def labelled_nodes(objects: DataFrame, targets: DataFrame, edges: DataFrame) -> DataFrame:
    """Node labels ``role|shape|static``; endpoints without an object are unknown."""
    role = (
        F.when(F.col("object_id") == F.col("target_id"), "target")
        .when(F.col("static"), "environment").otherwise("dynamic")
    )
    known = objects.join(targets.select("instance_id", "target_id"), "instance_id").select(
        "instance_id", F.col("object_id").alias("node"),
        F.concat_ws("|", role, "shape", F.col("static").cast("int").cast("string")).alias("label"),
    )
    ends = edges.select("instance_id", F.explode(F.array("object_a", "object_b")).alias("node")).distinct()
    strange = ends.join(known, ["instance_id", "node"], "left_anti").withColumn("label", F.lit("unknown|unknown|0"))
    return known.unionByName(strange)


def _arrangements(pools: list[list[int]]) -> np.ndarray:
    """All node orders that keep each pool together, one per row."""
    orders = np.zeros((1, 0), dtype=np.int64)
    for pool in pools:
        block = np.array(list(itertools.permutations(pool)), dtype=np.int64)
        orders = np.hstack([np.repeat(orders, len(block), axis=0), np.tile(block, (len(orders), 1))])
    return orders


def canonical_form(labels: list[str], edges: set[tuple[int, int]]) -> str | None:
    """Smallest upper-triangle adjacency string over permutations that keep labels together.

    All arrangements are narrowed column by column: rows showing a 1 where another
    surviving row shows a 0 drop out. None if the arrangements exceed the limit.
    """
    pools = [[i for i, label in enumerate(labels) if label == name] for name in sorted(set(labels))]
    if math.prod(math.factorial(len(p)) for p in pools) > PERMUTATION_LIMIT:
        return None
    linked = np.zeros((len(labels), len(labels)), dtype=bool)
    for a, b in edges:
        linked[a, b] = linked[b, a] = True
    alive, text = _arrangements(pools), []
    for row, column in itertools.combinations(range(len(labels)), 2):
        bits = linked[alive[:, row], alive[:, column]]
        if not bits.all():
            alive = alive[~bits]
        text.append("1" if bits.all() else "0")
    return "".join(text)


def _refined(nodes: list[int], near: dict[int, set[int]], color: dict[int, int]) -> dict[int, int]:
    """Colors split by the sorted colors of the neighbours until no class splits further."""
    count = len(set(color.values()))
    while True:
        keys = {v: (color[v], sorted(color[w] for w in near[v])) for v in nodes}
        rank = {key: i for i, key in enumerate(sorted({(c, tuple(k)) for c, k in keys.values()}))}
        color = {v: rank[c, tuple(k)] for v, (c, k) in keys.items()}
        if len(rank) == count:
            return color
        count = len(rank)


def _sparse(nodes: list[int], near: dict[int, set[int]], color: dict[int, int]) -> dict[int, set[int]]:
    """Links between two classes, or inside one, turn into their complement where more than half are there.

    The rule looks at classes alone, so it keeps every symmetry; classes that are wholly linked come apart.
    """
    cells: dict[int, list[int]] = {}
    for v in nodes:
        cells.setdefault(color[v], []).append(v)
    ends = Counter((color[v], color[w]) for v in nodes for w in near[v])
    dense: dict[int, list[int]] = {}
    for (a, b), n in ends.items():
        if 2 * n > len(cells[a]) * (len(cells[b]) - (a == b)):
            dense.setdefault(a, []).append(b)
    out = {}
    for v in nodes:
        out[v] = set(near[v])
        for b in dense.get(color[v], ()):
            out[v].symmetric_difference_update(w for w in cells[b] if w != v)
    return out


def _components(nodes: list[int], near: dict[int, set[int]]) -> list[list[int]]:
    parts, seen = [], set()
    for start in nodes:
        if start in seen:
            continue
        part = [start]
        seen.add(start)
        for v in part:
            fresh = near[v] - seen
            seen |= fresh
            part += fresh
        parts.append(part)
    return parts


def _form(order: list[int], near: dict[int, set[int]], color: dict[int, int]) -> tuple:
    """Colors and links of nodes written in an order; equal forms are equal graphs."""
    place = {v: i for i, v in enumerate(order)}
    return [color[v] for v in order], sorted((place[v], place[w]) for v in order for w in near[v] if place[v] < place[w])


def _ordered(nodes: list[int], near: dict[int, set[int]], color: dict[int, int]) -> list[int]:
    """An order of the nodes under which all graphs of one shape have one form.

    Classes are refined first. What is left falls into parts that are ordered on their own;
    parts of one form are interchangeable. In a part that stays tied each node of its
    smallest class is set apart in turn and the smallest form wins. Two equal forms
    are a symmetry, and nodes that known symmetries exchange are tried once.
    """
    color = _refined(nodes, near, color)
    if len(set(color.values())) == len(nodes):
        return sorted(nodes, key=color.__getitem__)
    near = _sparse(nodes, near, color)
    parts = _components(nodes, near)
    if len(parts) > 1:
        orders = [_ordered(part, near, color) if len(part) > 1 else part for part in parts]
        return [v for _, order in sorted(((_form(o, near, color), o) for o in orders), key=lambda x: x[0]) for v in order]
    cells: dict[int, list[int]] = {}
    for v in nodes:
        cells.setdefault(color[v], []).append(v)
    cell = min((c for c in cells.items() if len(c[1]) > 1), key=lambda c: (len(c[1]), c[0]))[1]
    leader = {v: v for v in cell}

    def lead(v: int) -> int:
        while leader[v] != v:
            leader[v] = v = leader[leader[v]]
        return v

    tried: list[tuple[tuple, list[int]]] = []
    done: set[int] = set()
    for v in cell:
        if lead(v) in {lead(u) for u in done}:
            continue
        order = _ordered(nodes, near, {u: 2 * c + (u != v) for u, c in color.items()})
        form = _form(order, near, color)
        done.add(v)
        known = next((o for f, o in tried if f == form), None)
        if known is None:
            tried.append((form, order))
        else:
            for a, b in zip(known, order):
                if a in leader:
                    leader[lead(a)] = lead(b)
    return min(tried, key=lambda t: t[0])[1]


def canonical_edges(labels: list[str], edges: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """Edges between places of a canonical node order that keeps labels together, for graphs of any size."""
    near: dict[int, set[int]] = {v: set() for v in range(len(labels))}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    rank = {name: i for i, name in enumerate(sorted(set(labels)))}
    color = {v: rank[name] for v, name in enumerate(labels)}
    order = sorted(_ordered(list(near), near, color), key=color.__getitem__)
    return _form(order, near, color)[1]


def _digest(names: list[str], links: set[tuple[int, int]], whole: bool) -> str | None:
    counts = Counter(names)
    payload: dict = {"labels": [[n, counts[n]] for n in sorted(counts)]}
    adjacency = canonical_form(names, links)
    if adjacency is not None:
        payload["adjacency"] = adjacency
    elif whole:
        payload["edges"] = canonical_edges(names, links)
    else:
        return None
    text = json.dumps(payload, sort_keys=True, separators=(",", ":")) + "\n"
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


@F.pandas_udf(T.StringType())
def _signature(nodes: pd.Series, pairs: pd.Series, whole: pd.Series) -> pd.Series:
    def digest(listed, links, every) -> str | None:
        place = {n["node"]: i for i, n in enumerate(listed)}
        return _digest([n["label"] for n in listed], {(place[p["object_a"]], place[p["object_b"]]) for p in links}, every)

    return pd.Series([digest(n, p, bool(w)) for n, p, w in zip(nodes, pairs, whole)])


def signatures(objects: DataFrame, targets: DataFrame, contacts: DataFrame, max_nodes: int | None = 64) -> DataFrame:
    """Signature per instance from distinct contact pairs.

    Contacts collapse to distinct pairs before anything is gathered. With ``max_nodes``
    None every scene has a signature: the smallest adjacency within the permutation
    limit, the edges in canonical order beyond it. With a number, scenes of more nodes
    or beyond the limit are reported with a null signature.
    """
    edges = contacts.where("object_a <> object_b").select(
        "instance_id", F.least("object_a", "object_b").alias("object_a"), F.greatest("object_a", "object_b").alias("object_b")
    ).distinct()
    nodes = labelled_nodes(objects, targets, edges)
    sizes = nodes.groupBy("instance_id").agg(F.count("*").alias("node_count"))
    small = sizes if max_nodes is None else sizes.where(F.col("node_count") <= max_nodes)
    gathered = nodes.join(small, "instance_id", "left_semi").groupBy("instance_id").agg(
        F.array_sort(F.collect_list(F.struct("label", "node"))).alias("_nodes")
    )
    links = edges.join(small, "instance_id", "left_semi").groupBy("instance_id").agg(
        F.collect_list(F.struct("object_a", "object_b")).alias("_edges"))
    found = F.coalesce("_edges", F.array().cast("array<struct<object_a:string,object_b:string>>"))
    signed = gathered.join(links, "instance_id", "left").select(
        "instance_id", _signature("_nodes", found, F.lit(max_nodes is None)).alias("topology_signature")
    )
    return sizes.join(signed, "instance_id", "left")


def _number(text: Column) -> Column:
    """The leading 60 bits of a digest, to be summed without regard to order."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(38,0)")


def refined(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The coarsest colouring of all scenes' nodes in which equal colours have equal neighbourhoods.

    ``nodes``: scene, node and a first colour (string); ``edges``: scene, object_a, object_b, label, undirected, each
    once. A round gives a node the digest of its colour and of its neighbours' (label, colour) pairs, which are summed, so
    that no list of neighbours is ever gathered; all scenes take part at once, and rounds end when no scene gains a colour.
    """
    ends = lambda a, b: edges.select("scene", F.col(a).alias("node"), F.col(b).alias("other"), F.col("label").cast("string").alias("label"))
    ways = cut_lineage(ends("object_a", "object_b").unionByName(ends("object_b", "object_a")))
    colours = cut_lineage(nodes.select("scene", "node", F.col("colour").cast("string").alias("colour")))
    classes = colours.select("scene", "colour").distinct().count()
    while True:
        seen = ways.join(colours.select("scene", F.col("node").alias("other"), "colour"), ["scene", "other"])
        around = seen.groupBy("scene", "node").agg(F.count("*").alias("_n"), F.sum(_number(F.concat_ws("|", "label", "colour"))).alias("_sum"))
        new = F.sha2(F.concat_ws("|", "colour", F.coalesce("_n", F.lit(0)).cast("string"), F.coalesce("_sum", F.lit(0)).cast("decimal(38,0)").cast("string")), 256)
        finer = cut_lineage(colours.join(around, ["scene", "node"], "left").select("scene", "node", new.alias("colour")))
        more = finer.select("scene", "colour").distinct().count()
        if more == classes:
            return colours
        colours, classes = finer, more


def refined_classes(colours: DataFrame) -> DataFrame:
    """scene, node and the smallest node of its colour, which names the class whatever the digests are."""
    least = colours.groupBy("scene", "colour").agg(F.min("node").alias("like"), F.count("*").alias("members"))
    return colours.join(least, ["scene", "colour"]).select("scene", "node", "like", "members")
