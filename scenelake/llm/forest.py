"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are cut from the distinct vectors of a bounded, documented sample; every vector is then placed in one leaf of each
tree. A query opens the nodes of all trees through one shared priority queue, closest margin first, until the leaves
it has reached hold a set share of those distinct vectors. Every vector in those leaves is a candidate and is ranked by its exact
distance in double precision, inside the task of its leaf; a leaf too full for one task is dealt out to several.

The share decides recall. The given vectors are close to random directions, where neighbours are hardly nearer than
others, and need a large share for a recall of 0.9; clustered vectors need much less.

Defined results: a vector that is null, empty, all zero, holds a null or non-finite component, or has another length
than most of the sample takes no part, nor does a row with a null vec_id; ties go to the smaller vec_id; of rows that repeat a
vec_id the nearest counts; fewer than ``k`` candidates give fewer rows; an empty table gives none; other columns are
not read.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors that the trees are cut from, and vectors of the sample in a leaf.
SAMPLE = 16_384
LEAF = 32
TREES = 16
#: Share of the sample's distinct vectors that a query's leaves hold.
SHARE = 0.6
#: Vectors of a leaf that one task ranks.
TOGETHER = 16_384


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


@dataclass
class Tree:
    """Nodes as arrays; a child below zero is leaf number -1 - child."""

    normal: np.ndarray
    cut: np.ndarray
    children: np.ndarray
    leaves: list[np.ndarray]

    def place(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        at = np.zeros(len(vectors), dtype=np.int64) if len(self.cut) else np.full(len(vectors), -1)
        while (open_ := np.flatnonzero(at >= 0)).size:
            node = at[open_]
            right = np.einsum("ij,ij->i", vectors[open_], self.normal[node]) > self.cut[node]
            at[open_] = self.children[node, right.astype(np.int64)]
        return -1 - at


def grow(sample: np.ndarray, draws: np.random.Generator, leaf: int = LEAF) -> Tree:
    """A tree whose every node halves its part of the sample along a direction between two random centres."""
    normal, cut, children, leaves = [], [], [], []

    def split(ids: np.ndarray) -> int:
        direction = _direction(sample[ids], draws) if len(ids) > leaf else None
        if direction is not None:
            along = sample[ids] @ direction
            middle = float(np.median(along))
            left, right = ids[along <= middle], ids[along > middle]
            if len(left) and len(right):
                number = len(cut)
                normal.append(direction)
                cut.append(middle)
                children.append([0, 0])
                children[number] = [split(left), split(right)]
                return number
        leaves.append(ids)
        return -len(leaves)

    split(np.arange(len(sample)))
    size = sample.shape[1]
    return Tree(np.array(normal).reshape(-1, size), np.array(cut), np.array(children, dtype=np.int64).reshape(-1, 2), leaves)


def _direction(points: np.ndarray, draws: np.random.Generator) -> np.ndarray | None:
    some = points[draws.choice(len(points), min(len(points), 256), replace=False)]
    a, b = some[0], some[1]
    for _ in range(3):
        near = ((some - a) ** 2).sum(axis=1) <= ((some - b) ** 2).sum(axis=1)
        if near.all() or not near.any():
            break
        a, b = some[near].mean(axis=0), some[~near].mean(axis=0)
    length = np.linalg.norm(a - b)
    return (a - b) / length if length > 0 else None


def distinct(sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct vectors in the order of their first copies, and how many copies of each there are.

    Cuts through copies would leave lopsided trees, and copies would use up the share.
    """
    vectors, first, copies = np.unique(sample, axis=0, return_index=True, return_counts=True)
    order = np.argsort(first)
    return vectors[order], copies[order]


def probed(trees: list[Tree], query: np.ndarray, sample: int, share: float) -> list[tuple[int, int]]:
    """(tree, leaf) pairs in the order in which one queue over all trees reaches them."""
    margins = [(tree.normal @ query - tree.cut).tolist() for tree in trees]
    queue = [(-np.inf, number, 0 if len(tree.cut) else -1) for number, tree in enumerate(trees)]
    covered, found = np.zeros(sample, dtype=bool), []
    left = share * sample
    while queue and left > 0:
        far, number, node = heapq.heappop(queue)
        tree = trees[number]
        while node >= 0:
            margin = margins[number][node]
            near = int(margin > 0)
            heapq.heappush(queue, (max(far, abs(margin)), number, int(tree.children[node, 1 - near])))
            node = int(tree.children[node, near])
        members = tree.leaves[-1 - node]
        left -= len(members) - int(covered[members].sum())
        covered[members] = True
        found.append((number, -1 - node))
    return found


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), size)


def neighbours(vectors: DataFrame, every: int = 100, k: int = 10, share: float = SHARE, trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id and score (distance) of the ``k`` nearest found for each vec_id divisible by ``every``."""
    spark = vectors.sparkSession
    result = "query_id long, rank int, vec_id long, score double"
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    n = rows.count()
    drawn = rows if n <= sample else rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < F.lit(int((1 << 20) * sample / n)))
    points = drawn.orderBy("vec_id", "embedding").select("embedding").toArrow().column(0).to_pylist()
    if not points:
        return spark.createDataFrame([], result)
    size = min(Counter(map(len, points)).items(), key=lambda x: (-x[1], x[0]))[0]
    points, copies = distinct(np.array([p for p in points if len(p) == size]))
    draws = np.random.default_rng(31)
    forest = [grow(points, draws) for _ in range(trees)]
    # How many tasks share a leaf, by its share of the sample.
    parts = [[-(-int(copies[leaf].sum()) * n // int(copies.sum()) // TOGETHER) for leaf in tree.leaves] for tree in forest]
    known = spark.sparkContext.broadcast((forest, parts, len(points)))
    key = "tree int, leaf int, part int"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, parts, _ = known.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, content = batch.column(0).to_numpy(), _matrix(batch.column(1), size)
            out = []
            for number, tree in enumerate(forest):
                leaf = tree.place(content)
                part = ids % np.array(parts[number])[leaf]
                order = np.lexsort((part, leaf))
                ends = np.flatnonzero(np.concatenate([(np.diff(leaf[order]) != 0) | (np.diff(part[order]) != 0), [True]])) + 1
                for own in np.split(order, ends[:-1]):
                    out.append((number, int(leaf[own[0]]), int(part[own[0]]), ids[own].tobytes(), content[own].astype(np.float64).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)],
                                             ["tree", "leaf", "part", "ids", "content"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, parts, total = known.value
        for batch in batches:
            content = _matrix(batch.column(1), size)
            out = [(t, leaf, part, query, vector.tobytes()) for query, vector in zip(batch.column(0).to_pylist(), content, strict=True)
                   for t, leaf in probed(forest, vector, total, share) for part in range(parts[t][leaf])]
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)],
                                             ["tree", "leaf", "part", "query_id", "vector"])

    def rank(there: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if there.num_rows and asked.num_rows:
            ids = np.frombuffer(b"".join(there.column("ids").to_pylist()), dtype=np.int64)
            content = np.frombuffer(b"".join(there.column("content").to_pylist()), dtype=np.float64).reshape(len(ids), size)
            for query, vector in zip(asked.column("query_id").to_pylist(), asked.column("vector").to_pylist(), strict=True):
                squares = ((content - np.frombuffer(vector)) ** 2).sum(axis=1)
                order = nearest(ids, squares, query, k)
                out.append((query, ids[order].tobytes(), np.sqrt(squares[order]).tobytes()))
        return pa.table({"query_id": pa.array([o[0] for o in out], pa.int64()), "ids": pa.array([o[1] for o in out], pa.binary()), "scores": pa.array([o[2] for o in out], pa.binary())})

    def merge(found: pa.Table) -> pa.Table:
        ids = np.frombuffer(b"".join(found.column("ids").to_pylist()), dtype=np.int64)
        scores = np.frombuffer(b"".join(found.column("scores").to_pylist()), dtype=np.float64)
        query = found.column("query_id")[0].as_py()
        order = nearest(ids, scores, query, k)
        return pa.table({"query_id": pa.array([query] * len(order), pa.int64()), "rank": pa.array(range(1, len(order) + 1), pa.int32()), "vec_id": ids[order], "score": scores[order]})

    fit = rows.where(F.size("embedding") == size)
    placed = fit.mapInArrow(place, f"{key}, ids binary, content binary").groupBy("tree", "leaf", "part")
    asked = fit.where(F.col("vec_id") % every == 0).mapInArrow(ask, f"{key}, query_id long, vector binary").groupBy("tree", "leaf", "part")
    return placed.cogroup(asked).applyInArrow(rank, "query_id long, ids binary, scores binary").groupBy("query_id").applyInArrow(merge, result)


def nearest(ids: np.ndarray, scores: np.ndarray, query: int, k: int) -> np.ndarray:
    """Places of the ``k`` smallest scores of different ids other than the query's, ties to the smaller id."""
    order = np.flatnonzero(ids != query)
    order = order[np.lexsort((ids[order], scores[order]))]
    # Of one id the first place counts.
    first = np.sort(np.unique(ids[order], return_index=True)[1])
    return order[first[:k]]
