"""Whitening of embeddings from singular values of the centred rows, without forming a covariance matrix.

Entries become whole numbers, so that sums, means and squared deviations are exact. Centred rows are reduced block by
block: each task folds its rows into one triangular factor, and factors are folded sixteen at a time until one is left.
The driver then works on that one matrix of dimension by dimension: Householder reflections make it bidiagonal, the
differential qd algorithm with shifts (dqds) finds the squared singular values to high relative accuracy, and twisted
factorisations give the direction of each, from the place in the matrix where it shows best.

Defined results: null vectors and vectors with a null or non-finite entry take no part, nor do those of another length
than the commonest (of equally common ones, the longest); entries beyond 2**62 are cut there; a deviation beyond a long
is null; directions without spread (fewer vectors than dimensions, copies) are no components, so equal vectors alone,
one vector or an empty table give no rows; rows that repeat a vec_id, and a null vec_id, are whitened each; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.llm.tables import scratch, stored

#: Whole numbers an entry is cut to, and what is added.
SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Triangular factors folded into one at a time.
FAN_IN = 16
#: Rows folded into a factor at a time.
BLOCK = 4096
#: Values that differ by less than this share are told apart by keeping their directions orthogonal.
CLOSE = 1e-4
_EPS = np.finfo(np.float64).eps
_LARGEST = 2.0**62


def bidiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and superdiagonal of U'AV, and the reflections that make up V, first one first."""
    a = matrix.copy()
    n = len(a)
    right = []
    for k in range(n):
        _reflect(a[k:, k:])
        if k < n - 2:
            right.append(_reflect(a[k:, k + 1 :].T))
    return a.diagonal().copy(), a.diagonal(1).copy(), right


def _reflect(part: np.ndarray) -> np.ndarray:
    """Makes the first column of ``part`` a multiple of the first axis, in place; the vector of the reflection."""
    v = part[:, 0].copy()
    size = np.linalg.norm(v)
    if size == 0:
        return v
    v[0] += np.copysign(size, v[0])
    v /= np.linalg.norm(v)
    part -= 2 * np.outer(v, v @ part)
    part[1:, 0] = 0
    return v


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]] | None:
    """One differential qd step with a shift: new q and e, and the d of each place; None if the shift was too large."""
    new_q, new_e, ds = [], [], []
    d = q[0] - shift
    for i in range(len(e)):
        if d < 0:
            return None
        ds.append(d)
        total = d + e[i]
        new_q.append(total)
        if total == 0:
            new_e.append(0.0)
            d = q[i + 1] - shift
        else:
            ratio = q[i + 1] / total
            new_e.append(e[i] * ratio)
            d = d * ratio - shift
    if d < 0:
        return None
    return [*new_q, d], new_e, [*ds, d]


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squared singular values of an upper bidiagonal matrix, in falling order.

    A shift is a lower bound of the least value left: the inverse of the sum of inverse d of an unshifted step, which is the
    trace of the inverse. Such shifts never overshoot but by rounding, and then the step is taken unshifted.
    """
    found: list[float] = []
    parts = [(list(map(float, diagonal**2)), list(map(float, above**2)), 0.0)]
    while parts:
        q, e, moved = parts.pop()
        while True:
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= _EPS * _EPS * (moved + min(q[i], q[i + 1])) or e[i] == 0), None)
            if cut is not None:
                parts.append((q[: cut + 1], e[:cut], moved))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if len(q) == 1:
                found.append(moved + q[0])
                break
            plain = _sweep(q, e, 0.0)
            if plain is None:  # rounding left a value below zero
                q = [max(x, 0.0) for x in q]
                continue
            q, e, ds = plain
            if min(ds) <= _EPS * moved:
                # The least value left is the shift itself, to rounding: the next unshifted steps part it from the rest.
                if q[-1] <= _EPS * moved:
                    found.append(moved + q[-1])
                    q, e = q[:-1], e[:-1]
                continue
            shift = (1 - 4 * _EPS) / sum(1 / d for d in ds)
            stepped = _sweep(q, e, shift)
            if stepped is not None:
                q, e, moved = stepped[0], stepped[1], moved + shift
    return np.sort(np.array(found))[::-1]


def twisted(diagonal: np.ndarray, above: np.ndarray, value: float) -> np.ndarray:
    """The right singular vector of an upper bidiagonal matrix for one squared singular value.

    The shifted product matrix is factored from its top and from its bottom; the vector starts at the place where both
    factorisations together leave least.
    """
    n = len(diagonal)
    scale = max(float(np.max(np.abs(diagonal), initial=0.0)) ** 2, 1e-300)
    tiny = scale * _EPS**3
    q = np.maximum(diagonal**2, tiny)
    low = above * np.sign(np.where(diagonal[:-1] == 0, 1, diagonal[:-1])) / np.sqrt(q[:-1])
    safe = lambda x: x if abs(x) > tiny else tiny
    down, s = np.empty(max(n - 1, 0)), np.empty(n)
    s[0] = -value
    for i in range(n - 1):
        down[i] = q[i] * low[i] / safe(s[i] + q[i])
        s[i + 1] = down[i] * low[i] * s[i] - value
    up, p = np.empty(max(n - 1, 0)), np.empty(n)
    p[-1] = q[-1] - value
    for i in range(n - 2, -1, -1):
        ratio = q[i] / safe(q[i] * low[i] ** 2 + p[i + 1])
        up[i] = low[i] * ratio
        p[i] = p[i + 1] * ratio - value
    start = int(np.abs(s + p + value).argmin())
    z = np.zeros(n)
    z[start] = 1.0
    for i in range(start - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(start, n - 1):
        z[i + 1] = -up[i] * z[i]
    return z / np.linalg.norm(z)


def directions(factor: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, float]:
    """The largest squared singular values, their right singular vectors (rows), and the sum of all of them."""
    size = len(factor)
    scale = float(np.abs(factor).max(initial=0.0))
    if scale == 0:
        return np.zeros(0), np.zeros((0, size)), 0.0
    diagonal, above, reflections = bidiagonal(factor / scale)
    values = dqds(diagonal, above)
    rank = int((values > values[0] * (size * _EPS) ** 2 * 4).sum())
    product = np.diag(diagonal**2 + np.concatenate([[0.0], above**2])) + np.diag(diagonal[:-1] * above, 1) + np.diag(diagonal[:-1] * above, -1)
    vectors: list[np.ndarray] = []
    for i in range(min(most, rank)):
        z = twisted(diagonal, above, values[i])
        near = [vectors[j] for j in range(i) if values[j] - values[i] <= CLOSE * values[j]]
        if near:
            z = _apart(z, np.array(near), product, values[i], i)
        vectors.append(z)
    turned = np.array(vectors)
    for k in range(len(reflections) - 1, -1, -1):
        v = reflections[k]
        turned[:, k + 1 :] -= 2 * np.outer(turned[:, k + 1 :] @ v, v)
    return values[: len(vectors)] * scale * scale, turned, float(values.sum()) * scale * scale


def _apart(z: np.ndarray, near: np.ndarray, product: np.ndarray, value: float, seed: int) -> np.ndarray:
    """A vector for a value that (nearly) repeats, orthogonal to those found for it before."""
    clear = lambda x: x - near.T @ (near @ x)
    rest = clear(clear(z))
    if np.linalg.norm(rest) < 0.5:
        rest = clear(np.random.default_rng(seed).standard_normal(len(z)))
    rest /= np.linalg.norm(rest)
    # Near the value, but not at it: the matrix stays regular, and other directions fade by the square root of the precision.
    shifted = product - value * (1 + np.sqrt(_EPS)) * np.eye(len(z))
    for _ in range(4):
        rest = clear(clear(np.linalg.solve(shifted, rest)))
        rest /= np.linalg.norm(rest)
    return rest


def _finite(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def fitted(vectors: DataFrame) -> tuple[DataFrame, int]:
    """vec_id and vector (doubles) of the rows that take part, and the vectors' length."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector")).where(_finite(F.col("vector")))
    common = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    size = common["size"] if common else 0
    return rows.where(F.size("vector") == size), size


def _whole(column: pa.Array, size: int) -> np.ndarray:
    """Rows of whole numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    return np.clip(np.floor(flat * SCALE), -_LARGEST, _LARGEST).astype(np.int64) + SHIFT


def _largest(x: np.ndarray) -> int:
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def _centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n * x - S, exactly: as long as it fits, else as Python's whole numbers."""
    if n * _largest(x) + max(map(abs, total)) < 1 << 62:
        return x * n - np.array(total, dtype=np.int64)
    return x.astype(object) * n - np.array(total, dtype=object)


def _deviations(centred: np.ndarray) -> list[int | None]:
    most = max(abs(int(centred.max())), abs(int(centred.min()))) if centred.size else 0
    if most * most * centred.shape[1] < 1 << 63:
        return (centred * centred).sum(axis=1).tolist()
    exact = (centred.astype(object) ** 2).sum(axis=1).tolist()
    return [value if value < 1 << 63 else None for value in exact]


def totals(rows: DataFrame, size: int) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * size
        for batch in batches:
            x = _whole(batch.column(0), size)
            own = x if len(x) * _largest(x) < 1 << 62 else x.astype(object)
            n, total = n + len(x), [a + int(b) for a, b in zip(total, own.sum(axis=0), strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(size + 1), pa.int32()), pa.array([*total, n], pa.decimal128(38, 0))], ["slot", "value"])

    found = rows.select("vector").mapInArrow(run, "slot int, value decimal(38,0)").groupBy("slot").agg(F.sum("value").alias("value")).collect()
    values = {row["slot"]: int(row["value"]) for row in found}
    return values.get(size, 0), [values.get(slot, 0) for slot in range(size)]


def _folded(blocks: list[np.ndarray], size: int) -> np.ndarray:
    out = np.linalg.qr(np.concatenate(blocks), mode="r")
    return out if len(out) == size else np.concatenate([out, np.zeros((size - len(out), size))])


def triangular(rows: DataFrame, size: int, n: int, total: list[int]) -> np.ndarray:
    """The triangular factor of all centred rows."""
    spark = rows.sparkSession
    folder = scratch(spark, "whitening")
    schema = "place long, factor binary"

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor, some = np.zeros((size, size)), False
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                x = _whole(batch.column(0).slice(at, BLOCK), size)
                factor, some = _folded([factor, _centred(x, n, total).astype(np.float64) / n], size), True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([factor.tobytes()], pa.binary())], ["place", "factor"])

    def fold(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("place").to_numpy())
        factors = table.column("factor").to_pylist()
        factor = _folded([np.frombuffer(factors[i]).reshape(size, size) for i in order], size)
        return pa.table({"place": [table.column("place")[0].as_py() // FAN_IN], "factor": pa.array([factor.tobytes()], pa.binary())})

    level, factors = 0, stored(rows.select("vector").mapInArrow(reduce, schema), f"{folder}/0")
    while factors.agg(F.max("place")).first()[0] > 0:
        level += 1
        factors = stored(factors.groupBy(F.floor(F.col("place") / FAN_IN).alias("group")).applyInArrow(fold, schema), f"{folder}/{level}")
    return np.frombuffer(factors.first()["factor"]).reshape(size, size)


def whitened(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """Per vector and component: vec_id, component, n, deviation, whitened, explained and identity_error."""
    spark = vectors.sparkSession
    rows, size = fitted(vectors)
    schema = "vec_id long, deviation long, parts array<double>"
    n, total = totals(rows, size) if size else (0, [])
    values, axes, trace = directions(triangular(rows, size, n, total), most) if n else (np.zeros(0), np.zeros((0, size)), 0.0)
    count = len(values)
    project = axes.T / np.sqrt(values / n) if count else None

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centred = _centred(_whole(batch.column(1), size), n, total)
            parts = centred.astype(np.float64) / n @ project
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, parts.size + 1, count), pa.int32()), pa.array(parts.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_deviations(centred), pa.int64()), lists], ["vec_id", "deviation", "parts"])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square = np.zeros((count + 1, count + 1))
        for batch in batches:
            parts = batch.column(0).flatten().to_numpy().reshape(-1, count)
            parts = np.concatenate([parts, np.ones((len(parts), 1))], axis=1)
            square += parts.T @ parts
        yield pa.RecordBatch.from_arrays([pa.array(range(square.size), pa.int32()), pa.array(square.reshape(-1))], ["slot", "value"])

    if not count:
        done, error = spark.createDataFrame([], schema), 0.0
    else:
        done = stored(rows.mapInArrow(turn, schema), f"{scratch(spark, 'whitening')}/rows")
        sums = done.select("parts").mapInArrow(products, "slot int, value double").groupBy("slot").agg(F.sum("value").alias("value")).toPandas()
        square = np.zeros((count + 1) ** 2)
        square[sums["slot"]] = sums["value"]
        square = square.reshape(count + 1, count + 1) / n
        mean = square[:-1, -1]
        error = float(np.abs(square[:-1, :-1] - np.outer(mean, mean) - np.eye(count)).max())
    shares = F.array(*(F.lit(float(value / trace)) for value in values)) if count else F.array(F.lit(0.0))
    out = done.select("vec_id", "deviation", F.posexplode("parts").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                      F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
