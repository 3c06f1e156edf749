"""Quality of texts, learned from trusted good ones and unlabelled ones alone.

Bad labels are never read. Trusted positives are documents labelled good; the unlabelled set is every document. The
share of good texts among the unlabelled (the class prior) is estimated first: a classifier of trusted against
unlabelled texts orders all texts, and the least ratio of unlabelled to held-back trusted texts above a score bounds the
share (with a confidence term for small counts). Then a logistic model minimises the non-negative unbiased risk

    prior * E_trusted[loss(+)] + max(0, E_unlabelled[loss(-)] - prior * E_trusted[loss(-)])

whose gradient is replaced by that of climbing back where the bracket falls below zero, so that the model cannot gain by
calling trusted texts good beyond what the unlabelled ones allow. Features are surface forms of the whole text: how
often one class of bytes follows another, and how far words repeat. Sums over documents are made in Spark tasks in
fixed point, so that their order does not matter; the driver sees a few thousand numbers in a pass.

Defined results: null and empty texts are scored by the model at a text without bytes; without a trusted document or any
text every score is 0.5; a document with labels of both kinds is not trusted, labels other than 0 and 1 are not read;
rows that repeat a doc_id share its labels and are scored each; a null doc_id is never trusted and not held out; an
empty table gives no rows; lang, source and other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.llm.shingles import spans
from scenelake.llm.tables import remainder, scratch, stored

#: About so many trusted documents are learned from, chosen by a hash of their id.
SAMPLE = 20_000
#: Passes over all texts of the ordering model and of the final one.
ORDERING, ROUNDS = 8, 30
#: Weight of the squared coefficients, in units of the features' spread.
RIDGE = 1e-3
#: Bins of the scores from which the prior is read, and its confidence.
BINS, DOUBT = 512, 0.1
#: One in so many trusted documents is kept from the ordering model, for the prior.
HELD = 4
#: Standardised features are cut here; sums are kept in units of 1 / FIXED.
CUT, FIXED = 8.0, 1 << 20

#: Classes of bytes: line end, blank, lower case, capital, digit, sentence end, comma, quote or bracket, other sign, control, beyond ASCII.
CLASSES = 11
_CLASS = np.full(256, 10, dtype=np.int64)
_CLASS[:32] = 9
_CLASS[32:128] = 8
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 1
_CLASS[0x0A] = 0
_CLASS[ord("a") : ord("z") + 1] = 2
_CLASS[ord("A") : ord("Z") + 1] = 3
_CLASS[ord("0") : ord("9") + 1] = 4
_CLASS[[ord(c) for c in ".!?"]] = 5
_CLASS[[ord(c) for c in ",;:"]] = 6
_CLASS[[ord(c) for c in "'\"()-"]] = 7
#: Pairs of classes, words like the one before, distinct words, distinct lines, length.
FEATURES = CLASSES * CLASSES + 4


def features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES numbers per text."""
    out = np.zeros((len(column), FEATURES), dtype=np.float32)
    pairs = CLASSES * CLASSES
    for at, end, data, offsets in spans(column):
        n, size = end - at, np.diff(offsets)
        kind = _CLASS[data]
        owner = np.repeat(np.arange(n), size)
        inside = owner[1:] == owner[:-1]
        counts = np.bincount((owner[1:] * pairs + kind[:-1] * CLASSES + kind[1:])[inside], minlength=n * pairs).reshape(n, pairs)
        out[at:end, :pairs] = np.sqrt(counts / np.maximum(size, 1)[:, None])
        raw = data.tobytes()
        for i in range(n):
            text = raw[offsets[i] : offsets[i + 1]]
            words, lines = text.split(), text.split(b"\n")
            many = max(len(words), 1)
            out[at + i, pairs:] = sum(map(eq, words, words[1:])) / many, np.log1p(len(set(words))) / np.log1p(many), len(set(lines)) / len(lines), np.log1p(len(text))
    return out


def _standard(rows: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Standardised rows with a constant last column."""
    return np.concatenate([np.clip((rows - mean) / spread, -CUT, CUT), np.ones((len(rows), 1))], axis=1)


def _fixed(values: np.ndarray) -> np.ndarray:
    return np.rint(values * FIXED).astype(np.int64)




def losses(rows: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sums over rows: gradient and value of loss(-), of loss(+), and the number of rows."""
    z = rows @ weight
    chance = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    soft = np.logaddexp(0, z)
    return np.concatenate([chance @ rows, [soft.sum()], (chance - 1) @ rows, [(soft - z).sum()], [len(rows)]])


def minimised(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], step: np.ndarray, prior: float | None, rounds: int) -> np.ndarray:
    """Weights by accelerated descent; ``sums`` gives losses() of unlabelled and trusted rows, ``step`` bounds the curvature.

    Without a prior the two sets are told apart with equal weight; with one, the non-negative unbiased risk is minimised.
    """
    width = len(step)
    weight = ahead = np.zeros(width)
    pace = 1.0
    ridge = np.full(width, RIDGE)
    ridge[-1] = 0.0
    for _ in range(rounds):
        unlabelled, trusted = (total / total[-1] for total in sums(ahead))
        if prior is None:
            gradient = (unlabelled[:width] + trusted[width + 1 : 2 * width + 1]) / 2
        else:
            negative = unlabelled[:width] - prior * trusted[:width]
            below = unlabelled[width] - prior * trusted[width] < 0
            gradient = -negative if below else prior * trusted[width + 1 : 2 * width + 1] + negative
        after = ahead - step @ (gradient + ridge * ahead)
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead, weight, pace = after + (pace - 1) / faster * (after - weight), after, faster
    return weight


def prior_of(unlabelled: np.ndarray, trusted: np.ndarray) -> float:
    """The share of good texts among unlabelled ones, from both sets' counts per score bin (ascending scores)."""
    above = lambda counts: counts[::-1].cumsum() / max(counts.sum(), 1)
    u, p = above(unlabelled), above(trusted)
    slack = np.sqrt(np.log(4 / DOUBT) / 2) * (1 / np.sqrt(max(unlabelled.sum(), 1)) + 1 / np.sqrt(max(trusted.sum(), 1)))
    with np.errstate(divide="ignore", invalid="ignore"):
        bound = np.where(p > 0, (u + slack) / p, np.inf)
        at = int(bound.argmin())
        share = u[at] / p[at] if p[at] > 0 else 0.5
    return float(np.clip(share, 0.01, 0.99))


class Model:
    """What scores a text."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, weight: np.ndarray, prior: float) -> None:
        self.mean, self.spread, self.weight, self.prior = mean, spread, weight, prior

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_standard(rows, self.mean, self.spread) @ self.weight, -500, 500)))


def _total(rows: DataFrame, count: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sums of ``count(features, trusted)`` (``size`` fixed-point numbers) over stored rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                total += count(_matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["slot", "value"])

    found = rows.select("features", "trusted").mapInArrow(run, "slot int, value long").groupBy("slot").agg(F.sum("value").alias("value")).toPandas()
    total = np.zeros(size)
    total[found["slot"]] = found["value"]
    return total


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32).reshape(-1, FEATURES).astype(np.float64)


def trusted(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Ids of documents labelled good and never bad, outside the held-out third; about ``sample`` at most."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("quality"))
    known = known.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), 3) != 1))
    good = known.groupBy("doc_id").agg(F.min("quality").alias("least")).where("least = 1").select("doc_id")
    n = good.count()
    return good if n <= sample else good.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int((1 << 20) * sample / n)))


def described(docs: DataFrame, good: DataFrame) -> DataFrame:
    """Per row: doc_id, features as bytes and trusted: 0, 1 (learned from) or 2 (kept for the prior)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = pa.array([row.tobytes() for row in features(batch.column(1))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), content], ["doc_id", "features"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, features binary")
    part = F.when(F.pmod(F.xxhash64(F.lit("prior"), "doc_id"), F.lit(HELD)) == 0, 2).otherwise(1)
    # A bounded sample of ids.
    marks = F.broadcast(good.select("doc_id", part.alias("trusted")))
    return rows.join(marks, "doc_id", "left").select("doc_id", "features", F.coalesce("trusted", F.lit(0)).alias("trusted"))


def learn(rows: DataFrame) -> Model | None:
    """The model, from stored rows of described()."""
    size = FEATURES

    def moments(x: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return _fixed(np.concatenate([[len(x), (mark == 1).sum(), (mark == 2).sum()], x.sum(axis=0), (x * x).sum(axis=0)]))

    total = _total(rows, moments, 3 + 2 * size) / FIXED
    n, fitting, held = total[:3]
    if not fitting:
        return None
    mean = total[3 : 3 + size] / n
    spread = np.sqrt(np.maximum(total[3 + size :] / n - mean**2, 0)) + 1e-3
    upper = np.triu_indices(size + 1)

    def products(x: np.ndarray, _: np.ndarray) -> np.ndarray:
        z = _standard(x, mean, spread)
        return _fixed((z.T @ z)[upper])

    square = np.zeros((size + 1, size + 1))
    square[upper] = _total(rows, products, len(upper[0])) / FIXED / n
    square = square + square.T - np.diag(square.diagonal())
    # The logistic loss bends by a quarter of the second moments at most.
    step = np.linalg.inv(square / 4 + np.diag(np.full(size + 1, RIDGE)))

    def sums_of(held_too: bool) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
        width = 2 * (size + 2) + 1

        def sums(weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            def count(x: np.ndarray, mark: np.ndarray) -> np.ndarray:
                z = _standard(x, mean, spread)
                return _fixed(np.concatenate([losses(z, weight), losses(z[mark > 0 if held_too else mark == 1], weight)]))

            both = _total(rows, count, 2 * width)
            return both[:width], both[width:]

        return sums

    order = Model(mean, spread, minimised(sums_of(False), step, None, ORDERING), 0.5)

    def histogram(x: np.ndarray, mark: np.ndarray) -> np.ndarray:
        place = np.minimum((order.scores(x) * BINS).astype(np.int64), BINS - 1)
        return np.concatenate([np.bincount(place, minlength=BINS), np.bincount(place[mark == (2 if held else 1)], minlength=BINS)])

    bins = _total(rows, histogram, 2 * BINS)
    prior = prior_of(bins[:BINS], bins[BINS:])
    return Model(mean, spread, minimised(sums_of(True), step, prior, ROUNDS), prior)


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per row: doc_id, held_out, score and predicted. Labels with crc32(doc_id) mod 3 = 1 are never learned from."""
    spark = docs.sparkSession
    folder = scratch(spark, "quality")
    good = stored(trusted(labels, sample), f"{folder}/trusted")
    rows = stored(described(docs, good), f"{folder}/features")
    model = learn(rows)
    known = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = known.value.scores(_matrix(batch.column(1))) if known.value else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    out = rows.select("doc_id", "features").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
