"""Near-duplicate classes by HyperMinHash sketches, banding and confirmation on full shingle sets.

A document's shingles fall into buckets; each bucket keeps the smallest hash as its number of leading zeros and a few
bits of mantissa. Buckets without a shingle borrow the register of the first filled one in an order of their own,
so that registers of small sets agree as often as those of large ones. Documents that agree in all registers of a
band are candidates. The share of agreeing registers, corrected for chance agreement, estimates the similarity of
a candidate pair; pairs that may reach the threshold are confirmed on their full shingle sets.

Large groups: documents of one word sequence are one class from the start, with one representative. Within a band's
bucket every member is compared with one head, not with every other; the confirmed links give components. Only then
are members of different components that share a bucket compared with each other, which leaves nothing out: every
pair of a bucket is either in one component already or compared.

Defined results: null and empty texts, and texts without words, have no shingles, are linked with nothing and are
components of their own; texts of any length are read whole; a null doc_id belongs to no pair and is its own
component, null; rows that repeat a doc_id are judged as one document with the words of any of them and returned
each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.llm import workers
from scenelake.llm.shingles import fingerprints, mixed, spans
from scenelake.llm.tables import pieces_for, scratch, slim, stored

#: Percent of the union that two sets must share.
PERCENT = 75
BANDS = 50
#: Registers in a band: their 16 bits each make one 64-bit key.
ROWS = 4
BUCKETS = BANDS * ROWS
MANTISSA = 10
#: Estimates so many standard deviations (for the registers in use) under the threshold are not confirmed.
DEVIATIONS = 5
#: Sets of up to so many shingles travel whole beside their sketch; two of them are compared exactly at once.
FEW = 64
#: Members of one bucket, and sets of one group, that are compared in a task at a time.
TOGETHER = 2048
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _orders(buckets: int = BUCKETS) -> np.ndarray:
    """For each bucket an order of all buckets, starting with itself: rank[bucket, other]."""
    draws = np.random.default_rng(2718)
    rank = np.argsort(draws.random((buckets, buckets)), axis=1).argsort(axis=1).astype(np.int16) + 1
    rank[np.arange(buckets), np.arange(buckets)] = 0
    return rank


_RANK = _orders()


def registers(owner: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Registers (n by buckets, 16 bits) of n sets, and which of them hold a shingle of their own."""
    bucket = ((value & np.uint64(0xFFFFFFFF)) * np.uint64(BUCKETS) >> np.uint64(32)).astype(np.int64)
    least = np.full(n * BUCKETS, _NONE)
    np.minimum.at(least, owner * BUCKETS + bucket, mixed(value ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(1))
    least = least.reshape(n, BUCKETS)
    own = least != _NONE
    exponent = np.frexp(np.maximum(least, np.uint64(1)).astype(np.float64))[1]
    zeros = np.clip(63 - exponent, 0, 62).astype(np.uint64)
    mantissa = (least << (zeros + np.uint64(2))) >> np.uint64(64 - MANTISSA)
    sketch = ((zeros << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)
    for row in np.flatnonzero(own.any(axis=1) & ~own.all(axis=1)):
        filled, empty = np.flatnonzero(own[row]), np.flatnonzero(~own[row])
        sketch[row, empty] = sketch[row, filled[_RANK[empty[:, None], filled].argmin(axis=1)]]
    return sketch, own


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """One 64-bit key per set and band."""
    packed = np.ascontiguousarray(sketch).view(np.uint64).reshape(len(sketch), BANDS)
    return mixed(packed ^ mixed(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def estimated(a: np.ndarray, b: np.ndarray, own_a: np.ndarray, own_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of pairs of sketches (rows), corrected for registers that agree by chance.

    The expected share of chance agreements is the published approximation 0.1699 * 2**-bits * phi, with phi from
    the ratio of the sets' sizes.
    """
    used = own_a | own_b
    agree = ((a == b) & used).sum(axis=1) / np.maximum(used.sum(axis=1), 1)
    ratio = np.maximum(n_a, n_b) / np.maximum(np.minimum(n_a, n_b), 1)
    chance = 0.169919487159739 * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2
    return (agree - chance) / (1 - chance)


def may_reach(value: np.ndarray, own_a: np.ndarray, own_b: np.ndarray) -> np.ndarray:
    """Whether an estimate leaves the threshold possible; sets with few registers always pass."""
    share = PERCENT / 100
    return value >= share - DEVIATIONS * np.sqrt(share * (1 - share) / np.maximum((own_a | own_b).sum(axis=1), 1))


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets of fingerprints share at least PERCENT of their union."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def few_linked(a: bytes, b: bytes) -> bool:
    """False only where both sets are small, hence given whole, and not linked."""
    return not a or not b or linked(np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64))


def sketches(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, digest of the word sequence, sketch, own (packed bits) and few (small sets, whole)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.release()
        for batch in batches:
            for at, end, data, offsets in spans(batch.column(1)):
                n = end - at
                owner, value = fingerprints(data, offsets)
                sketch, own = registers(owner, value, n)
                packed = np.packbits(own, axis=1)
                raw = data.tobytes()
                digests = [hashlib.sha256(b" ".join(raw[offsets[i] : offsets[i + 1]].lower().split())).digest() for i in range(n)]
                counts = np.bincount(owner, minlength=n)
                cuts = np.concatenate([[0], np.cumsum(counts)])
                few = [value[cuts[i] : cuts[i + 1]].tobytes() if counts[i] <= FEW else b"" for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), pa.array(counts), pa.array(digests, pa.binary()),
                     pa.array([row.tobytes() for row in sketch], pa.binary()), pa.array([row.tobytes() for row in packed], pa.binary()), pa.array(few, pa.binary())],
                    ["doc_id", "n_shingles", "digest", "sketch", "own", "few"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, sketch binary, own binary, few binary")


def _buckets(heads: DataFrame) -> DataFrame:
    """(key, doc_id) for every band of every sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint16).reshape(-1, BUCKETS))
                ids = np.repeat(np.asarray(batch.column(0)), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(ids)], ["key", "doc_id"])

    return heads.select("doc_id", "sketch").mapInArrow(run, "key long, doc_id long")


def _likely(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (a, b) whose estimated similarity may reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda name, kind: np.frombuffer(b"".join(batch.column(name).to_pylist()), dtype=kind).reshape(batch.num_rows, -1)
            own = [np.unpackbits(get(name, np.uint8), axis=1).astype(bool) for name in ("own_a", "own_b")]
            value = estimated(get("sketch_a", np.uint16), get("sketch_b", np.uint16), *own, np.asarray(batch.column("n_a")), np.asarray(batch.column("n_b")))
            good = may_reach(value, *own)
            few_a, few_b = (batch.column(name).to_pylist() for name in ("few_a", "few_b"))
            good = pa.array([bool(near) and few_linked(x, y) for near, x, y in zip(good, few_a, few_b, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], ["a", "b"])

    for side in ("a", "b"):
        half = known.select(F.col("doc_id").alias(side), F.col("sketch").alias(f"sketch_{side}"), F.col("own").alias(f"own_{side}"), F.col("few").alias(f"few_{side}"), F.col("n_shingles").alias(f"n_{side}"))
        pairs = pairs.join(half, side)
    return pairs.where(f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame) -> DataFrame:
    """doc_id and the sorted fingerprints of its whole shingle set, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in spans(batch.column(1)):
                owner, value = fingerprints(data, offsets)
                cuts = np.searchsorted(owner, np.arange(end - at + 1))
                content = [value[cuts[i] : cuts[i + 1]].tobytes() for i in range(end - at)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array(content, pa.binary())], ["doc_id", "content"])

    return docs.mapInArrow(run, "doc_id long, content binary")


def confirmed(path: str, docs: DataFrame, folder: str) -> DataFrame:
    """Of the pairs (a, b) stored at ``path`` those whose full sets share at least PERCENT of their union, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for left, right in zip(batch.column("content_a"), batch.column("content_b"), strict=True):
                good.append(linked(*(np.frombuffer(side.as_buffer(), dtype=np.uint64) for side in (left, right))))
            good = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], ["a", "b"])

    spark = docs.sparkSession
    ids = spark.read.schema("a long, b long").parquet(path).select(F.explode(F.array("a", "b")).alias("wanted")).distinct()
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    needed = texts.join(ids.hint("merge"), texts["doc_id"] == ids["wanted"], "left_semi")
    # Rows that repeat an id count once.
    stored(_sets(needed).groupBy("doc_id").agg(F.max("content").alias("content")), f"{folder}/sets")
    # Two sets ride on each row, and sets may be long.
    few = slim(spark)
    pairs, sets = few.read.schema("a long, b long").parquet(path), few.read.schema("doc_id long, content binary").parquet(f"{folder}/sets")
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("doc_id").alias(side), F.col("content").alias(f"content_{side}")), side)
    stored(pairs.mapInArrow(run, "a long, b long"), f"{folder}/edges")
    return spark.read.schema("a long, b long").parquet(f"{folder}/edges")


def _across(members: DataFrame, labels: DataFrame, reps: DataFrame, docs: DataFrame, folder: str) -> DataFrame:
    """Confirmed links between members of a bucket that are in different components so far.

    Within a bucket most members are in one component. The others, few as a rule, are sent to every part of the
    bucket; each part is compared inside its task. What leaves it is one row per document and group of partners, not
    one per pair, and these are confirmed where the partners' full sets are.
    """
    now = members.join(labels, "doc_id", "left").select("key", "doc_id", F.coalesce("label", "doc_id").alias("label"))
    sizes = now.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(
        F.max_by("label", F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("labels"), F.sum("n").alias("n"))
    open_ = sizes.where("labels > 1 and n > 2").select("key", "main", F.ceil(F.col("n") / TOGETHER).alias("parts"))
    rest = stored(now.join(open_, "key"), f"{folder}/rest")
    ids = rest.select("doc_id").distinct()
    sketched = rest.join(reps.join(ids, "doc_id", "left_semi"), "doc_id")
    part = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("long")
    here = sketched.withColumn("part", part).withColumn("sent", F.lit(False))
    sent = sketched.where("label != main").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("sent", F.lit(True))
    groups = pieces_for(ids.count(), TOGETHER // 8)

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        get = {n: table.column(n).to_numpy() for n in ("doc_id", "label", "main", "sent", "n_shingles")}
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint16).reshape(table.num_rows, BUCKETS)
        own = np.unpackbits(np.frombuffer(b"".join(table.column("own").to_pylist()), dtype=np.uint8).reshape(table.num_rows, -1), axis=1).astype(bool)
        keys, key, few = band_keys(sketch), table.column("key")[0].as_py(), table.column("few").to_pylist()
        local = np.flatnonzero(~get["sent"])
        group = mixed(get["doc_id"].astype(np.uint64)) % np.uint64(groups)
        rows: list[tuple[int, int, bytes]] = []
        for at in np.flatnonzero(get["sent"]):
            with_ = local[(get["label"][local] != get["label"][at]) & ((get["label"][local] == get["main"][local]) | (get["doc_id"][local] > get["doc_id"][at]))]
            if not len(with_):
                continue
            same = keys[with_] == keys[at]
            # A pair that meets in several bands is compared in the first of them.
            with_ = with_[keys[at].view(np.int64)[same.argmax(axis=1)] == key]
            n = get["n_shingles"]
            with_ = with_[100 * np.minimum(n[with_], n[at]) >= PERCENT * np.maximum(n[with_], n[at])]
            value = estimated(sketch[with_], sketch[at], own[with_], own[at], n[with_], np.full(len(with_), n[at]))
            with_ = with_[may_reach(value, own[with_], own[at])]
            with_ = with_[[few_linked(few[i], few[at]) for i in with_]] if few[at] else with_
            for number in np.unique(group[with_]):
                rows.append((int(get["doc_id"][at]), int(number), get["doc_id"][with_[group[with_] == number]].tobytes()))
        return pa.table({"a": pa.array([r[0] for r in rows], pa.int64()), "group": pa.array([r[1] for r in rows], pa.int64()), "partners": pa.array([r[2] for r in rows], pa.binary())})

    columns = ["key", "part", "sent", "doc_id", "label", "main", "n_shingles", "sketch", "own", "few"]
    likely = here.select(columns).unionByName(sent.select(columns)).groupBy("key", "part").applyInArrow(compare, "a long, group long, partners binary")
    likely = stored(likely, f"{folder}/likely")

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = mixed(batch.column(0).to_numpy().astype(np.uint64)) % np.uint64(groups)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number.astype(np.int64))], ["b", "content", "group"])

    def confirm(left: pa.Table, right: pa.Table) -> pa.Table:
        sets = {i: np.frombuffer(c.as_buffer(), dtype=np.uint64) for i, c in zip(left.column("b").to_pylist(), left.column("content"), strict=True)}
        found: list[tuple[int, int]] = []
        for a, content, partners in zip(right.column("a").to_pylist(), right.column("content_a"), right.column("partners"), strict=True):
            x = np.frombuffer(content.as_buffer(), dtype=np.uint64)
            for b in np.frombuffer(partners.as_buffer(), dtype=np.int64).tolist():
                if linked(x, sets[b]):
                    found.append((a, b))
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    texts = docs.select(F.col("doc_id").cast("long"), "text")
    needed = texts.join(ids.hint("merge").withColumnRenamed("doc_id", "wanted"), F.col("doc_id") == F.col("wanted"), "left_semi")
    sets = stored(_sets(needed).groupBy("doc_id").agg(F.max("content").alias("content")), f"{folder}/sets")
    asked = likely.join(sets.select(F.col("doc_id").alias("a"), F.col("content").alias("content_a")), "a")
    there = sets.mapInArrow(grouped, "b long, content binary, group long")
    return there.groupBy("group").cogroup(asked.groupBy("group")).applyInArrow(confirm, "a long, b long")


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(doc_id, label) of every document in an edge: the smallest id that it is connected with.

    Labels flow along edges, and each label is replaced by its own label, so that chains halve; every round is
    written to the shared folder.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{folder}/edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("doc_id"), F.least("a", "m").alias("label")), f"{folder}/labels0")
    turn = 0
    while True:
        turn += 1
        near = both.join(labels.withColumnRenamed("doc_id", "b"), "b").groupBy("a").agg(F.min("label").alias("least"))
        spread = labels.join(near, labels["doc_id"] == near["a"]).select("doc_id", "label", F.least("label", "least").alias("new"))
        up = labels.select(F.col("doc_id").alias("new"), F.col("label").alias("top"))
        jumped = spread.join(up, "new").select("doc_id", F.least("new", "top").alias("label"), (F.least("new", "top") != F.col("label")).alias("moved"))
        written = stored(jumped, f"{folder}/labels{turn}")
        labels = written.select("doc_id", "label")
        if written.where("moved").isEmpty():
            return labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id and kept."""
    spark = docs.sparkSession
    folder = scratch(spark, "hyperminhash")
    known = stored(sketches(docs), f"{folder}/sketches")
    classes = stored(known.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep")), f"{folder}/classes")
    reps = known.join(classes.hint("merge"), (known["digest"] == classes["digest"]) & (known["doc_id"] == classes["rep"]), "left_semi").dropDuplicates(["doc_id"])
    reps = stored(reps.drop("digest"), f"{folder}/reps")
    buckets = _buckets(reps)
    shared = buckets.groupBy("key").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("last")).where("head < last").select("key", "head")
    members = stored(buckets.join(shared, "key"), f"{folder}/members")

    pairs = stored(members.where("doc_id != head").select(F.col("head").alias("a"), F.col("doc_id").alias("b")).distinct(), f"{folder}/pairs")
    stored(_likely(pairs, reps), f"{folder}/likely")
    edges = confirmed(f"{folder}/likely", docs, f"{folder}/heads")
    labels = components(edges, f"{folder}/heads/components")
    more = stored(_across(members, labels, reps, docs, f"{folder}/across"), f"{folder}/across/edges")
    labels = components(edges.unionByName(more), f"{folder}/components")

    linked = classes.join(labels, classes["rep"] == labels["doc_id"], "left").select("digest", F.coalesce("label", "rep").alias("component"))
    rows = known.select("doc_id", "n_shingles", "digest").join(linked.hint("merge"), "digest", "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def kept(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class of near duplicates, the one with the smallest doc_id."""
    drop = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("_drop")).distinct()
    return docs.join(drop, docs["doc_id"] == drop["_drop"], "left_anti")
