"""Raw simulation logs, one folder each: a manifest, and a generation of contact lines, a state array and a header.

    <log>/manifest.json
    <log>/generations/<generation>/contacts.jsonl, states.npy, metadata.json

Files are rows (log, name, content), read by Spark's own file source so that any store will do, or bundles: one row per log
with an array ``files`` of (name, content). Every payload is checked for size and digest against its manifest before it is
parsed, in a bundle without any shuffle; a log that fails stops the reading job, or is listed with its first fault by
:func:`faults`.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenelake.functions import vectors as V
from scenelake.session import shares

VERSION = "1.0"
MANIFEST = "manifest.json"
PAYLOADS = ("contacts.jsonl", "states.npy", "metadata.json")
HEADER_KEYS = ("branch", "object_ids", "steps", "step_rate", "commanded_path", "metadata", "schema_version")
RECORD = ("step INT, object_a STRING, object_b STRING, position ARRAY<DOUBLE>, normal ARRAY<DOUBLE>, normal_force DOUBLE, "
          "contact_distance DOUBLE, schema_version STRING")
#: A record may leave these out.
OPTIONAL = ("contact_distance", "schema_version")
HEADER = "branch STRING, object_ids ARRAY<STRING>, steps ARRAY<INT>, step_rate DOUBLE, schema_version STRING"
STATES = "log STRING, step INT, object_id STRING, position ARRAY<DOUBLE>, quaternion ARRAY<DOUBLE>, linear_velocity ARRAY<DOUBLE>, angular_velocity ARRAY<DOUBLE>"
_ENTRIES = "schema_version STRING, generation STRING, files MAP<STRING, STRUCT<path: STRING, sha256: STRING, size: BIGINT>>"


def files(spark: SparkSession, root: str) -> DataFrame:
    """log, name and content of every file of the logs below ``root``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    below = r"([^/]+)/(manifest\.json|generations/[^/]+/[^/]+)$"
    return found.select(*[F.regexp_extract("path", below, i + 1).alias(n) for i, n in enumerate(("log", "name"))], "content").where("name != ''")


def _text(content: Column) -> Column:
    return content.cast("string")


def _keys(text: Column) -> Column:
    return F.array_sort(F.json_object_keys(text))


def _names(*names: str) -> Column:
    return F.array(*[F.lit(n) for n in sorted(names)])


def _manifests(rows: DataFrame, found: str | None = None) -> DataFrame:
    """One row per log with an entry for each payload that its manifest should list: what it says, and the manifest's own fault.

    A column ``found`` of the manifests' rows comes along.
    """
    text = _text(F.col("content"))
    kept = [F.col(found).alias("found")] if found else []
    read = rows.where(F.col("name") == MANIFEST).select("log", *kept, F.from_json(text, _ENTRIES).alias("m"), _keys(text).alias("keys"),
                                                        F.get_json_object(text, "$.files").alias("listed"))
    shaped = F.coalesce((F.col("keys") == _names("files", "generation", "schema_version")) & (_keys(F.col("listed")) == _names(*PAYLOADS)), F.lit(False))
    named = F.coalesce(F.col("m.generation").rlike("^[0-9a-f]{64}$"), F.lit(False))
    whole = F.sha2(F.concat(*[F.col("m.files")[p]["sha256"] for p in PAYLOADS]), 256)
    fault = (F.when(~shaped, "manifest: fields").when(~named, "manifest: generation")
             .when(~F.coalesce(F.col("m.schema_version") == VERSION, F.lit(False)), "manifest: version"))
    each = read.select("log", *["found" for _ in kept], fault.alias("fault"), F.col("m.generation").alias("generation"), (F.col("m.generation") == whole).alias("whole"), F.col("m.files").alias("files"))

    def entry(file: str) -> Column:
        path = F.concat(F.lit("generations/"), "generation", F.lit(f"/{file}"))
        said = F.element_at("files", F.lit(file))
        placed = F.coalesce(said["path"] == path, F.lit(False))
        return F.struct(F.lit(file).alias("file"), path.alias("name"), said["sha256"].alias("sha256"), said["size"].alias("size"), "whole",
                        F.coalesce("fault", F.when(~placed, f"manifest: path of {file}")).alias("fault"))

    return each.select("log", *["found" for _ in kept], F.array(*[entry(p) for p in PAYLOADS]).alias("entries"))


def _entries(rows: DataFrame, found: str | None = None) -> DataFrame:
    """The entries of :func:`_manifests`, one row each."""
    return _manifests(rows, found).select("log", *(["found"] if found else []), F.inline_outer("entries"))


def _payload_fault(there: Column, intact: Column, entry: Callable[[str], Column] = F.col) -> Column:
    return (F.when(entry("fault").isNotNull(), entry("fault")).when(~F.coalesce(there, F.lit(False)), F.concat(F.lit("missing: "), entry("file")))
            .when(~F.coalesce(intact, F.lit(False)), F.concat(F.lit("altered: "), entry("file")))
            .when(~F.coalesce(entry("whole"), F.lit(False)), "manifest: digest of the generation"))


def _checked(content: Column, entry: Callable[[str], Column] = F.col) -> Column:
    """The fault of a payload whose content was found (null: not) for an entry."""
    return _payload_fault(content.isNotNull(), (F.length(content) == entry("size")) & (F.sha2(content, 256) == entry("sha256")), entry)


def _or_empty(content: Column, size: Column) -> Column:
    # Spark's file sources pass over files without bytes, so one that should have none is taken as there.
    return F.coalesce(content, F.when(size == 0, F.lit(b"")))


def _stop_at(fault: Column) -> Column:
    return F.raise_error(F.concat(F.lit("log "), "log", F.lit(": "), fault))


def _is_bundled(rows: DataFrame) -> bool:
    return "files" in rows.columns


def unbundled(bundles: DataFrame) -> DataFrame:
    """log, name and content of every file of bundles."""
    return bundles.select("log", F.inline_outer("files")).where("name IS NOT NULL")


def _from_files(entries: DataFrame, rows: DataFrame, file: str) -> DataFrame:
    """Rows of one payload's entries, their content found among the files; evaluating one that is not intact is an error."""
    there = rows.where(F.col("name").endswith(f"/{file}"))
    found = entries.where(F.col("file") == file).join(there, ["log", "name"], "left").withColumn("content", _or_empty(F.col("content"), F.col("size")))
    found = found.withColumn("fault", _checked(F.col("content")))
    return found.withColumn("content", F.when(F.col("fault").isNotNull(), _stop_at(F.col("fault")).cast("binary")).otherwise(F.col("content")))


def _from_bundles(bundles: DataFrame, *names: str) -> DataFrame:
    """log and the contents of some payloads as ``_0``, ``_1``...; evaluating one that is not intact is an error."""
    own = lambda files, name: F.get(F.filter(files, lambda f: f["name"] == name), F.lit(0))["content"]
    tops = bundles.select("log", F.lit(MANIFEST).alias("name"), own("files", F.lit(MANIFEST)).alias("content"), "files").where("content IS NOT NULL")
    listed = _manifests(tops, "files").select("log", "found", *[F.col("entries")[PAYLOADS.index(n)].alias(f"entry{i}") for i, n in enumerate(names)])
    of = lambda i: lambda field: F.col(f"entry{i}.{field}")
    read = listed.select("log", *[f"entry{i}" for i in range(len(names))], *[_or_empty(own("found", of(i)("name")), of(i)("size")).alias(f"_{i}") for i in range(len(names))])
    judged = read.withColumns({f"fault{i}": _checked(F.col(f"_{i}"), of(i)) for i in range(len(names))})
    return judged.select("log", *[F.when(F.col(f"fault{i}").isNotNull(), _stop_at(F.col(f"fault{i}")).cast("binary")).otherwise(F.col(f"_{i}")).alias(f"_{i}") for i in range(len(names))])


def _intact(rows: DataFrame, file: str) -> DataFrame:
    """log and content of one payload of all logs; evaluating the content of a log that is not intact is an error."""
    if _is_bundled(rows):
        return _from_bundles(rows, file).select("log", F.col("_0").alias("content"))
    return _from_files(_entries(rows), rows, file).select("log", "content")


def _stopping(df: DataFrame, column: str, fault: Column) -> DataFrame:
    """``df`` whose ``column`` is an error on rows with a fault."""
    return df.withColumn(column, F.when(fault.isNotNull(), _stop_at(fault).cast(df.schema[column].dataType)).otherwise(F.col(column)))


def _header(text: Column) -> tuple[Column, Column]:
    """A header's fields and fault."""
    keys = _keys(text)
    parsed = F.from_json(text, HEADER)
    fault = (F.when(keys.isNull(), "metadata: no object").when(keys != _names(*HEADER_KEYS), "metadata: fields")
             .when(~F.coalesce(parsed["schema_version"] == VERSION, F.lit(False)), "metadata: version")
             .when(parsed["steps"].isNull() | parsed["object_ids"].isNull() | parsed["branch"].isNull() | parsed["step_rate"].isNull(), "metadata: values"))
    return parsed, fault


def _headers(content: DataFrame) -> DataFrame:
    header, fault = _header(_text(F.col("content")))
    return content.select("log", header.alias("header"), fault.alias("fault"))


def _lines(content: DataFrame, keys: Sequence[str] = ("log",)) -> DataFrame:
    """The keys of a file, line (from 1), record and fault of every contact line."""
    text = _text(F.col("content"))
    ended = F.when(text.endswith("\n"), F.left(text, F.length(text) - 1)).otherwise(text)
    split = F.when(F.length("content") > 0, F.split(F.when(F.is_valid_utf8(text), ended).otherwise("�"), "\n", -1))
    # Outer: else the optimiser filters on what is split, and works out contents and their digests a second time for that.
    lines = content.select(*keys, F.posexplode_outer(split).alias("at", "text")).where("text IS NOT NULL")
    # Columns of their own, so that each line is parsed once and not for every rule.
    lines = lines.withColumns({"_keys": F.json_object_keys("text"), "record": F.from_json("text", RECORD)})
    present, record = F.col("_keys"), F.col("record")
    known = [f.split()[0] for f in RECORD.split(", ")]
    required = F.array(*[F.lit(k) for k in known if k not in OPTIONAL])
    finite = reduce(lambda a, b: a & b, [(F.size(record[c]) == 3) & V.is_finite(F.get(record[c], F.lit(i))) for c in ("position", "normal") for i in range(3)])
    sound = (record["step"] >= 0) & (F.length(record["object_a"]) > 0) & (F.length(record["object_b"]) > 0) & (record["object_a"] != record["object_b"]) & finite
    sound = sound & V.is_finite(record["normal_force"]) & (record["normal_force"] >= 0) & (record["contact_distance"].isNull() | V.is_finite(record["contact_distance"]))
    sound = sound & (F.coalesce(record["schema_version"], F.lit(VERSION)) == VERSION)
    what = (F.when(F.trim("text") == "", "blank").when(present.isNull(), "no object")
            .when((present != _names(*known)) & ((F.size(F.array_except(present, F.array(*[F.lit(k) for k in known]))) > 0) | (F.size(F.array_except(required, present)) > 0)), "fields")
            .when(~F.coalesce(sound, F.lit(False)), "values"))
    # Null where nothing is wrong.
    return lines.select(*keys, (F.col("at") + 1).alias("line"), "record", F.concat(F.lit("contacts: "), what, F.lit(" in line "), F.col("at") + 1).alias("fault"))


def _loaded(content: bytes) -> tuple[np.ndarray | None, str | None]:
    stream = io.BytesIO(content)
    try:
        array = np.load(stream, allow_pickle=False)
    except (TypeError, ValueError, OSError, EOFError):
        return None, "states: no array"
    if stream.read(1):
        return None, "states: bytes after the array"
    return (array, None) if isinstance(array, np.ndarray) and array.dtype.kind in "fiu" else (None, "states: no numbers")


def _array(content: bytes, steps: int, objects: int) -> tuple[np.ndarray | None, str | None]:
    array, fault = _loaded(content)
    if fault:
        return None, fault
    if array.shape != (steps, objects, 13):
        return None, "states: shape"
    return (array.astype(np.float64), None) if np.isfinite(array).all() else (None, "states: values")


@F.pandas_udf(T.StructType([T.StructField("fault", T.StringType()), T.StructField("shape", T.StringType()), T.StructField("finite", T.BooleanType())]))
def _array_facts(content: pd.Series) -> pd.DataFrame:
    """What an array says of itself, whatever header it belongs to."""
    found = []
    for c in content:
        try:
            array, fault = _loaded(c)
        except Exception:  # noqa: BLE001 - bytes that no digest vouches for may be anything
            array, fault = None, "states: no array"
        found.append((fault, None, None) if fault else (None, ",".join(map(str, array.shape)), bool(np.isfinite(array).all())))
    return pd.DataFrame(found, columns=["fault", "shape", "finite"])


_FACTS = {"text": "string", "sha256": "string", "size": "bigint", "fault": "string", "steps": "int", "objects": "int", "shape": "string", "finite": "boolean"}


def _facts(rows: DataFrame) -> DataFrame:
    """What faults depend on, by log and name of a file: its digest and size, and what its own content says.

    Each content is judged in the scan that reads it, before it is known what it should be, and goes no further.
    """
    top, file = F.col("name") == MANIFEST, F.substring_index("name", "/", -1)
    shaped = lambda df, **facts: df.select("log", "name", *[facts.get(n, F.lit(None)).cast(t).alias(n) for n, t in _FACTS.items()])
    header, fault = _header(F.when(~top & (file == "metadata.json"), _text(F.col("content"))))
    head = ~top & (file == "metadata.json")
    digests = shaped(rows, text=F.when(top, _text(F.col("content"))), sha256=F.when(~top, F.sha2("content", 256)), size=F.when(~top, F.length("content")),
                     fault=F.when(head, fault), steps=F.when(head, F.size(header["steps"])), objects=F.when(head, F.size(header["object_ids"])))
    arrays = rows.where(~top & (file == "states.npy")).select("log", "name", _array_facts("content").alias("f")).select("log", "name", "f.*")
    lines = _lines(rows.where(~top & (file == "contacts.jsonl")), ("log", "name"))
    lines = lines.groupBy("log", "name").agg(F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("line"))).alias("fault"))
    col = lambda *names: {n: F.col(n) for n in names}
    return digests.unionByName(shaped(arrays, **col("fault", "shape", "finite"))).unionByName(shaped(lines, **col("fault")))


def faults(rows: DataFrame) -> DataFrame:
    """log and reason: the first fault of each log that is not sound. A log's files without a manifest are a fault too.

    No content is shuffled: what :func:`_facts` finds of a log's few files meets in one row.
    """
    rows = unbundled(rows) if _is_bundled(rows) else rows
    per_log = _facts(rows).groupBy("log").agg(F.max("text").alias("content"), F.count_if(F.col("name") == MANIFEST).alias("tops"),
                                              F.collect_list(F.when(F.col("name") != MANIFEST, F.struct("name", *[n for n in _FACTS if n != "text"]))).alias("files"))
    listed = _entries(per_log.select("log", F.lit(MANIFEST).alias("name"), "content", F.struct("files", "tops").alias("found")), "found")
    own = F.filter("found.files", lambda f: f["name"] == F.col("name"))
    judged = listed.withColumns({"digest": F.get(F.filter(own, lambda f: f["sha256"].isNotNull()), F.lit(0)), "said": F.get(F.filter(own, lambda f: f["sha256"].isNull()), F.lit(0))})
    # Spark's file sources pass over files without bytes, so one that should have none is taken as there.
    empty = F.col("digest").isNull() & (F.col("size") == 0)
    sha256 = F.when(empty, F.sha2(F.lit(b""), 256)).otherwise(F.col("digest.sha256"))
    fault = F.when(F.col("found.tops") == 0, "missing: manifest.json").otherwise(_payload_fault(empty | F.col("digest").isNotNull(), (F.coalesce("digest.size", F.lit(0)) == F.col("size")) & (sha256 == F.col("sha256"))))
    content = F.when(F.col("file") == "metadata.json", F.when(empty, "metadata: no object").otherwise(F.col("digest.fault"))).when(
        F.col("file") == "states.npy", F.when(empty, "states: no array").otherwise(F.col("said.fault"))).otherwise(F.col("said.fault"))
    judged = judged.select("log", "file", fault.alias("fault"), content.alias("own"), "digest.steps", "digest.objects", "said.shape", "said.finite")
    of = lambda name, column: F.max(F.when(F.col("file") == name, F.col(column)))
    each = judged.groupBy("log").agg(*[of(p, c).alias(f"{c}{i}") for i, p in enumerate(PAYLOADS) for c in ("fault", "own")], of("metadata.json", "steps").alias("steps"),
                                     of("metadata.json", "objects").alias("objects"), of("states.npy", "shape").alias("shape"), of("states.npy", "finite").alias("finite"))
    contact, state, head = range(len(PAYLOADS))
    fits = F.col("shape") == F.concat_ws(",", "steps", "objects", F.lit(13))
    reason = F.coalesce(*[f"fault{i}" for i in range(len(PAYLOADS))], f"own{head}", f"own{state}", F.when(~fits, "states: shape"), F.when(~F.col("finite"), "states: values"), f"own{contact}")
    return each.select("log", reason.alias("reason")).where("reason IS NOT NULL")


def headers(rows: DataFrame) -> DataFrame:
    """log and the header's fields."""
    return _stopping(_headers(_intact(rows, "metadata.json")), "header", F.col("fault")).select("log", "header.*")


def contacts(rows: DataFrame) -> DataFrame:
    """log and the contact records in canonical order of endpoints (the normal turns with them)."""
    found = _stopping(_lines(_intact(rows, "contacts.jsonl")), "record", F.col("fault")).select("log", "record.*")
    turned = F.col("object_b") < F.col("object_a")
    normal = F.when(turned, F.transform("normal", lambda x: F.when(x == 0, 0.0).otherwise(-x))).otherwise(F.col("normal"))
    return found.select("log", "step", F.least("object_a", "object_b").alias("object_a"), F.greatest("object_a", "object_b").alias("object_b"), "position", normal.alias("normal"),
                        "normal_force", "contact_distance")


def states(rows: DataFrame, rows_per_batch: int = 65536) -> DataFrame:
    """One row per log, step and object, under the header's names."""
    schema = pa.schema([("log", pa.string()), ("step", pa.int32()), ("object_id", pa.string()), *[(n, pa.list_(pa.float64())) for n in ("position", "quaternion", "linear_velocity", "angular_velocity")]])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                log, content, steps, objects = (batch.column(j)[i].as_py() for j in range(4))
                array, fault = _array(content, len(steps), len(objects))
                if fault:
                    raise ValueError(f"log {log}: {fault}")
                flat, at, names = array.reshape(-1, 13), np.asarray(steps, dtype=np.int32), pa.array(objects, pa.string())
                for start in range(0, len(flat), rows_per_batch):
                    piece = flat[start : start + rows_per_batch]
                    index = np.arange(start, start + len(piece))
                    lanes = [pa.ListArray.from_arrays(np.arange(len(piece) + 1, dtype=np.int32) * (b - a), piece[:, a:b].ravel()) for a, b in ((0, 3), (3, 7), (7, 10), (10, 13))]
                    yield pa.RecordBatch.from_arrays([pa.repeat(log, len(piece)), pa.array(at[index // len(objects)]), names.take(pa.array(index % len(objects))), *lanes], schema=schema)

    if _is_bundled(rows):
        both = _from_bundles(rows, "states.npy", "metadata.json")
        header, fault = _header(_text(F.col("_1")))
        named = _stopping(both.select("log", F.col("_0").alias("content"), header.alias("header"), fault.alias("fault")), "header", F.col("fault")).select("log", "content", "header.*")
    else:
        # The few entries meet their headers first, so that contents are shuffled only once.
        named = _from_files(_entries(rows).join(headers(rows).select("log", "steps", "object_ids"), "log"), rows, "states.npy")
    return named.select("log", "content", "steps", "object_ids").mapInArrow(decode, STATES)


_PACKED = "log STRING, branch STRING, object_ids ARRAY<STRING>, steps ARRAY<INT>, _0 STRING, _1 BINARY"


def _saved(log: str, text: pa.ChunkedArray, states: pa.Table, lanes: Sequence[str]) -> pa.Table:
    """A log's contact lines beside its states as an array file; no row where no step has all objects."""
    ids, step = states["object_id"], states["step"].to_numpy()
    if ids.null_count or states["step"].null_count:
        raise ValueError(f"log {log}: states without an object or a step")
    objects, place = np.unique(ids.to_numpy(), return_inverse=True)
    order = np.lexsort((place, step))
    step, place = step[order], place[order]
    if np.any((step[1:] == step[:-1]) & (place[1:] == place[:-1])):
        raise ValueError(f"log {log}: several states of an object in a step")
    steps, count = np.unique(step, return_counts=True)
    full = count == len(objects)
    rows = order[np.repeat(full, count)]
    stream = io.BytesIO()
    np.save(stream, np.stack([states[n].to_numpy().astype(np.float64)[rows] for n in lanes], axis=1).reshape(-1, len(objects), len(lanes)), allow_pickle=False)
    row = {"log": log, "branch": states["branch"][0].as_py(), "object_ids": objects.tolist(), "steps": steps[full].tolist(), "_0": text[0].as_py() if len(text) else None, "_1": stream.getvalue()}
    return pa.Table.from_pylist([row] if full.any() else [], _packed_schema())


def _packed_schema() -> pa.Schema:
    return pa.schema([("log", pa.string()), ("branch", pa.string()), ("object_ids", pa.list_(pa.string())), ("steps", pa.list_(pa.int32())), ("_0", pa.string()), ("_1", pa.binary())])


def bundled(contacts: DataFrame, states: DataFrame, step_rate: float) -> DataFrame:
    """Bundles (log, files) of the raw files of logs given as tables, one log for each with states.

    A log's objects are all that have states in it, its steps those at which each of them has one; other states and contacts
    without a log are left out. A log is one file of each kind by its format, so its rows meet in one row here: contacts
    and states are shuffled once each, and neither files nor headers are.
    """
    # Partitions by the size of the input, asked for once: all rows and contents of a log stay in its task.
    count = shares(contacts.select("log").unionByName(states.select("log")))
    fields = {c: F.col(c) for c in contacts.columns if c != "log"} | {"schema_version": F.lit(VERSION)}
    line = F.to_json(F.struct(*[fields[c].alias(c) for c in sorted(fields)]), {"ignoreNullFields": "false"})
    lines = contacts.repartition(count, "log").groupBy("log").agg(F.array_join(F.sort_array(F.collect_list(F.struct("step", line.alias("line"))))["line"], "\n").alias("text"))
    lanes = [(n, i) for n, size in (("position", 3), ("quaternion", 4), ("linear_velocity", 3), ("angular_velocity", 3)) for i in range(size)]
    flat = states.select("log", "branch", "step", "object_id", *[F.col(n)[i].alias(f"_{n}{i}") for n, i in lanes]).repartition(count, "log")
    def save(key: tuple[pa.Scalar, ...], lines: pa.Table, states: pa.Table) -> pa.Table:
        return _saved(key[0].as_py(), lines["text"], states, [f"_{n}{i}" for n, i in lanes]) if states.num_rows else _packed_schema().empty_table()

    kept = lines.groupBy("log").cogroup(flat.groupBy("log")).applyInArrow(save, _PACKED)
    own = F.struct(*[F.col(c) for c in ("branch", "object_ids", "steps")], F.lit(step_rate).cast("double").alias("step_rate"), F.lit(None).cast("array<double>").alias("commanded_path"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("metadata"), F.lit(VERSION).alias("schema_version"))
    head = F.concat(F.to_json(own, {"ignoreNullFields": "false"}), F.lit("\n")).cast("binary")
    text = F.when(F.col("_0").isNotNull(), F.concat("_0", F.lit("\n"))).otherwise("").cast("binary")
    return _sealed(kept.select("log", text.alias("_0"), "_1", head.alias("_2")))


def sealed(parts: DataFrame) -> DataFrame:
    """Payloads (log, file, content) under their generation's name, and the manifest of each log."""
    return unbundled(_sealed(parts.groupBy("log").agg(*[F.max(F.when(F.col("file") == p, F.col("content"))).alias(f"_{i}") for i, p in enumerate(PAYLOADS)])))


def _sealed(whole: DataFrame) -> DataFrame:
    """Bundles of logs given as one row each, with the contents of PAYLOADS as ``_0``, ``_1`` and ``_2``."""
    logs = whole.withColumns({f"sha256{i}": F.sha2(f"_{i}", 256) for i in range(len(PAYLOADS))}).withColumns({f"size{i}": F.length(f"_{i}") for i in range(len(PAYLOADS))})
    logs = logs.withColumn("generation", F.sha2(F.concat(*[f"sha256{i}" for i in range(len(PAYLOADS))]), 256))
    path = lambda name: F.concat(F.lit("generations/"), "generation", F.lit("/"), F.lit(name))
    listed = F.struct(*[F.struct(path(p).alias("path"), F.col(f"sha256{i}").alias("sha256"), F.col(f"size{i}").alias("size")).alias(p) for i, p in sorted(enumerate(PAYLOADS), key=lambda x: x[1])])
    manifest = F.concat(F.to_json(F.struct(listed.alias("files"), F.col("generation"), F.lit(VERSION).alias("schema_version"))), F.lit("\n"))
    files = [F.struct(path(p).alias("name"), F.col(f"_{i}").alias("content")) for i, p in enumerate(PAYLOADS)]
    there = F.filter(F.array(*files, F.struct(F.lit(MANIFEST).alias("name"), manifest.cast("binary").alias("content"))), lambda f: f["content"].isNotNull())
    return logs.select("log", there.alias("files"))
