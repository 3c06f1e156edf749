"""Deterministic identities, seeds and draws derived from SHA-256, plus name hashes."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUL = "\0"
_UNIT = float(1 << 56)


def _text(part: Column | int | float | str) -> Column:
    return (part if isinstance(part, Column) else F.lit(str(part))).cast("string")


def sha_text(*parts: Column | int | str) -> Column:
    """SHA-256 hex digest of the parts joined by a NUL character."""
    return F.sha2(F.concat_ws(_NUL, *[_text(p) for p in parts]), 256)


def derive_seed(master: Column | int, index: Column | int, domain: Column | str) -> Column:
    """Non-negative 63-bit seed, independent for each named domain."""
    head = F.conv(F.substring(sha_text(master, index, domain), 1, 16), 16, 10)
    return F.pmod(head.cast("decimal(20,0)"), F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("bigint")


def instance_id(master: Column | int, index: Column | int) -> Column:
    """Identifier known from (master, index) alone, so a resume needs no recomputation."""
    key = F.concat_ws("/", F.lit("velocity"), _text(master), _text(index))
    return F.concat(F.lit("instance_"), F.substring(F.sha2(key, 256), 1, 20))


def unit_draw(text: Column) -> Column:
    """Uniform draw in [0, 1) from the first seven bytes of the digest of ``text``."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 14), 16, 10).cast("bigint") / F.lit(_UNIT)


def draw(seed: Column, lane: int | str) -> Column:
    """One of many independent unit draws belonging to a seed."""
    return unit_draw(F.concat_ws(":", seed.cast("string"), F.lit(str(lane))))


def struct_digest(*columns: str) -> Column:
    """Digest of the named columns as compact JSON with sorted keys."""
    ordered = F.struct(*[F.col(name) for name in sorted(columns)])
    return F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}), 256)


@F.pandas_udf(T.StringType())
def canonical_json_digest(documents: pd.Series) -> pd.Series:
    """Digest of a JSON text re-serialised with sorted keys, compact, newline-terminated.

    Python's float spelling is part of the format, hence the Arrow-batched worker.
    """
    import hashlib

    def digest(text: str | None) -> str | None:
        if text is None:
            return None
        body = json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"),
                          ensure_ascii=False, allow_nan=False)
        return hashlib.sha256((body + "\n").encode("utf-8")).hexdigest()

    return documents.map(digest)


def content_instance_id(attempt: Column, seed: Column, scene: Column, path: Column, intervention: Column, effect: Column) -> Column:
    """Identifier of what an instance is made of: the digest of its canonical JSON, keys sorted at every depth.

    ``scene``, ``path`` and ``intervention`` are structs, maps or arrays of any depth; a null field counts as one.
    """
    parts = {"attempt_index": attempt, "expected_effect": effect, "factual_path": path, "instance_seed": seed, "intervention": intervention, "scene_config": scene}
    body = F.to_json(F.struct(*[value.alias(name) for name, value in parts.items()]), {"ignoreNullFields": "false"})
    return F.concat(F.lit("instance_"), F.substring(canonical_json_digest(body), 1, 20))


def _murmur3_32(data: bytes) -> int:
    """Public-domain MurmurHash3 x86 32-bit, seed 0."""
    mask = 0xFFFFFFFF
    state = 0
    body = len(data) - len(data) % 4
    words = [int(w) for w in np.frombuffer(data[:body], dtype="<u4")]
    tail = int.from_bytes(data[body:], "little")
    for position, word in enumerate(words + [tail]):
        word = (word * 0xCC9E2D51) & mask
        word = ((word << 15) | (word >> 17)) & mask
        state ^= (word * 0x1B873593) & mask
        if position < len(words):
            state = ((state << 13) | (state >> 19)) & mask
            state = (state * 5 + 0xE6546B64) & mask
    state ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        state = ((state ^ (state >> shift)) * factor) & mask
    return state ^ (state >> 16)


@F.pandas_udf(T.LongType())
def matte_hash(names: pd.Series) -> pd.Series:
    """Object-matte identifier of a name: Murmur3 kept representable as a normal float32."""

    def identifier(name: str | None) -> int | None:
        if name is None:
            return None
        value = _murmur3_32(name.encode("utf-8"))
        return value ^ (1 << 23) if (value >> 23) & 255 in (0, 255) else value

    return names.map(identifier).astype("Int64")
