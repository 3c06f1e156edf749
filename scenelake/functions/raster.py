"""Per-pixel encodings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TOP = 65535


def quantise(value: Column, low: Column, high: Column) -> Column:
    """Nearest 16-bit code, ties to even."""
    return F.bround((value - low) / (high - low) * TOP).cast("int")


def quantise_truncated(value: Column, low: Column, high: Column) -> Column:
    """16-bit code rounded towards zero, as the frame writer stores it."""
    return F.floor((value - low) * TOP / (high - low)).cast("int")


def dequantise(code: Column, low: Column, high: Column) -> Column:
    return low + code / F.lit(float(TOP)) * (high - low)


def rescale(code: Column, bit_depth: Column, low: Column, high: Column) -> Column:
    """Reader-side rescale, which divides by a power of two rather than the top code."""
    return code / F.pow(F.lit(2.0), bit_depth) * (high - low) + low


def _clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def encode_normal(value: Column) -> Column:
    return F.floor((_clip(value, -1.0, 1.0) + 1.0) * TOP / 2.0).cast("int")


def decode_normal(code: Column) -> Column:
    return code / F.lit(float(TOP)) * 2.0 - 1.0


def encode_unit(value: Column) -> Column:
    """Texture or object coordinates."""
    return F.floor(_clip(value, 0.0, 1.0) * TOP).cast("int")


def to_eight_bit(code: Column) -> Column:
    return F.floor(code / 257).cast("int")


def reorder_flow(first: Column, second: Column) -> Column:
    """Renderer order (-column, row) to (row, column)."""
    return F.struct(second.alias("d_row"), (-first).alias("d_col"))


# Layer name -> column function; extend it to register a layer.
LAYER_FUNCTIONS: dict[str, Callable[[Column], Column]] = {
    "uv": encode_unit,
    "normal": encode_normal,
    "object_coordinates": encode_unit,
    "z": lambda value: value,
    "rgba": lambda value: value,
}


def process_layer(layer: Column, value: Column,
                  functions: dict[str, Callable[[Column], Column]] | None = None) -> Column:
    """Applies the registered function of each row's layer; unregistered layers pass through."""
    result = None
    for name, function in (functions or LAYER_FUNCTIONS).items():
        encoded = function(value).cast("double")
        result = F.when(layer == name, encoded) if result is None else result.when(layer == name, encoded)
    return value.cast("double") if result is None else result.otherwise(value.cast("double"))
