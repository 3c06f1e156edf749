"""Colour conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sixteen basic web colour names.
NAMED_COLORS = {
    "aqua": "#00ffff", "black": "#000000", "blue": "#0000ff", "fuchsia": "#ff00ff",
    "gray": "#808080", "green": "#008000", "lime": "#00ff00", "maroon": "#800000",
    "navy": "#000080", "olive": "#808000", "purple": "#800080", "red": "#ff0000",
    "silver": "#c0c0c0", "teal": "#008080", "white": "#ffffff", "yellow": "#ffff00",
}

# The eight object colours and two object sizes of the classic block-world scenes.
BLOCK_COLORS = {
    "blue": (42, 75, 215), "brown": (129, 74, 25), "cyan": (41, 208, 208), "gray": (87, 87, 87),
    "green": (29, 105, 20), "purple": (129, 38, 192), "red": (173, 35, 35), "yellow": (255, 238, 5),
}
BLOCK_SIZES = {"small": 0.7, "large": 1.4}


def from_hex(text: Column) -> Column:
    """RGBA in [0, 1] from ``#rgb``, ``#rgba``, ``#rrggbb`` or ``#rrggbbaa``; else null."""
    digits = F.regexp_replace(text, "^#", "")
    size = F.length(digits)

    def lane(index: int) -> Column:
        short = F.conv(F.substring(digits, index + 1, 1), 16, 10).cast("double") / 15.0
        long = F.conv(F.substring(digits, 2 * index + 1, 2), 16, 10).cast("double") / 255.0
        return F.when(size.isin(3, 4), short).otherwise(long)

    alpha = F.when(size.isin(4, 8), lane(3)).otherwise(F.lit(1.0))
    valid = size.isin(3, 4, 6, 8) & digits.rlike("^[0-9a-fA-F]+$")
    return F.when(valid, F.array(lane(0), lane(1), lane(2), alpha))


def from_hexint(value: Column, alpha: Column | float = 1.0) -> Column:
    alpha = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    lanes = [F.shiftright(value, shift).bitwiseAND(255) / 255.0 for shift in (16, 8, 0)]
    return F.when(value.between(0, 0xFFFFFF) & alpha.between(0.0, 1.0), F.array(*lanes, alpha))


def from_name(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in NAMED_COLORS.items() for x in pair])
    return from_hex(F.try_element_at(table, F.lower(name)))


def to_hex(rgba: Column, short: bool = False) -> Column:
    top, width = (15, 1) if short else (255, 2)
    lanes = [
        F.lpad(F.lower(F.hex((rgba[i] * top).cast("bigint"))), width, "0") for i in range(4)
    ]
    return F.concat(F.lit("#"), *lanes)


def from_hsv(h: Column, s: Column, v: Column) -> Column:
    """RGB lanes of a hue, saturation and value in [0, 1]."""
    sector = F.floor(h * 6.0)
    f = h * 6.0 - sector
    p, q, t = v * (1.0 - s), v * (1.0 - s * f), v * (1.0 - s * (1.0 - f))
    wheel = [(v, t, p), (q, v, p), (p, v, t), (p, q, v), (t, p, v), (v, p, q)]
    turn = F.pmod(sector, F.lit(6))
    result = F.when(s == 0.0, F.array(v, v, v))
    for index, lanes in enumerate(wheel):
        result = result.when(turn == index, F.array(*lanes))
    return result


def to_hsv(rgba: Column) -> Column:
    r, g, b = rgba[0], rgba[1], rgba[2]
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    span = high - low
    hue = (
        F.when(span == 0.0, F.lit(0.0))
        .when(r == high, (g - b) / span)
        .when(g == high, 2.0 + (b - r) / span)
        .otherwise(4.0 + (r - g) / span)
    )
    hue = hue / 6.0
    saturation = F.when(high == 0.0, F.lit(0.0)).otherwise(span / high)
    return F.array(hue - F.floor(hue), saturation, high)


def palette(index: Column, count: Column, first_hue: float = 0.01,
            lightness: float = 0.5, saturation: float = 0.7) -> Column:
    """Evenly spaced hues as 8-bit RGB lanes; label 0 is black."""
    hue = F.pmod((index - 1) / count + first_hue, F.lit(1.0))
    high = lightness * (1 + saturation) if lightness <= 0.5 else lightness + saturation - lightness * saturation
    low = 2 * lightness - high

    def lane(offset: float) -> Column:
        h = F.pmod(hue + offset, F.lit(1.0))
        return (
            F.when(h < 1 / 6, low + (high - low) * h * 6)
            .when(h < 1 / 2, F.lit(high))
            .when(h < 2 / 3, low + (high - low) * (2 / 3 - h) * 6)
            .otherwise(F.lit(low))
        )

    lanes = [F.bround(lane(offset) * 255).cast("int") for offset in (1 / 3, 0.0, -1 / 3)]
    return F.when(index == 0, F.array(*[F.lit(0)] * 3)).otherwise(F.array(*lanes))
