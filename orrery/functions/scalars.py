"""Scalar functions on numbers, angles, durations, colours, arrays and property bags, as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import EPSILON, bound, col

FULL_CIRCLE = 2 * math.pi


# --- numbers ----------------------------------------------------------------------------


def approx_equal(a, b, epsilon: float = EPSILON) -> Column:
    return F.abs(col(a) - col(b)) < epsilon


def same_sign(a, b) -> Column:
    """0 counts as positive."""
    return (col(a) < 0) == (col(b) < 0)


def round_even(a, digits: int = 0) -> Column:
    return F.bround(col(a), digits)


def truncate(a) -> Column:
    """To an integer, towards zero."""
    return col(a).cast("long")


def digit_count(a) -> Column:
    return F.length(F.abs(col(a)).cast("string"))


def fixed(a, digits: int | None = None) -> Column:
    """A number as text with so many digits after the point."""
    return col(a).cast("string") if digits is None else F.format_string(f"%.{digits}f", col(a).cast("double"))


def blend(a, b, alpha: float) -> Column:
    return col(a) * alpha + col(b) * (1 - alpha)


def noisy(a, deviation: float, seed: int) -> Column:
    """With normal noise; not reproducible across partitionings."""
    return col(a) + F.randn(seed) * deviation


def to_8bit(a, low: float, high: float) -> Column:
    """Linear to 1..255 inside the range, truncated; 0 below, 255 above."""
    x = col(a)
    inside = F.floor(x * 254.0 / (high - low) + 1 - 254.0 * low / (high - low)).cast("int")
    return F.when(x < low, 0).when(x > high, 255).otherwise(inside)


# --- angles -----------------------------------------------------------------------------


def angle_difference(a, b) -> Column:
    """The shortest signed turn from ``b`` to ``a`` for angles within one circle, in radians."""
    a, b = col(a), col(b)
    plain = a - b
    wrapped = F.when(a < b, plain + FULL_CIRCLE).otherwise(plain - FULL_CIRCLE)
    return F.when(F.abs(wrapped) < F.abs(plain), wrapped).otherwise(plain)


def angle_difference_degrees(a, b) -> Column:
    a, b = col(a), col(b)
    plain = a - b
    wrapped = F.when(a < b, plain + 360.0).otherwise(plain - 360.0)
    return F.when(F.abs(wrapped) < F.abs(plain), wrapped).otherwise(plain)


# --- durations --------------------------------------------------------------------------


def format_milliseconds(ms) -> Column:
    """``1d/2h/3m/4s/5ms``: parts that are zero are left out, milliseconds stay."""
    rest = col(ms).cast("long")
    out = []
    for unit, size in (("d", 86_400_000), ("h", 3_600_000), ("m", 60_000), ("s", 1000)):
        n = F.floor(rest / size)
        out.append(F.when(n > 0, F.concat(n.cast("string"), F.lit(f"{unit}/"))).otherwise(""))
        rest = F.when(n > 0, rest - n * size).otherwise(rest)
    return F.concat(*out, rest.cast("string"), F.lit("ms"))


def timestamp_string(ts) -> Column:
    return F.date_format(col(ts), "yyyyMMdd_HHmmss")


# --- colours: struct<r, g, b> of 0 to 255 -----------------------------------------------


def color(r, g, b) -> Column:
    return F.struct(*[clamp(c).alias(n) for c, n in zip((r, g, b), "rgb")])


def clamp(c) -> Column:
    return F.least(F.greatest(col(c), F.lit(0)), F.lit(255)).cast("short")


def color_add(a: Column, b: Column) -> Column:
    return color(*[a[c].cast("int") + b[c].cast("int") for c in "rgb"])


def color_scale(a: Column, factor) -> Column:
    return color(*[(a[c] * col(factor)).cast("int") for c in "rgb"])


def colors_equal(a: Column, b: Column, delta: int = 0) -> Column:
    return (F.abs(a["r"] - b["r"]) <= delta) & (F.abs(a["g"] - b["g"]) <= delta) & (F.abs(a["b"] - b["b"]) <= delta)


def swap_red_blue(a: Column) -> Column:
    return F.struct(a["b"].alias("r"), a["g"].alias("g"), a["r"].alias("b"))


def grey(a: Column) -> Column:
    """Rounded half to even; of whole thousandths, so that a half is one and not a sum of rounded products beside it."""
    return F.bround((299 * a["r"].cast("long") + 587 * a["g"].cast("long") + 114 * a["b"].cast("long")) / 1000).cast("int")


@bound
def rgb_to_hsv(a: Column) -> Column:
    """``struct<h, s, v>``: h in degrees, s from 0 to 1, v the largest channel. Black has h and v -1; grey h 0."""
    r, g, b = (a[c].cast("double") for c in "rgb")
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    d = high - low
    sextant = F.when(r == high, F.try_divide(g - b, d)).when(g == high, 2 + F.try_divide(b - r, d)).otherwise(4 + F.try_divide(r - g, d))
    h = F.coalesce(sextant * 60.0, F.lit(0.0))
    h = F.when(h < 0, h + 360.0).otherwise(h)
    triple = lambda x, y, z: F.struct(x.alias("h"), y.alias("s"), z.alias("v"))
    return F.when(high == 0, triple(F.lit(-1.0), F.lit(0.0), F.lit(-1.0))).otherwise(triple(h, F.try_divide(d, high), high))


@bound
def hsv_to_rgb(a: Column) -> Column:
    """The inverse for h from 0 to 360, s from 0 to 1, v from 0 to 255; channels are truncated."""
    h, s, val = a["h"] / 60.0, a["s"], a["v"]
    i = F.floor(h)
    f = h - i
    p, q, t = val * (1 - s), val * (1 - s * f), val * (1 - s * (1 - f))
    turn = [(val, t, p), (q, val, p), (p, val, t), (p, q, val), (t, p, val)]
    found = F.when(s == 0, color(val.cast("int"), val.cast("int"), val.cast("int")))
    for k, rgb in enumerate(turn):
        found = found.when(i == k, color(*[c.cast("int") for c in rgb]))
    return found.otherwise(color(*[c.cast("int") for c in (val, p, q)]))


def colorize(a, low: float, high: float, invert: bool = False, background: tuple[int, int, int] = (0, 0, 0)) -> Column:
    """A blue-to-red rainbow over a range; the background colour outside."""
    x = (col(a) - low) / (high - low)
    x = 1 - x if invert else x
    ramp = lambda middle: F.least(F.greatest(1.5 - F.abs(4 * x - middle), F.lit(0.0)), F.lit(1.0)) * 255.0
    inside = color(*[ramp(m).cast("int") for m in (3.0, 2.0, 1.0)])
    return F.when((col(a) >= low) & (col(a) <= high), inside).otherwise(color(*map(F.lit, background)))


# --- arrays -----------------------------------------------------------------------------


def approx_contains(values: Column, x, epsilon: float = EPSILON) -> Column:
    return F.exists(values, lambda y: F.abs(y - col(x)) < epsilon)


def approx_distinct(values: Column, epsilon: float = EPSILON) -> Column:
    """Keeps a value unless one kept before is nearer than ``epsilon``; order matters."""
    start = F.array().cast("array<double>")
    return F.aggregate(values, start, lambda kept, x: F.when(F.exists(kept, lambda y: F.abs(y - x) < epsilon), kept).otherwise(F.concat(kept, F.array(x.cast("double")))))


def all_distinct(values: Column) -> Column:
    return F.size(F.array_distinct(values)) == F.size(values)


def flatten(values: Column) -> Column:
    return F.flatten(values)


def remove_positions(values: Column, positions: list[int]) -> Column:
    return F.filter(values, lambda x, i: ~i.isin(positions))


def every_nth_of(values: Column, n: int) -> Column:
    return F.filter(values, lambda x, i: i % n == 0)


# --- property bags: map<string, T> ------------------------------------------------------


def has_property(bag: Column, key: str) -> Column:
    return F.map_contains_key(bag, key)


def get_property(bag: Column, key: str, default=None) -> Column:
    found = F.try_element_at(bag, F.lit(key))
    return found if default is None else F.coalesce(found, F.lit(default))


def set_properties(bag: Column, other: Column) -> Column:
    """Those of both; where both have a key, the second's."""
    kept = F.map_filter(bag, lambda k, _: ~F.map_contains_key(other, k))
    return F.map_concat(kept, other)


def property_names(bag: Column) -> Column:
    return F.array_sort(F.map_keys(bag))
