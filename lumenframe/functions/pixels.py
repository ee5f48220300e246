"""Expressions on row-major pixel arrays.  All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed ranges of the integer types, by name.
RANGES = {
    "uint8": (0, 255),
    "uint16": (0, 65535),
    "uint32": (0, 4294967295),
    "int8": (-128, 127),
    "int16": (-32768, 32767),
    "int32": (-2147483648, 2147483647),
}


def ints(first: Column, last: Column) -> Column:
    """first, ..., last; empty if last comes before first (``sequence`` would count down)."""
    return F.when(last >= first, F.sequence(first.cast("int"), last.cast("int"))).otherwise(F.array().cast("array<int>"))


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it.

    A plan may write an earlier projection into a later lambda, where it would be
    worked out for each element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def crop(pixels: Column, size_x: Column, x_min: Column, x_max: Column, y_min: Column, y_max: Column) -> Column:
    """The half-open rectangle [y_min, y_max) x [x_min, x_max)."""
    rows = ints(y_min, y_max - 1)
    return let(pixels, lambda p: F.flatten(F.transform(rows, lambda y: F.slice(p, (y * size_x + x_min + 1).cast("int"), (x_max - x_min).cast("int")))))


def clamp(value: Column, dtype: str = "uint16") -> Column:
    """Into the range of ``dtype``, fractions cut off, NaN to 0."""
    low, high = RANGES[dtype]
    real = F.nanvl(value.cast("double"), F.lit(0.0))
    return F.least(F.greatest(real, F.lit(float(low))), F.lit(float(high))).cast("long")


def wrap(value: Column, dtype: str) -> Column:
    """As an unchecked cast does: modulo the range of ``dtype``."""
    low, high = RANGES[dtype]
    return F.pmod(value.cast("long") - low, F.lit(high - low + 1)) + low


def pad_or_cut(pixels: Column, n: Column) -> Column:
    """Exactly ``n`` pixels: zeros on the right, or the rest dropped."""
    n = n.cast("int")
    return F.when(F.size(pixels) == n, pixels).otherwise(F.slice(F.concat(pixels, F.array_repeat(F.lit(0), n)), F.lit(1), n))


def strided(pixels: Column, size_x: Column, size_y: Column, step: int) -> Column:
    """Every ``step``-th pixel of every ``step``-th row."""
    rows = ints(F.lit(0), F.floor((size_y - 1) / step))
    return let(pixels, lambda p: F.flatten(F.transform(rows, lambda r: F.transform(ints(F.lit(0), F.floor((size_x - 1) / step)), lambda k: F.get(p, (r * step * size_x + k * step).cast("int"))))))


def falsy_or(value: Column, default) -> Column:
    """The value, but the default for null and for zero."""
    return F.when(value.isNull() | (value == 0), F.lit(default)).otherwise(value)


def name_of(name: Column, other: Column, default: str) -> Column:
    """The first of name and id that is not empty, else the literal."""
    return F.coalesce(F.nullif(name, F.lit("")), F.nullif(other, F.lit("")), F.lit(default))


def rgb(rgba: Column) -> Column:
    """0xRRGGBB of a packed 0xRRGGBBAA; white without one."""
    return F.coalesce(F.shiftright(rgba.cast("long"), 8).bitwiseAND(F.lit(0xFFFFFF)), F.lit(0xFFFFFF).cast("long"))


def unit_of(unit: Column, default: str = "µm") -> Column:
    return F.coalesce(F.nullif(unit, F.lit("")), F.lit(default))


def zero_padded(value: Column, width: Column) -> Column:
    """At least ``width`` digits; longer numbers stay whole."""
    text = value.cast("string")
    return F.lpad(text, F.greatest(width.cast("int"), F.length(text)), F.lit("0"))


def file_name(path: Column) -> Column:
    return F.regexp_extract(F.trim(path), r"([^/]*)/*$", 1)


def stem(path: Column) -> Column:
    """The file name without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"(?<=.)(\.[^.]+)$", 1))
