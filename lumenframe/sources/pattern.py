"""File-name patterns of image stacks.

``name_T<0-3>_C<a,b>.tif`` stands for the files of all combinations.  The
letters before a bracket name its axis; a pattern without brackets is a regular
expression whose matches, sorted, are the depths.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.session import numbered

#: Fixed words that name an axis.
AXIS_WORDS = {
    "C": ("c", "ch", "w", "wavelength"),
    "T": ("t", "tl", "tp", "timepoint"),
    "Z": ("z", "zs", "sec", "fp", "focal", "focalplane"),
    "S": ("s", "sp", "series"),
}
_AXIS = {word: axis for axis, words in AXIS_WORDS.items() for word in words}
_RANGE = re.compile(r"(\d+)-(\d+)(?::(\d+))?")


@dataclass(frozen=True)
class Slot:
    """A bracket: its axis (None if the text before it names none) and its choices."""

    axis: str | None
    choices: tuple[str, ...]
    numeric: bool


@dataclass(frozen=True)
class Pattern:
    """Literal pieces around slots; no slots: ``pieces`` is one regular expression."""

    pieces: tuple[str, ...]
    slots: tuple[Slot, ...]


def choices(raw: str) -> tuple[tuple[str, ...], bool]:
    """What a bracket stands for, and whether all of it is numbers."""
    raw = raw.strip()
    if span := _RANGE.fullmatch(raw):
        first, last, step = int(span[1]), int(span[2]), int(span[3] or 1)
        if last < first:
            raise ValueError(f"inverted range <{raw}>")
        if step < 1:
            raise ValueError(f"a range needs a step of at least 1: <{raw}>")
        width = max(len(span[1]), len(span[2]))
        return tuple(f"{n:0{width}d}" for n in range(first, last + 1, step)), True
    parts = tuple(p.strip() for p in raw.split(","))
    return parts, all(p.isdigit() for p in parts)


def axis_before(text: str) -> str | None:
    """The axis that the letters at the end of ``text`` name."""
    letters = re.search(r"[A-Za-z]*\Z", text)[0].lower()
    return _AXIS.get(letters)


def parse(name: str) -> Pattern:
    name = name.strip()
    if not name:
        raise ValueError("an empty pattern")
    if "<" not in name or ">" not in name:
        return Pattern((name,), ())
    pieces, slots, rest = [], [], name
    while "<" in rest:
        before, _, rest = rest.partition("<")
        raw, closed, rest = rest.partition(">")
        if not closed:
            raise ValueError(f"a bracket is not closed in {name}")
        pieces.append(before)
        # A bracket that follows another directly has no letters of its own.
        seen = f"{{{len(slots) - 1}}}{before}" if slots else before
        slots.append(Slot(axis_before(seen), *choices(raw)))
    return Pattern((*pieces, rest), tuple(slots))


def channel_names(pattern: Pattern, default_axis: str = "C", series_as: str | None = "T") -> list[str] | None:
    """Choices of the first bracket for channels that are not numbers."""
    for slot in pattern.slots:
        if _axis(slot, default_axis, series_as) == "C" and not slot.numeric:
            return list(slot.choices)
    return None


def _axis(slot: Slot, default_axis: str, series_as: str | None) -> str | None:
    axis = slot.axis or default_axis.upper()
    return (series_as.upper() if series_as else None) if axis == "S" else axis


def expand(spark: SparkSession, pattern: str, default_axis: str = "C", series_as: str | None = "T") -> DataFrame:
    """(name, t, c, z) of every file that a bracket pattern stands for, whether it exists or not.

    Indices are places in a bracket's choices (the first of equal ones); if two
    brackets name an axis the last counts.  The product is of the pattern's own
    choices, made by Spark from one row.
    """
    parsed = parse(pattern)
    if not parsed.slots:
        raise ValueError("a pattern without brackets is matched against a listing")
    if any((s.axis or default_axis.upper()) == "S" for s in parsed.slots) and not series_as:
        raise ValueError("the pattern has a series but series_as is not given")
    rows = spark.range(1)
    name: Column = F.lit(parsed.pieces[0])
    at: dict[str, Column] = {}
    for k, slot in enumerate(parsed.slots):
        options = F.array(*(F.struct(F.lit(v).alias("text"), F.lit(slot.choices.index(v)).alias("at")) for v in slot.choices))
        rows = rows.withColumn(f"slot_{k}", F.explode(options))
        name = F.concat(name, F.col(f"slot_{k}.text"), F.lit(parsed.pieces[k + 1]))
        axis = _axis(slot, default_axis, series_as)
        if axis in ("T", "C", "Z"):
            at[axis] = F.col(f"slot_{k}.at")
    return rows.select(name.alias("name"), *(at.get(a, F.lit(0)).cast("int").alias(a.lower()) for a in "TCZ"))


def match(listing: DataFrame, pattern: str, default_axis: str = "C", series_as: str | None = "T", name: str = "name", by: list[str] | None = None) -> DataFrame:
    """Rows of ``listing`` (one per file; ``name`` without folder) that the pattern names, with t, c, z.

    Bracket patterns join the expansion (its size is the pattern's) with the
    listing.  Regular expressions must match the whole name; z is the rank by
    name within ``by``, or in the whole listing.  Of files at one (t, c, z) the
    last in the pattern's order would be read; all are returned.
    """
    if parse(pattern).slots:
        wanted = expand(listing.sparkSession, pattern, default_axis, series_as).withColumnRenamed("name", name)
        return listing.join(F.broadcast(wanted), name)
    regex = f"^(?:{pattern.strip()})$"
    found = listing.where(F.col(name).rlike(regex)).select("*", F.lit(0).alias("t"), F.lit(0).alias("c"))
    if by:
        return found.withColumn("z", (F.row_number().over(Window.partitionBy(*by).orderBy(name)) - 1).cast("int"))
    return numbered(found, name, name="z").withColumn("z", F.col("z").cast("int"))


def sizes(matched: DataFrame, by: list[str] | None = None) -> DataFrame:
    """size_t, size_c, size_z: one more than the greatest index."""
    aggregate = [(F.max(a) + 1).cast("int").alias(f"size_{a}") for a in "tcz"]
    return matched.groupBy(*by).agg(*aggregate) if by else matched.agg(*aggregate)


def range_choices(raw: Column) -> Column:
    """The choices of bracket texts in a column: ranges ``a-b[:step]``, zero-padded, or comma lists."""
    first, last, step = (F.regexp_extract(F.trim(raw), r"^(\d+)-(\d+)(?::(\d+))?$", k) for k in (1, 2, 3))
    width = F.greatest(F.length(first), F.length(last))
    numbers = F.sequence(first.cast("int"), last.cast("int"), F.when(step == "", 1).otherwise(step.cast("int")))
    padded = F.transform(numbers, lambda n: F.lpad(n.cast("string"), F.greatest(width, F.length(n.cast("string"))), F.lit("0")))
    wrong = F.raise_error(F.concat(F.lit("inverted range <"), raw, F.lit(">"))).cast("array<string>")
    listed = F.transform(F.split(F.trim(raw), ","), F.trim)
    return F.when(first == "", listed).when(last.cast("int") < first.cast("int"), wrong).otherwise(padded)


def axis_of(before: Column) -> Column:
    """The axis that the letters at the end of a column's texts name; null if none."""
    letters = F.lower(F.regexp_extract(before, r"([A-Za-z]*)$", 1))
    return reduce(lambda out, axis: out.when(letters.isin(*AXIS_WORDS[axis]), axis), ("T", "Z", "S"), F.when(letters.isin(*AXIS_WORDS["C"]), "C"))
