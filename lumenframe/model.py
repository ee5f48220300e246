"""Three forms of a table of images, and the way between them.

nested      one row per image, a record in one column
normalised  ``images`` (image_id, header) and ``planes`` (image_id, t, c, z, pos, pixels)
long        (image_id, t, c, z, y, x, value): a view for SQL
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.schema import PLANE

HEADER = ("type", "version", "name", "acquisition_datetime", "pixels_meta")


def headers(df: DataFrame, column: str = "image", key: str = "image_id") -> DataFrame:
    """The header of every image.  Planes are not read: only named leaves are selected."""
    return df.select(key, *(F.col(f"{column}.{f}").alias(f) for f in HEADER))


def planes_of(df: DataFrame, column: str = "image", key: str = "image_id") -> DataFrame:
    """A row per plane; ``pos`` is its place in the record.

    The outer form keeps Spark from judging sizes of planes ahead of a filter
    on the table, which would run checks on rows that the filter leaves out.
    """
    rows = df.select(key, F.posexplode_outer(f"{column}.planes").alias("pos", "plane")).where("pos is not null")
    return rows.select(key, "plane.t", "plane.c", "plane.z", "pos", "plane.pixels")


def normalise(df: DataFrame, column: str = "image", key: str = "image_id") -> tuple[DataFrame, DataFrame]:
    return headers(df, column, key), planes_of(df, column, key)


def nest(images: DataFrame, planes: DataFrame, column: str = "image", key: str = "image_id") -> DataFrame:
    """Records again: one shuffle of planes by image; ``pos`` keeps their order."""
    order = "pos" if "pos" in planes.columns else None
    parts = F.struct(*([F.col(order)] if order else [F.col("t"), F.col("c").alias("c0"), F.col("z").alias("z0")]), F.struct(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in PLANE.fields)).alias("plane"))
    listed = planes.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(parts)), lambda p: p["plane"]).alias("planes"))
    joined = images.join(listed, key, "left")
    planes_or_none = F.coalesce("planes", F.array().cast(T.ArrayType(PLANE)))
    record = F.struct(F.col("type"), F.col("version"), F.col(key).cast("string").alias("id"), F.col("name"), F.col("acquisition_datetime"), F.col("pixels_meta"), planes_or_none.alias("planes"))
    return joined.select(key, record.alias(column))


def pixels_of(planes: DataFrame, images: DataFrame | None = None, key: str = "image_id") -> DataFrame:
    """The long form.  ``planes`` needs size_x, or ``images`` whose headers give it (they are small beside planes; Spark decides how to join)."""
    if "size_x" not in planes.columns:
        if images is None:
            raise ValueError("size_x is in neither planes nor images")
        width = images.select(key, F.col("pixels_meta.size_x").alias("size_x")) if "pixels_meta" in images.columns else images.select(key, "size_x")
        planes = planes.join(width, key)
    rows = planes.select(key, "t", "c", "z", "size_x", F.posexplode("pixels").alias("i", "value"))
    return rows.select(key, "t", "c", "z", F.expr("cast(i div size_x as int)").alias("y"), F.expr("i % size_x").alias("x"), "value")
