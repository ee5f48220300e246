"""The same computations as functions of Spark SQL; Catalyst inlines them."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Parameters, result and body of each function.
FUNCTIONS = {
    "image_kind": (
        "size_t INT, size_z INT",
        "STRING",
        "CASE WHEN size_t = 1 AND size_z = 1 THEN '2D image' WHEN size_t = 1 AND size_z > 1 THEN '3D image (z-stack)' WHEN size_t > 1 AND size_z = 1 THEN 'movie / timelapse' WHEN size_t > 1 AND size_z > 1 THEN '4D timelapse-volume' ELSE 'unknown' END",
    ),
    "pixels_crop": (
        "pixels ARRAY<INT>, size_x INT, x_min INT, x_max INT, y_min INT, y_max INT",
        "ARRAY<INT>",
        "CASE WHEN y_max > y_min THEN flatten(transform(sequence(y_min, y_max - 1), y -> slice(pixels, y * size_x + x_min + 1, x_max - x_min))) ELSE array() END",
    ),
    "pixel_clamp_u16": ("value DOUBLE", "BIGINT", "CAST(least(greatest(nanvl(value, 0D), 0D), 65535D) AS BIGINT)"),
    "pixel_wrap_u8": ("value BIGINT", "BIGINT", "pmod(value, 256)"),
    "rgb_of_rgba": ("rgba BIGINT", "BIGINT", "coalesce(shiftright(rgba, 8) & 16777215, 16777215)"),
    "falsy_or_one": ("value DOUBLE", "DOUBLE", "CASE WHEN value IS NULL OR value = 0 THEN 1D ELSE value END"),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session; returns their names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
