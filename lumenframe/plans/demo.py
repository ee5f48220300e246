"""Image tables derived from the tables of a data directory.

EMB  an image per embedding: 64 values in one of eight shapes, by label
EVT  a sparse image per user: t is the day, c the event type, y and x the time of day
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe import schema
from lumenframe.functions.pixels import let
from lumenframe.sources.arrays import split_planes

#: Sizes (t, c, z, y, x) by label modulo 8; each has 64 pixels.
SHAPES = ((1, 1, 1, 8, 8), (1, 1, 4, 4, 4), (4, 1, 1, 4, 4), (2, 1, 2, 4, 4), (1, 4, 1, 4, 4), (1, 2, 2, 4, 4), (2, 2, 1, 4, 4), (2, 2, 4, 2, 2))
EVENT_SIZES = {"t": 30, "c": 5, "z": 1, "y": 4, "x": 24}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _size(axis: int) -> Column:
    return F.element_at(F.array(*(F.lit(s[axis]) for s in SHAPES)), (F.pmod(F.col("label"), F.lit(8)) + 1).cast("int"))


def emb_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, label, size_t..size_x, flat): pixels 0..65535 in TCZYX."""
    rows = table(spark, sf_dir, "embeddings")
    flat = F.transform("embedding", lambda v: F.floor((v.cast("double") + 1.0) * 32767.5).cast("int"))
    return rows.select(F.col("vec_id").alias("image_id"), "label", *(_size(i).alias(f"size_{a}") for i, a in enumerate("tczyx")), flat.alias("flat"))


def emb_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, label, image): nested records."""
    rows = emb_values(spark, sf_dir)
    size = {a.upper(): F.col(f"size_{a}") for a in "tczyx"}
    names = F.transform(F.sequence(F.lit(0), F.col("size_c") - 1), lambda i: F.concat(F.lit("dye"), i.cast("string")))
    record = schema.image(
        image_id=F.col("image_id").cast("string"),
        name=F.concat(F.lit("emb-"), F.col("image_id").cast("string")),
        acquisition_datetime=F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"),
        size_x=size["X"],
        size_y=size["Y"],
        size_z=size["Z"],
        size_c=size["C"],
        size_t=size["T"],
        physical_size_x=F.when(F.col("label") % 3 == 0, F.lit(0.0)).otherwise(F.lit(0.5)),
        channels=F.transform(schema.synthetic_channels(size["C"], names), lambda ch, i: ch.withField("color_rgba", (F.lit(0xFF0000FF) - i.cast("long") * 0x01000000).cast("long"))),
        planes=split_planes(F.col("flat"), size),
    )
    return rows.select("image_id", "label", record.alias("image"))


def evt_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, size_t..size_x) of the event images."""
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("image_id")).distinct()
    return users.select("image_id", *(F.lit(n).alias(f"size_{a}") for a, n in EVENT_SIZES.items()))


def evt_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, t, c, z, y, x, pos, value): one row per event, duplicates included; ``pos`` is the event's id."""
    types = ("click", "error", "purchase", "signup", "view")
    rows = table(spark, sf_dir, "events")
    kinds = F.array(*map(F.lit, types))
    minute = F.minute("ts")
    return rows.select(
        F.col("user_id").alias("image_id"),
        (F.dayofmonth("ts") - 1).alias("t"),
        F.greatest(F.array_position(kinds, F.col("event_type")).cast("int") - 1, F.lit(0)).alias("c"),
        F.lit(0).alias("z"),
        F.floor(minute / 15).cast("int").alias("y"),
        F.hour("ts").alias("x"),
        F.col("event_id").alias("pos"),
        F.least(F.lit(65535), F.floor(F.col("value") * 100)).cast("int").alias("value"),
    )


def evt_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, t, c, z, pixels): of several events in a cell the last by id; cells without an event are zero.

    A cell is reduced before the shuffle; a plane has at most 96 cells.
    """
    cells = evt_cells(spark, sf_dir).groupBy("image_id", "t", "c", "z", "y", "x").agg(F.max_by("value", "pos").alias("value"))
    width, height = EVENT_SIZES["x"], EVENT_SIZES["y"]
    filled = cells.groupBy("image_id", "t", "c", "z").agg(F.map_from_entries(F.collect_list(F.struct((F.col("y") * width + F.col("x")).alias("i"), "value"))).alias("cells"))
    pixels = let(F.col("cells"), lambda m: F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0))))
    return filled.select("image_id", "t", "c", "z", pixels.alias("pixels"))
