"""One query for each operator of the image engine, and its SQL on the source tables."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe import model, schema
from lumenframe.functions import pixels as px
from lumenframe.functions import sql
from lumenframe.operators import dense, describe, slicing
from lumenframe.plans import demo
from lumenframe.session import shared_folder
from lumenframe.sources import arrays, files, parquet, pattern, tiff, zarr
from lumenframe.streaming import images as streaming

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: SQL that derives the embedding images: their sizes, and their pixels in long form.
EMB = """
shape AS (SELECT * FROM (VALUES (0,1,1,1,8,8),(1,1,1,4,4,4),(2,4,1,1,4,4),(3,2,1,2,4,4),(4,1,4,1,4,4),(5,1,2,2,4,4),(6,2,2,1,4,4),(7,2,2,4,2,2)) s(k,st,sc,sz,sy,sx)),
img AS (SELECT vec_id AS image_id, label, embedding, st, sc, sz, sy, sx FROM embeddings JOIN shape ON label % 8 = k),
raw AS (SELECT image_id, label, st, sc, sz, sy, sx, i, CAST(floor((CAST(embedding[i + 1] AS DOUBLE) + 1.0) * 32767.5) AS INTEGER) AS value FROM img, (SELECT CAST(range AS INTEGER) AS i FROM range(64)) n),
px AS (SELECT *, i // (sc * sz * sy * sx) AS t, (i // (sz * sy * sx)) % sc AS c, (i // (sy * sx)) % sz AS z, (i // sx) % sy AS y, i % sx AS x FROM raw)
"""
EVT = """
cell AS (SELECT user_id AS image_id, CAST(day(ts) - 1 AS INTEGER) AS t, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 ELSE 0 END AS c, 0 AS z, CAST(minute(ts) // 15 AS INTEGER) AS y, CAST(hour(ts) AS INTEGER) AS x, event_id AS pos, CAST(least(65535, floor(value * 100)) AS INTEGER) AS value FROM events),
last AS (SELECT image_id, t, c, z, y, x, value FROM (SELECT *, row_number() OVER (PARTITION BY image_id, t, c, z, y, x ORDER BY pos DESC) AS rn FROM cell) WHERE rn = 1)
"""
KIND = "CASE WHEN st = 1 AND sz = 1 THEN '2D image' WHEN st = 1 AND sz > 1 THEN '3D image (z-stack)' WHEN st > 1 AND sz = 1 THEN 'movie / timelapse' WHEN st > 1 AND sz > 1 THEN '4D timelapse-volume' ELSE 'unknown' END"


def query(oracle: str):
    def register(function):
        QUERIES[function.__name__] = function
        ORACLE_SQL[function.__name__] = oracle
        return function

    return register


def _emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo.emb_images(spark, sf_dir)


def _long(df: DataFrame, planes: Column, width: Column | int, *keep: str) -> DataFrame:
    """Planes in a column as rows (image_id, t, c, z, y, x, value)."""
    rows = df.select("image_id", *keep, (F.lit(width) if isinstance(width, int) else width).alias("w"), F.explode_outer(planes).alias("p")).where("p is not null")
    rows = rows.select("image_id", *keep, "w", "p.t", "p.c", "p.z", F.posexplode("p.pixels").alias("i", "value"))
    return rows.select("image_id", *keep, F.col("t").cast("int").alias("t"), F.col("c").cast("int").alias("c"), F.col("z").cast("int").alias("z"), F.floor(F.col("i") / F.col("w")).cast("int").alias("y"), (F.col("i") % F.col("w")).cast("int").alias("x"), F.col("value").cast("int").alias("value"))


@query(f"WITH {EMB} SELECT {KIND} AS kind, CAST(count(*) AS BIGINT) AS n, CAST(sum(sc) AS BIGINT) AS channels FROM img GROUP BY 1")
def describe_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = describe.describe(_emb(spark, sf_dir))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("channels").cast("long")).alias("channels"))


@query(f"""WITH {EMB} SELECT image_id, st AS size_t, sc AS size_c, sz AS size_z, sy AS size_y, sx AS size_x, {KIND} AS kind, sc AS channels, sc > 1 AS is_multichannel,
{KIND} || ', ' || CASE WHEN sc > 1 THEN 'multi-channel (' || sc || ' channels)' ELSE 'single-channel' END || ' - shape (T=' || st || ', C=' || sc || ', Z=' || sz || ', Y=' || sy || ', X=' || sx || ')' AS summary FROM img""")
def describe_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe.describe(_emb(spark, sf_dir))


@query(f"WITH {EMB} SELECT image_id, CAST(max(CASE WHEN i = 0 AND image_id % 7 = 0 THEN value - 70000 WHEN i = 1 AND image_id % 5 = 0 THEN value + 70000 ELSE 0 END) = 0 AND min(CASE WHEN i = 0 AND image_id % 7 = 0 THEN value - 70000 ELSE 0 END) = 0 AS BOOLEAN) AS valid FROM px GROUP BY image_id")
def verify_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = F.transform("image.planes", lambda p, k: F.when(k == 0, p.withField("pixels", F.transform(p["pixels"], lambda v, i: v + F.when((i == 0) & (F.col("image_id") % 7 == 0), -70000).when((i == 1) & (F.col("image_id") % 5 == 0), 70000).otherwise(0)))).otherwise(p))
    df = _emb(spark, sf_dir).withColumn("image", F.col("image").withField("planes", wrong))
    return df.select("image_id", schema.verified(df).alias("valid"))


@query(f"""WITH {EMB} SELECT problem, CAST(count(*) AS BIGINT) AS n FROM (
SELECT 'sizes' AS problem FROM img WHERE image_id % 11 = 0 UNION ALL SELECT 'plane_length' FROM img WHERE image_id % 11 = 0 OR image_id % 11 = 1 UNION ALL
SELECT 'plane_index' FROM img WHERE image_id % 11 = 2 UNION ALL SELECT 'duplicate_planes' FROM img WHERE image_id % 11 = 3 UNION ALL SELECT 'channels' FROM img WHERE image_id % 11 = 4 UNION ALL
SELECT 'pixel_range' FROM img WHERE image_id % 11 = 5) GROUP BY problem""")
def integrity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    which, image = F.col("image_id") % 11, F.col("image")
    first = lambda f: F.transform(image["planes"], lambda p, k: F.when(k == 0, f(p)).otherwise(p))
    broken = (
        F.when(which == 0, image.withField("pixels_meta.size_x", F.lit(0)))
        .when(which == 1, image.withField("planes", first(lambda p: p.withField("pixels", F.slice(p["pixels"], 1, 3)))))
        .when(which == 2, image.withField("planes", first(lambda p: p.withField("z", F.lit(99)))))
        .when(which == 3, image.withField("planes", F.concat(image["planes"], F.slice(image["planes"], 1, 1))))
        .when(which == 4, image.withField("pixels_meta.channels", F.concat(image["pixels_meta"]["channels"], F.slice(image["pixels_meta"]["channels"], 1, 1))))
        .when(which == 5, image.withField("planes", first(lambda p: p.withField("pixels", F.transform(p["pixels"], lambda v: -v - 1)))))
        .otherwise(image)
    )
    found = _emb(spark, sf_dir).select(F.explode(schema.problems(broken)).alias("problem"))
    return found.groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EMB} SELECT image_id, c AS k, 'ch-' || c AS id, 'C' || c AS name, 'Unknown' AS illumination, CAST(4294967295 AS BIGINT) AS color_rgba FROM (SELECT DISTINCT image_id, c FROM px) UNION ALL SELECT -1, 0, 'ch-0', 'default', 'Unknown', CAST(4294967295 AS BIGINT)")
def channels_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = demo.emb_values(spark, sf_dir).select("image_id", schema.synthetic_channels(F.col("size_c")).alias("channels"))
    plain = spark.range(1).select(F.lit(-1).cast("long").alias("image_id"), schema.image()["pixels_meta"]["channels"].alias("channels"))
    return rows.unionByName(plain).select("image_id", F.posexplode("channels").alias("k", "ch")).select("image_id", "k", "ch.id", "ch.name", "ch.illumination", "ch.color_rgba")


@query(f"WITH {EMB} SELECT image_id, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY c) - 1 AS INTEGER) AS k, 'ch-' || (dense_rank() OVER (PARTITION BY image_id ORDER BY c) - 1) AS id, 'dye' || c AS name, CAST(4278190335 - c * 16777216 AS BIGINT) AS color_rgba FROM (SELECT DISTINCT image_id, c FROM px WHERE sc > 1 AND c IN (1, 3))")
def channels_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _emb(spark, sf_dir).where("image.pixels_meta.size_c > 1")
    cut = slicing.slice_images(df, 0, 1, 0, 1, c_indices=[3, 1, 7])
    rows = cut.select("image_id", F.posexplode_outer("image.pixels_meta.channels").alias("k", "ch"))
    return rows.select("image_id", "k", "ch.id", "ch.name", "ch.color_rgba")


@query("WITH v AS (SELECT vec_id AS image_id, i, CAST(floor((CAST(embedding[i + 1] AS DOUBLE) + 1.0) * 32767.5) AS INTEGER) AS value FROM embeddings, (SELECT CAST(range AS INTEGER) AS i FROM range(64)) n) SELECT image_id, CAST(0 AS INTEGER) AS t, (i // 2) % 4 AS c, i % 2 AS z, (i // 8) % 2 AS y, i // 16 AS x, value FROM v")
def numpy_axes_to_tczyx(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = {"X": F.lit(4), "Y": F.lit(2), "C": F.lit(4), "Z": F.lit(2)}
    df = arrays.from_arrays(demo.emb_values(spark, sf_dir).select("image_id", "flat"), "flat", shape, "XYCZ", image_id=F.col("image_id").cast("string"), clock=F.lit(None))
    return _long(df, F.col("image.planes"), 4)


@query(f"WITH {EMB} SELECT image_id, t, c, z, CAST(row_number() OVER (PARTITION BY image_id ORDER BY t, c, z) - 1 AS INTEGER) AS pos, CAST(sum(value) AS BIGINT) AS total, CAST(sum(value * (y * sx + x + 1)) AS BIGINT) AS weighted FROM px GROUP BY image_id, t, c, z")
def plane_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model.planes_of(_emb(spark, sf_dir))
    total = lambda f: F.aggregate(F.transform("pixels", f), F.lit(0).cast("long"), lambda a, v: a + v)
    return rows.select("image_id", "t", F.col("c").cast("int").alias("c"), "z", "pos", total(lambda v: v.cast("long")).alias("total"), total(lambda v, i: v.cast("long") * (i + 1)).alias("weighted"))


@query(f"WITH {EMB} SELECT image_id, t, c, z, y - 1 AS y, x AS x, value FROM px WHERE y >= 1 AND y < 2 AND x < 2")
def slice_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = slicing.slice_images(_emb(spark, sf_dir), 0, 2, 1, 2)
    return _long(df, F.col("image.planes"), F.col("image.pixels_meta.size_x"))


@query(f"WITH {EMB} SELECT image_id, CAST(t - 1 AS INTEGER) AS t, c, CAST(CASE z WHEN 0 THEN 0 ELSE 1 END AS INTEGER) AS z, y, CAST(x - 1 AS INTEGER) AS x, value FROM px WHERE st > 1 AND sz > 1 AND t = 1 AND z IN (0, sz - 1) AND x = 1 AND (sz = 4 OR sz = 2)")
def slice_select_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _emb(spark, sf_dir).where("image.pixels_meta.size_t > 1 and image.pixels_meta.size_z > 1")
    two = slicing.slice_images(df.where("image.pixels_meta.size_z = 2"), 1, 2, 0, 4, t_indices=[1, 9, 1], z_indices=[1, 0])
    four = slicing.slice_images(df.where("image.pixels_meta.size_z = 4"), 1, 2, 0, 2, t_indices=[1, -1], z_indices=[3, 0, 4])
    both = two.unionByName(four)
    return _long(both, F.col("image.planes"), F.col("image.pixels_meta.size_x"))


_FILL = f"""WITH {EVT}, grid AS (SELECT u.image_id, t.t, c.c, y.y, x.x FROM (SELECT DISTINCT user_id AS image_id FROM events) u, (VALUES (0), (3), (29)) t(t), (VALUES (1), (4)) c(c), (SELECT CAST(range AS INTEGER) AS y FROM range(1, 3)) y, (SELECT CAST(range AS INTEGER) AS x FROM range(6, 12)) x),
have AS (SELECT DISTINCT image_id, t, c FROM last)
SELECT g.image_id, CASE g.t WHEN 0 THEN 0 WHEN 3 THEN 1 ELSE 2 END AS t, CASE g.c WHEN 1 THEN 0 ELSE 1 END AS c, CAST(sum(coalesce(l.value, 0)) AS BIGINT) AS total, CAST(sum(coalesce(l.value, 0) * ((g.y - 1) * 6 + g.x - 6 + 1)) AS BIGINT) AS weighted
FROM grid g {{join}} LEFT JOIN last l ON l.image_id = g.image_id AND l.t = g.t AND l.c = g.c AND l.y = g.y AND l.x = g.x GROUP BY 1, 2, 3"""


def _filled(spark: SparkSession, sf_dir: str, fill: bool) -> DataFrame:
    images, planes = demo.evt_headers(spark, sf_dir), demo.evt_planes(spark, sf_dir)
    cut = slicing.slice_planes(images, planes, 6, 12, 1, 3, t_indices=[29, 0, 3, 77], c_indices=[4, 1], fill_missing=fill)
    total = lambda f: F.aggregate(F.transform("pixels", f), F.lit(0).cast("long"), lambda a, v: a + v)
    return cut.select("image_id", "t", "c", total(lambda v: v.cast("long")).alias("total"), total(lambda v, i: v.cast("long") * (i + 1)).alias("weighted"))


@query(_FILL.format(join=""))
def slice_fill_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir, True)


@query(_FILL.format(join="JOIN have h ON h.image_id = g.image_id AND h.t = g.t AND h.c = g.c"))
def slice_drop_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir, False)


@query(f"WITH {EMB} SELECT image_id, CAST(i % (sy * sx) AS INTEGER) AS i, value FROM px WHERE t = st - 1 AND c = 0 AND z = 0")
def plane_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _emb(spark, sf_dir)
    found = slicing.last_plane(F.col("image.planes"), F.col("image.pixels_meta.size_t") - 1, F.lit(0), F.lit(0))
    return df.select("image_id", F.posexplode(found["pixels"]).alias("i", "value"))


@query(f"WITH {EMB} SELECT image_id, z, y, x, value FROM px WHERE t = 0 AND c = 0")
def volume_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _emb(spark, sf_dir).select("image_id", F.col("image.pixels_meta.size_x").alias("w"), F.posexplode(slicing.volume(F.col("image"), 0)).alias("z", "layer"))
    rows = rows.select("image_id", "z", "w", F.posexplode("layer").alias("i", "value"))
    return rows.select("image_id", "z", F.floor(F.col("i") / F.col("w")).cast("int").alias("y"), (F.col("i") % F.col("w")).cast("int").alias("x"), "value")


@query(f"WITH {EMB} SELECT image_id, CAST(z // 2 AS INTEGER) AS z, CAST(y // 2 AS INTEGER) AS y, CAST(x // 2 AS INTEGER) AS x, value, CAST(2.0 AS DOUBLE) AS spacing_z, CAST(CASE WHEN label % 3 = 0 THEN 2.0 ELSE 1.0 END AS DOUBLE) AS spacing_x FROM px WHERE t = 0 AND c = 0 AND z % 2 = 0 AND y % 2 = 0 AND x % 2 = 0")
def downsample_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _emb(spark, sf_dir).select("image_id", slicing.downsampled_volume(F.col("image"), 0, 2).alias("v"))
    rows = rows.select("image_id", "v.size_x", "v.spacing_z", "v.spacing_x", F.posexplode("v.layers").alias("z", "layer"))
    rows = rows.select("image_id", "size_x", "spacing_z", "spacing_x", "z", F.posexplode("layer").alias("i", "value"))
    return rows.select("image_id", "z", F.floor(F.col("i") / F.col("size_x")).cast("int").alias("y"), (F.col("i") % F.col("size_x")).cast("int").alias("x"), "value", "spacing_z", "spacing_x")


@query(f"WITH {EVT}, grid AS (SELECT u.image_id, CAST(t.range AS INTEGER) AS t, CAST(c.range AS INTEGER) AS c FROM (SELECT DISTINCT user_id AS image_id FROM events) u, range(30) t, range(5) c) SELECT g.image_id, g.t, g.c, CAST(96 AS BIGINT) AS n, CAST(sum(coalesce(l.value, 0)) AS BIGINT) AS total FROM grid g LEFT JOIN last l ON l.image_id = g.image_id AND l.t = g.t AND l.c = g.c GROUP BY 1, 2, 3")
def to_dense_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dense.dense_planes(demo.evt_headers(spark, sf_dir), demo.evt_planes(spark, sf_dir))
    return rows.select("image_id", "t", "c", F.size("pixels").cast("long").alias("n"), F.aggregate("pixels", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


@query(f"WITH {EMB} SELECT image_id, t, c, z, CAST(i % (sy * sx) AS INTEGER) AS i, CASE WHEN i % (sy * sx) < CASE WHEN image_id % 2 = 0 THEN 3 ELSE 1000 END THEN value ELSE 0 END AS value FROM px")
def to_dense_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.transform("image.planes", lambda p: p.withField("pixels", F.when(F.col("image_id") % 2 == 0, F.slice(p["pixels"], 1, 3)).otherwise(F.concat(p["pixels"], F.array(F.lit(1), F.lit(2))))))
    df = _emb(spark, sf_dir).withColumn("image", F.col("image").withField("planes", odd))
    rows = df.select("image_id", F.explode(dense.dense(F.col("image"), strict=False)).alias("p"))
    return rows.select("image_id", "p.t", F.col("p.c").cast("int").alias("c"), "p.z", F.posexplode("p.pixels").alias("i", "v")).select("image_id", "t", "c", "z", "i", F.col("v").cast("int").alias("value"))


@query(f"WITH {EVT} SELECT image_id, t, c, z, y, x, value FROM last")
def dedup_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = demo.evt_cells(spark, sf_dir)
    best = cells.groupBy("image_id", "t", "c", "z", "y", "x").agg(F.max_by("value", "pos").alias("value"))
    return best.select("image_id", "t", "c", "z", "y", "x", "value")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, CAST(least(65535, greatest(0, trunc(l_extendedprice * 2 - 20000))) AS BIGINT) AS value FROM lineitem")
def clamp_u16(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = demo.table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", px.clamp(F.col("l_extendedprice") * 2 - 20000, "uint16").alias("value"))


@query(f"WITH {EMB} SELECT image_id, i, CAST(((value - 40000) % 256 + 256) % 256 AS BIGINT) AS value FROM px")
def cast_wrap_u8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = demo.emb_values(spark, sf_dir).select("image_id", F.posexplode("flat").alias("i", "v"))
    return rows.select("image_id", "i", px.wrap(F.col("v") - 40000, "uint8").alias("value"))


@query(f"WITH {EMB} SELECT image_id, i, CAST(least(255, greatest(0, value - 32700)) AS BIGINT) AS value FROM px")
def cast_clamp_u8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = demo.emb_values(spark, sf_dir).select("image_id", F.posexplode("flat").alias("i", "v"))
    return rows.select("image_id", "i", px.clamp(F.col("v") - 32700, "uint8").alias("value"))


@query(f"WITH {EMB} SELECT image_id, t, c, z, CAST(min(value) AS DOUBLE) AS vmin, CAST(CASE WHEN min(value) = max(value) THEN min(value) + 1 ELSE max(value) END AS DOUBLE) AS vmax FROM px GROUP BY 1, 2, 3, 4")
def autoscale_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model.planes_of(_emb(spark, sf_dir)).select("image_id", "t", F.col("c").cast("int").alias("c"), "z", describe.limits(F.col("pixels")).alias("l"))
    return rows.select("image_id", "t", "c", "z", "l.vmin", "l.vmax")


@query(f"WITH {EMB}, q AS (SELECT image_id, c, quantile_cont(CAST(value AS DOUBLE), 0.01) AS lo, quantile_cont(CAST(value AS DOUBLE), 0.999) AS hi FROM px WHERE t = 0 GROUP BY 1, 2) SELECT image_id, c, round(lo, 6) AS clim_low, round(CASE WHEN hi <= lo THEN lo + 1 ELSE hi END, 6) AS clim_high FROM q")
def percentile_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    planes = model.planes_of(_emb(spark, sf_dir)).where("t = 0").select("image_id", F.col("c").cast("int").alias("c"), F.explode("pixels").alias("value"))
    rows = describe.percentile_limits(planes, ["image_id", "c"])
    return rows.select("image_id", "c", F.round("clim_low", 6).alias("clim_low"), F.round("clim_high", 6).alias("clim_high"))


@query("SELECT c_custkey, CAST((c_custkey * 2654435) % 4294967296 AS BIGINT) AS rgba, CAST((((c_custkey * 2654435) % 4294967296) // 256) % 16777216 AS BIGINT) AS rgb FROM customer")
def rgba_to_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = demo.table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") * 2654435 % 4294967296).cast("long").alias("rgba"))
    return rows.select("c_custkey", "rgba", px.rgb(F.col("rgba")).alias("rgb"))


@query("SELECT c_custkey, CASE WHEN c_nationkey IS NULL OR c_nationkey = 0 THEN 1.0 ELSE CAST(c_nationkey AS DOUBLE) END AS spacing, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END, ''), nullif(c_mktsegment, ''), 'image') AS name, CASE WHEN c_custkey % 2 = 0 THEN 'µm' ELSE 'nm' END AS unit FROM customer")
def physical_size_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = demo.table(spark, sf_dir, "customer")
    name = px.name_of(F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name")), F.col("c_mktsegment"), "image")
    unit = px.unit_of(F.when(F.col("c_custkey") % 2 == 0, "").otherwise("nm"))
    return rows.select("c_custkey", px.falsy_or(F.col("c_nationkey").cast("double"), 1.0).alias("spacing"), name.alias("name"), unit.alias("unit"))


@query(f"WITH {EMB} SELECT image_id, CAST(l.range AS INTEGER) AS level, st AS size_t, sc AS size_c, greatest(1, CAST(sz // (2 ** l.range) AS INTEGER)) AS size_z, greatest(1, CAST(sy // (2 ** l.range) AS INTEGER)) AS size_y, greatest(1, CAST(sx // (2 ** l.range) AS INTEGER)) AS size_x FROM img, range(4) l")
def pyramid_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _emb(spark, sf_dir).select("image_id", F.explode(dense.pyramid_shapes(F.col("image.pixels_meta"), 4)).alias("s"))
    return rows.select("image_id", "s.*")


@query(f"WITH {EMB} SELECT image_id, t, c, z, CAST(y // 2 AS INTEGER) AS y, CAST(x // 2 AS INTEGER) AS x, CAST(floor(sum(value) / 4) AS INTEGER) AS value FROM px GROUP BY image_id, t, c, z, y // 2, x // 2")
def pyramid_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _emb(spark, sf_dir)
    meta = F.col("image.pixels_meta")
    planes = F.transform("image.planes", lambda p: p.withField("pixels", dense.halved(p["pixels"], meta["size_x"], meta["size_y"], 2, "mean")))
    return _long(df, planes, F.floor(meta["size_x"] / 2))


_NAMES = "WITH d AS (SELECT doc_id AS k FROM documents), f AS (SELECT 'E99_C' || CASE k % 3 WHEN 0 THEN '111' WHEN 1 THEN '222' ELSE '333' END || '_ZS' || CASE WHEN k < 3000 THEN lpad(CAST(k // 3 AS VARCHAR), 3, '0') ELSE CAST(k // 3 AS VARCHAR) END || '.tif' AS name FROM d)"


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    name = F.concat(F.lit("E99_C"), F.when(k % 3 == 0, "111").when(k % 3 == 1, "222").otherwise("333"), F.lit("_ZS"), px.zero_padded(F.floor(k / 3), F.lit(3)), F.lit(".tif"))
    return demo.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k")).select(name.alias("name"))


@query(f"{_NAMES} SELECT name, 0 AS t, CASE WHEN name LIKE '%C111%' THEN 0 ELSE 1 END AS c, CAST(substr(name, 12, 3) AS INTEGER) AS z FROM f WHERE (name LIKE 'E99_C111%' OR name LIKE 'E99_C222%') AND name LIKE 'E99______ZS___.tif' AND substr(name, 12, 3) <= '321'")
def pattern_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pattern.match(_listing(spark, sf_dir), "E99_C<111,222>_ZS<000-321>.tif").select("name", "t", "c", "z")


@query("SELECT doc_id, CAST(k.range AS INTEGER) AS pos, lpad(CAST(doc_id % 7 + k.range * (doc_id % 3 + 1) AS VARCHAR), 3, '0') AS choice FROM documents, range(40) k WHERE doc_id % 7 + k.range * (doc_id % 3 + 1) <= doc_id % 7 + 11")
def pattern_range_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    raw = F.concat(px.zero_padded(d % 7, F.lit(3)), F.lit("-"), (d % 7 + 11).cast("string"), F.lit(":"), (d % 3 + 1).cast("string"))
    return demo.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(pattern.range_choices(raw)).alias("pos", "choice"))


@query(f"{_NAMES} SELECT name, 0 AS t, 0 AS c, CAST(row_number() OVER (ORDER BY name) - 1 AS INTEGER) AS z FROM f WHERE regexp_full_match(name, 'E99_C[12]+_ZS\\d+\\.tif')")
def pattern_regex_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pattern.match(_listing(spark, sf_dir), r"E99_C[12]+_ZS\d+\.tif").select("name", "t", "c", "z")


@query(f"{_NAMES}, m AS (SELECT CASE WHEN name LIKE '%C111%' THEN 0 ELSE 1 END AS c, CAST(substr(name, 12, 3) AS INTEGER) AS z FROM f WHERE (name LIKE 'E99_C111%' OR name LIKE 'E99_C222%') AND name LIKE 'E99______ZS___.tif') SELECT 1 AS size_t, max(c) + 1 AS size_c, max(z) + 1 AS size_z FROM m WHERE z <= 321")
def pattern_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pattern.sizes(pattern.match(_listing(spark, sf_dir), "E99_C<111,222>_ZS<000-321>.tif"))


@query("SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'C' WHEN doc_id % 6 = 1 THEN 'T' WHEN doc_id % 6 = 2 THEN 'Z' WHEN doc_id % 6 = 3 THEN 'S' WHEN doc_id % 6 = 5 THEN 'Z' END AS axis FROM documents")
def pattern_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(*map(F.lit, ("a1_Ch", "tp", "x-ZS", "9series", "plate", "b_FocalPlane")))
    return demo.table(spark, sf_dir, "documents").select("doc_id", pattern.axis_of(F.element_at(words, (F.col("doc_id") % 6 + 1).cast("int"))).alias("axis"))


@query(f"WITH {EMB} SELECT image_id, t, c, z, y, x, value FROM px")
def nest_normalise_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    images, planes = model.normalise(_emb(spark, sf_dir))
    again = model.nest(images, planes)
    return model.pixels_of(model.planes_of(again), model.headers(again)).select("image_id", "t", F.col("c").cast("int").alias("c"), "z", "y", "x", "value")


@query(f"WITH {EMB} SELECT c_custkey, c_mktsegment, {KIND} AS kind, round(avg(value), 6) AS mean_value FROM px JOIN customer ON c_custkey = image_id GROUP BY 1, 2, 3")
def features_join_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = demo.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    images = _emb(spark, sf_dir).select("image_id", describe.kind(F.col("image.pixels_meta")).alias("kind"), F.flatten("image.planes.pixels").alias("pixels"))
    mean = F.aggregate("pixels", F.lit(0).cast("long"), lambda a, v: a + v) / F.size("pixels")
    return images.join(customers, F.col("image_id") == F.col("c_custkey")).select("c_custkey", "c_mktsegment", "kind", F.round(mean, 6).alias("mean_value"))


@query(f"WITH {EMB} SELECT c, CAST(count(*) AS BIGINT) AS n, CAST(sum(value) AS BIGINT) AS total, min(value) AS least, max(value) AS greatest FROM px GROUP BY c")
def intensity_by_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model.planes_of(_emb(spark, sf_dir)).select(F.col("c").cast("int").alias("c"), F.explode("pixels").alias("value"))
    return rows.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("long")).alias("total"), F.min("value").alias("least"), F.max("value").alias("greatest"))


@query(f"WITH {EMB}, p AS (SELECT image_id, c, z, t, CAST(sum(value) AS BIGINT) AS total FROM px GROUP BY 1, 2, 3, 4) SELECT image_id, c, z, t, total, total - lag(total) OVER (PARTITION BY image_id, c, z ORDER BY t) AS delta FROM p")
def frame_delta_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model.planes_of(_emb(spark, sf_dir)).select("image_id", F.col("c").cast("int").alias("c"), "z", "t", F.aggregate("pixels", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))
    return rows.withColumn("delta", F.col("total") - F.lag("total").over(Window.partitionBy("image_id", "c", "z").orderBy("t")))


@query(f"WITH {EMB} SELECT image_id, t, c, z, CAST(sum(value) AS BIGINT) AS total FROM px GROUP BY 1, 2, 3, 4 ORDER BY total DESC, image_id, t, c, z LIMIT 25")
def topk_bright(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model.planes_of(_emb(spark, sf_dir)).select("image_id", "t", F.col("c").cast("int").alias("c"), "z", F.aggregate("pixels", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))
    return rows.orderBy(F.desc("total"), "image_id", "t", "c", "z").limit(25)


@query(f"WITH {EMB} SELECT kind, channels, CAST(count(*) AS BIGINT) AS n FROM (SELECT {KIND} AS kind, sc AS channels FROM img) GROUP BY ROLLUP (kind, channels)")
def kinds_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe.describe(_emb(spark, sf_dir)).rollup("kind", "channels").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EMB} SELECT image_id FROM img WHERE sz > 1 EXCEPT SELECT image_id FROM img WHERE st > 1")
def images_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = describe.describe(_emb(spark, sf_dir))
    return rows.where("size_z > 1").select("image_id").exceptAll(rows.where("size_t > 1").select("image_id"))


_ALL = f"WITH {EMB} SELECT image_id, t, c, z, y, x, value FROM px"


def _read_back(df: DataFrame) -> DataFrame:
    """Long form of records that carry their image's id as their own."""
    rows = df.withColumn("image_id", F.regexp_extract("image.id", r"^(-?\d+)", 1).cast("long"))
    return _long(rows, F.col("image.planes"), F.col("image.pixels_meta.size_x"))


@query(_ALL)
def parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    parquet.write_parquet(_emb(spark, sf_dir).select("image"), path)
    return _read_back(parquet.read_parquet(spark, path))


@query(f"WITH {EMB} SELECT image_id, {KIND} AS kind FROM img")
def parquet_autodetect(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    parquet.write_parquet(_emb(spark, sf_dir), path, column_name="some_scan")
    rows = parquet.read_parquet(spark, path, "image")
    return rows.select("image_id", describe.kind(F.col("image.pixels_meta")).alias("kind"))


@query(_ALL)
def tiff_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    tiff.write_tiff(_emb(spark, sf_dir).select("image"), path)
    return _read_back(tiff.read_tiff(spark, path))


@query(_ALL)
def zarr_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    df = _emb(spark, sf_dir)
    zarr.write_zarr(df.select("image"), path, chunks=(1, 1, 2, 3, 3))
    stores = df.select(F.concat(F.lit(f"{path}/"), F.col("image_id").cast("string"), F.lit(".ome.zarr")).alias("path"))
    return _read_back(zarr.read_zarr(spark, stores))


def _plane_files(spark: SparkSession, sf_dir: str, path: str, wanted: Column | None = None) -> None:
    """A folder for each image with a file for each plane (that is wanted)."""
    rows = files.spread(_emb(spark, sf_dir)).select("image_id", F.explode("image.planes").alias("p"), F.col("image.pixels_meta.size_x").alias("w")).select("image_id", "p.*", "w")

    def file(row: dict):
        plane = np.array(row["pixels"], dtype=np.uint16).reshape(-1, row["w"])
        yield f"{row['image_id']}/s_T{row['t']}_C{row['c']}_Z{row['z']:02d}.tif", tiff.encode([plane], "")

    files.written(rows if wanted is None else rows.where(wanted), file, path)


@query(_ALL)
def stack_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    _plane_files(spark, sf_dir, path)
    return _read_back(tiff.read_stacks(spark, path, "s_T<0-3>_C<0-3>_Z<00-03>.tif"))


@query(f"""WITH {EMB}, k AS (SELECT * FROM px WHERE (t + c + z) % 3 <> 2), s AS (SELECT image_id, max(t) + 1 AS nt, max(c) + 1 AS nc, max(z) + 1 AS nz, any_value(sy) AS ny, any_value(sx) AS nx FROM k GROUP BY image_id),
n AS (SELECT CAST(range AS INTEGER) AS i FROM range(8)),
g AS (SELECT image_id, t.i AS t, c.i AS c, z.i AS z, y.i AS y, x.i AS x FROM s, n t, n c, n z, n y, n x WHERE t.i < nt AND c.i < nc AND z.i < nz AND y.i < ny AND x.i < nx)
SELECT image_id, t, c, z, y, x, coalesce(value, 0) AS value FROM g LEFT JOIN k USING (image_id, t, c, z, y, x)""")
def stack_missing_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes follow from the files there are; zero planes fill what is missing between them."""
    path = shared_folder(spark)
    _plane_files(spark, sf_dir, path, (F.col("t") + F.col("c") + F.col("z")) % 3 != 2)
    return _read_back(tiff.read_stacks(spark, path, "s_T<0-3>_C<0-3>_Z<00-03>.tif"))


@query(f"WITH {EMB} SELECT image_id, chr(CAST(97 + c AS INTEGER)) AS channel, t, c, z, y, x, value FROM px")
def stack_deep_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of several depths spill from their own on; the choices of a bracket name the channels."""
    path = shared_folder(spark)
    rows = files.spread(_emb(spark, sf_dir), "image_id").select("image_id", F.explode("image.planes").alias("p"), F.col("image.pixels_meta.size_x").alias("w"))
    rows = rows.groupBy("image_id", "w", "p.t", "p.c").agg(F.array_sort(F.collect_list(F.struct("p.z", "p.pixels"))).alias("deep"))

    def file(row: dict):
        planes = [np.array(p["pixels"], dtype=np.uint16).reshape(-1, row["w"]) for p in row["deep"]]
        yield f"{row['image_id']}/s_T{row['t']}_C{'abcd'[row['c']]}_Z00.tif", tiff.encode(planes, "")

    files.written(rows, file, path)
    back = tiff.read_stacks(spark, path, "s_T<0-3>_C<a,b,c,d>_Z<00>.tif")
    rows = back.withColumns({"image_id": F.col("image.id").cast("long"), "names": F.col("image.pixels_meta.channels.name")})
    return _long(rows, F.col("image.planes"), F.col("image.pixels_meta.size_x"), "names").withColumn("channel", F.get("names", F.col("c"))).drop("names")


_SUMMARY = ORACLE_SQL["describe_summary"]


@query(_SUMMARY)
def tiff_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What TIFF files hold, from their headers: no pixel is decoded."""
    path = shared_folder(spark)
    tiff.write_tiff(_emb(spark, sf_dir).select("image"), path)
    found = describe.describe(files.headers_of(tiff.read_tiff(spark, path)).withColumn("image_id", F.regexp_extract("image.id", r"^(-?\d+)", 1).cast("long")))
    return found


@query(_SUMMARY)
def zarr_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What Zarr stores hold, from their metadata: no chunk is read."""
    path = shared_folder(spark)
    df = _emb(spark, sf_dir)
    zarr.write_zarr(df.select("image"), path)
    stores = df.select(F.concat(F.lit(f"{path}/"), F.col("image_id").cast("string"), F.lit(".ome.zarr")).alias("path"))
    found = files.headers_of(zarr.read_zarr(spark, stores))
    return describe.describe(found.withColumn("image_id", F.regexp_extract("image.id", r"^(-?\d+)", 1).cast("long")))


@query(f"WITH {EMB} SELECT image_id, {KIND} AS kind FROM img ORDER BY image_id LIMIT 1 OFFSET 7")
def parquet_row_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eighth row of a file: picking it is the feature."""
    path = shared_folder(spark)
    parquet.write_parquet(_emb(spark, sf_dir).repartition(1).sortWithinPartitions("image_id"), path)
    rows = parquet.read_parquet(spark, path, row_index=7)
    return rows.select("image_id", describe.kind(F.col("image.pixels_meta")).alias("kind"))


@query(f"WITH {EMB} SELECT image_id, k AS key, v AS value FROM img, (VALUES ('image.type', '{schema.TYPE_TAG}'), ('image.version', '{schema.VERSION_TAG}'), ('plate', 'E99')) t(k, v)")
def parquet_footer_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    parquet.write_interop(_emb(spark, sf_dir).select("image"), path, file_metadata={"plate": "E99"})
    tags = parquet.read_tags(spark, path)
    return tags.select(px.stem(F.col("path")).cast("long").alias("image_id"), "key", "value")


@query(f"WITH {EMB} SELECT image_id, '{schema.TYPE_TAG}' AS type, '{schema.VERSION_TAG}' AS version, CASE WHEN sz = 1 THEN 'XYCT' ELSE 'XYZCT' END AS dimension_order, 'uint16' AS dtype, '2024-05-06 07:08:09' AS acquired, 1 AS n_planes, sy * sx AS n_pixels, CAST(0 AS BIGINT) AS total, 'unknown' AS name FROM img")
def record_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a record is that only its id and sizes are known of; the clock is given."""
    rows = demo.emb_values(spark, sf_dir)
    size = {f"size_{a}": F.col(f"size_{a}") for a in "tczyx"}
    made = rows.select("image_id", schema.image(image_id=F.col("image_id").cast("string"), clock=F.lit("2024-05-06 07:08:09").cast("timestamp_ntz"), **size).alias("r"))
    pixels = F.flatten("r.planes.pixels")
    return made.select(
        "image_id",
        "r.type",
        "r.version",
        "r.pixels_meta.dimension_order",
        F.col("r.pixels_meta.type").alias("dtype"),
        F.date_format("r.acquisition_datetime", "yyyy-MM-dd HH:mm:ss").alias("acquired"),
        F.size("r.planes").alias("n_planes"),
        F.size(pixels).alias("n_pixels"),
        F.aggregate(pixels, F.lit(0).cast("long"), lambda a, v: a + v).alias("total"),
        "r.name",
    )


@query(f"WITH {EMB} SELECT DISTINCT image_id, c AS k, CAST(c AS VARCHAR) AS id, CAST(c * 10 + label AS VARCHAR) AS name, '3' AS illumination FROM px")
def channels_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers given for a channel's id, name and illumination become text."""
    given = F.transform(F.sequence(F.lit(0), F.col("size_c") - 1), lambda i: F.struct(i.alias("id"), (i * 10 + F.col("label")).alias("name"), F.lit(None).cast("float").alias("emission_um"), F.lit(None).cast("float").alias("excitation_um"), F.lit(3).alias("illumination"), F.lit(None).cast("long").alias("color_rgba")))
    rows = demo.emb_values(spark, sf_dir).select("image_id", schema.image(channels=given, size_c=F.col("size_c"))["pixels_meta"]["channels"].alias("channels"))
    return rows.select("image_id", F.posexplode("channels").alias("k", "ch")).select("image_id", "k", "ch.id", "ch.name", "ch.illumination")


@query(f"WITH {EMB} SELECT image_id, sx AS size_x, CAST(NULL AS FLOAT) AS physical_size_x, 'emb-' || image_id AS name, CAST(sum(value) AS BIGINT) AS total, CAST(7 AS INTEGER) AS n_fields FROM px GROUP BY image_id, sx")
def canonical_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with wider numbers, extra and missing fields in another order, in the canonical schema."""
    image = F.col("image")
    wide = F.transform(image["planes"], lambda p: F.struct(F.lit("x").alias("extra"), p["pixels"].cast("array<bigint>").alias("pixels"), p["c"].cast("long").alias("c"), p["t"], p["z"]))
    loose = F.struct(wide.alias("planes"), F.struct(F.lit(1).alias("more"), image["pixels_meta"]["size_x"].cast("long").alias("size_x")).alias("pixels_meta"), image["id"], image["name"])
    df = schema.canonical(_emb(spark, sf_dir).select("image_id", loose.alias("image")))
    meta = F.col("image.pixels_meta")
    total = F.aggregate(F.flatten("image.planes.pixels"), F.lit(0).cast("long"), lambda a, v: a + v)
    return df.select("image_id", meta["size_x"].alias("size_x"), meta["physical_size_x"].alias("physical_size_x"), "image.name", total.alias("total"), F.lit(len(df.schema["image"].dataType.fields)).alias("n_fields"))


@query(f"WITH {EMB} SELECT image_id, CASE WHEN sx < 4 OR sy < 4 THEN 'crop bounds are outside the image' WHEN st < 2 THEN 'the selection must keep an index of each of t, c and z' END AS problem FROM img")
def slice_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _emb(spark, sf_dir).select("image_id", slicing.slice_problem(F.col("image"), 0, 4, 0, 4, t_indices=[1, 9]).alias("problem"))


@query(f"WITH {EMB} SELECT image_id, CASE WHEN sc < 2 THEN 'no channel 1' END AS problem FROM img")
def channel_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _emb(spark, sf_dir).select("image_id", slicing.channel_problem(F.col("image"), 1).alias("problem"))


@query(f"WITH {EMB} SELECT image_id, CASE image_id % 4 WHEN 1 THEN 'all sizes must be positive' WHEN 2 THEN 'a plane''s index is out of range' WHEN 3 THEN 'a plane has the wrong length' END AS problem FROM img")
def dense_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    which, image = F.col("image_id") % 4, F.col("image")
    last = F.element_at(image["planes"], -1)
    broken = (
        F.when(which == 1, image.withField("pixels_meta.size_z", F.lit(0)))
        .when(which == 2, image.withField("planes", F.concat(image["planes"], F.array(last.withField("t", F.lit(40))))))
        .when(which == 3, image.withField("planes", F.concat(image["planes"], F.array(last.withField("pixels", F.array(F.lit(1)))))))
        .otherwise(image)
    )
    return _emb(spark, sf_dir).select("image_id", dense.dense_problem(broken).alias("problem"))


@query(f"WITH {EVT} SELECT image_id, t, c, z, pos, value FROM (SELECT *, row_number() OVER (PARTITION BY image_id, t, c, z ORDER BY pos DESC) AS rn FROM cell) WHERE rn = 1")
def latest_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event is a plane of one pixel; of duplicates the last counts."""
    planes = demo.evt_cells(spark, sf_dir).select("image_id", "t", "c", "z", "pos", F.array("value").alias("pixels"))
    return slicing.latest(planes).select("image_id", "t", "c", "z", "pos", F.get("pixels", F.lit(0)).alias("value"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN CAST(16777215 AS BIGINT) ELSE CAST(c_custkey // 256 AS BIGINT) END AS rgb FROM customer")
def rgb_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = demo.table(spark, sf_dir, "customer")
    return rows.select("c_custkey", px.rgb(F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey"))).alias("rgb"))


@query(f"WITH {EMB} SELECT DISTINCT image_id, CASE WHEN image_id % 2 = 0 THEN 'emb-' || image_id ELSE CAST(image_id AS VARCHAR) END AS title, c AS k, CASE WHEN (image_id + c) % 2 = 0 THEN 'dye' || c ELSE 'C' || c END AS channel, CASE WHEN image_id % 3 = 0 THEN 'nm' ELSE 'µm' END AS unit, CAST(CASE WHEN label % 3 = 0 THEN 1.0 ELSE 0.5 END AS DOUBLE) AS spacing FROM px")
def export_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, channel names, units and spacings that writers give where a record has none."""
    image, i = F.col("image"), F.col("image_id")
    names = F.transform(image["pixels_meta"]["channels"], lambda ch, k: ch.withField("name", F.when((i + k) % 2 == 0, ch["name"])))
    odd = image.withField("name", F.when(i % 2 == 0, image["name"]).otherwise("")).withField("pixels_meta.channels", names)
    odd = odd.withField("pixels_meta.physical_size_x_unit", F.when(i % 3 == 0, "nm").otherwise(""))
    rows = tiff.export_rows(_emb(spark, sf_dir).withColumn("image", odd), "image", "uint16", False, F.col("image.id"))
    rows = rows.select(F.col("file").cast("long").alias("image_id"), "title", F.posexplode("channels").alias("k", "channel"), F.get("units", F.lit(0)).alias("unit"), F.get("spacing", F.lit(0)).alias("spacing"))
    return rows.select("image_id", "title", "k", "channel", "unit", "spacing")


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name || '.ome.tif' WHEN 1 THEN c_name || '.TIFF' WHEN 2 THEN c_name || '.zarr' ELSE '.' || c_name END AS file, CASE c_custkey % 4 WHEN 0 THEN c_name || '.ome' WHEN 1 THEN c_name WHEN 2 THEN c_name ELSE '.' || c_name END AS stem, CASE c_custkey % 4 WHEN 0 THEN '.tif' WHEN 1 THEN '.tiff' WHEN 2 THEN '.zarr' ELSE '' END AS suffix FROM customer""")
def path_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("c_custkey") % 4, F.col("c_name")
    path = F.when(k == 0, F.concat(F.lit(" /d/e/"), name, F.lit(".ome.tif"))).when(k == 1, F.concat(name, F.lit(".TIFF "))).when(k == 2, F.concat(F.lit("s3://b/"), name, F.lit(".zarr/"))).otherwise(F.concat(F.lit("/d/."), name))
    return demo.table(spark, sf_dir, "customer").select("c_custkey", px.file_name(path).alias("file"), px.stem(path).alias("stem"), px.suffix(F.trim(path)).alias("suffix"))


@query(f"WITH {EMB} SELECT image_id, (sz + 1) // 2 AS size_z, (sy + 1) // 2 AS size_y, (sx + 1) // 2 AS size_x, CAST(3.0 AS DOUBLE) AS spacing_z, CAST(4.0 AS DOUBLE) AS spacing_y, CAST(6.0 AS DOUBLE) AS spacing_x FROM img")
def spacing_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _emb(spark, sf_dir).select("image_id", slicing.downsampled_volume(F.col("image"), 0, 2, (1.5, 2.0, 3.0)).alias("v"))
    return rows.select("image_id", *(f"v.{n}_{a}" for n in ("size", "spacing") for a in "zyx"))


@query(f"WITH {EMB} SELECT image_id, i, {KIND} AS kind, CAST(((value - 40000) % 256 + 256) % 256 AS BIGINT) AS wrapped, CAST(least(65535, greatest(0, value * 2 - 20000)) AS BIGINT) AS clamped, CAST(value // 256 AS BIGINT) AS rgb FROM px")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql.register(spark)
    rows = demo.emb_values(spark, sf_dir).select("image_id", "size_t", "size_z", F.posexplode("flat").alias("i", "v"))
    return rows.selectExpr("image_id", "i", "image_kind(size_t, size_z) AS kind", "pixel_wrap_u8(v - 40000) AS wrapped", "pixel_clamp_u16(v * 2 - 20000) AS clamped", "rgb_of_rgba(v) AS rgb")


@query(f"WITH {EMB} SELECT CAST(c AS INTEGER) AS c, CAST(count(*) AS BIGINT) AS n, CAST(sum(value) AS BIGINT) AS total FROM px GROUP BY c")
def stream_brightness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by channel over image files read as a stream; the running result has a row for each channel."""
    path, name = shared_folder(spark), f"brightness_{uuid.uuid4().hex}"
    tiff.write_tiff(_emb(spark, sf_dir).select("image"), path)
    sums = streaming.brightness(streaming.first_planes(streaming.stream_planes(spark, path)))
    writer = sums.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", shared_folder(spark)).trigger(availableNow=True)
    with streaming.many_files(spark):
        writer.start().awaitTermination()
    return spark.table(name).select(F.col("c").cast("int").alias("c"), "n", "total")
