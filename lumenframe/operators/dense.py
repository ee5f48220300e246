"""Dense grids of pixels, casts and pyramids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.pixels import RANGES, clamp, ints, let, pad_or_cut, wrap
from lumenframe.operators.slicing import grid, latest


def cast_pixels(pixels: Column, dtype: str = "uint16", clamped: bool = False) -> Column:
    """Clamped into the range of ``dtype``, or wrapped as an unchecked cast does."""
    if dtype in ("float32", "float64"):
        return pixels.cast(f"array<{'float' if dtype == 'float32' else 'double'}>")
    if dtype not in RANGES:
        raise ValueError(f"unknown dtype {dtype}")
    return F.transform(pixels, lambda v: clamp(v, dtype) if clamped else wrap(v, dtype))


def dense_problem(image: Column, strict: bool = True) -> Column:
    """Why a record has no dense grid; null if it has."""
    meta, planes = image["pixels_meta"], image["planes"]
    n = meta["size_x"] * meta["size_y"]
    positive = (meta["size_x"] > 0) & (meta["size_y"] > 0) & (meta["size_z"] > 0) & (meta["size_c"] > 0) & (meta["size_t"] > 0)
    inside = F.forall(planes, lambda p: p["t"].between(0, meta["size_t"] - 1) & p["c"].between(0, meta["size_c"] - 1) & p["z"].between(0, meta["size_z"] - 1))
    out = F.when(~F.coalesce(positive, F.lit(False)), F.lit("all sizes must be positive")).when(~F.coalesce(inside, F.lit(True)), F.lit("a plane's index is out of range"))
    if strict:
        lengths = F.forall(planes, lambda p: F.size(p["pixels"]) == n)
        out = out.when(~F.coalesce(lengths, F.lit(True)), F.lit("a plane has the wrong length"))
    return out


def dense(image: Column, dtype: str = "uint16", strict: bool = True, clamped: bool = False) -> Column:
    """Planes in order of t, c, z, none missing (zeros instead), each of size_y * size_x pixels.

    Sizes must be positive and plane indices in range.  A plane of another
    length is an error, or with ``strict=False`` cut or padded with zeros.  Of
    duplicates the last counts.
    """
    meta = image["pixels_meta"]
    bound = F.struct(image["planes"].alias("planes"), *(meta[f"size_{a}"].cast("int").alias(f"size_{a}") for a in "tczyx"))

    def gridded(b: Column) -> Column:
        n = b["size_x"] * b["size_y"]

        def place(p: Column) -> Column:
            return (p["t"] * b["size_c"] + p["c"]) * b["size_z"] + p["z"]

        def cell(pixels: Column, k: Column) -> Column:
            index = {"t": F.floor(k / (b["size_z"] * b["size_c"])), "c": F.floor(k / b["size_z"]) % b["size_c"], "z": k % b["size_z"]}
            whole = F.coalesce(pixels, F.array_repeat(F.lit(0), n))
            return F.struct(*(v.cast("int").alias(a) for a, v in index.items()), cast_pixels(whole, dtype, clamped).alias("pixels"))

        cells = grid(b["planes"], place, b["size_t"] * b["size_c"] * b["size_z"], lambda p: p["pixels"] if strict else pad_or_cut(p["pixels"], n))
        return F.transform(cells, cell)

    problem, found = dense_problem(image, strict), let(bound, gridded)
    kind = "float" if dtype == "float32" else "double" if dtype == "float64" else "bigint"
    return F.when(problem.isNull(), found).otherwise(F.raise_error(problem).cast(f"array<struct<t:int,c:int,z:int,pixels:array<{kind}>>>"))


def dense_planes(images: DataFrame, planes: DataFrame, key: str = "image_id", strict: bool = True) -> DataFrame:
    """The dense grid of normalised tables, for images too large for one row: a left join of the grid with the latest planes.

    ``images`` has the sizes; planes out of range raise.
    """
    cells = images.select(key, "size_x", "size_y", *(f"size_{a}" for a in "tcz"))
    for a in "tcz":
        cells = cells.withColumn(a, F.explode(ints(F.lit(0), F.col(f"size_{a}").cast("int") - 1)))
    own = latest(planes, key) if "pos" in planes.columns else planes
    sizes = images.select(key, *(F.col(f"size_{a}").alias(f"limit_{a}") for a in "tcz"))
    checked = own.join(sizes, key)
    ok = F.lit(True)
    for a in "tcz":
        ok = ok & (F.col(a) >= 0) & (F.col(a) < F.col(f"limit_{a}"))
    checked = checked.withColumn("pixels", F.when(ok, F.col("pixels")).otherwise(F.raise_error(F.lit("a plane's index is out of range")).cast("array<int>"))).select(key, "t", "c", "z", "pixels")
    n = F.col("size_x") * F.col("size_y")
    joined = cells.join(checked, [key, "t", "c", "z"], "left")
    found = F.when(F.size("pixels") == n, F.col("pixels")).otherwise(F.raise_error(F.lit("a plane has the wrong length")).cast("array<int>") if strict else pad_or_cut(F.col("pixels"), n))
    return joined.select(key, "t", "c", "z", F.when(F.col("pixels").isNull(), F.array_repeat(F.lit(0), n)).otherwise(found).alias("pixels"))


def pyramid_shapes(meta: Column, levels: int, factor: int = 2) -> Column:
    """(level, size_t, size_c, size_z, size_y, size_x): z, y and x are divided per level, down to 1; at least one level."""
    start = F.struct(*(meta[f"size_{a}"].cast("int").alias(f"size_{a}") for a in "tczyx"))

    def down(s: Column) -> Column:
        return F.struct(*((s[f"size_{a}"] if a in "tc" else F.greatest(F.lit(1), F.floor(s[f"size_{a}"] / factor).cast("int"))).alias(f"size_{a}") for a in "tczyx"))

    shapes, level = [], start
    for k in range(max(1, int(levels))):
        shapes.append(F.struct(F.lit(k).alias("level"), *(level[f"size_{a}"].alias(f"size_{a}") for a in "tczyx")))
        level = down(level)
    return F.array(*shapes)


def halved(pixels: Column, size_x: Column, size_y: Column, factor: int, how: str = "nearest") -> Column:
    """A plane of the next pyramid level: the first pixel of each block, or its mean rounded down."""
    new_x, new_y = F.greatest(F.lit(1), F.floor(size_x / factor)), F.greatest(F.lit(1), F.floor(size_y / factor))

    def block(pixels: Column, y: Column, x: Column) -> Column:
        if how == "nearest":
            return F.get(pixels, (y * factor * size_x + x * factor).cast("int"))
        cells = F.array(*(F.when((y * factor + j < size_y) & (x * factor + i < size_x), F.get(pixels, ((y * factor + j) * size_x + x * factor + i).cast("int"))) for j in range(factor) for i in range(factor)))
        cells = F.array_compact(cells)
        return F.floor(F.aggregate(cells, F.lit(0).cast("long"), lambda a, v: a + v) / F.size(cells)).cast("int")

    if how not in ("nearest", "mean"):
        raise ValueError(f"unknown way to downsample: {how}")
    return let(pixels, lambda p: F.flatten(F.transform(ints(F.lit(0), new_y - 1), lambda y: F.transform(ints(F.lit(0), new_x - 1), lambda x: block(p, y, x)))))
