"""Crop, select and reindex; plane lookup; volumes and strides.

On records everything is one projection: no shuffle, whatever the table's
size.  On normalised tables the selection is a filter on (t, c, z), which
reaches the scan before any pixel is read.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.functions.pixels import crop, falsy_or, ints, let, strided
from lumenframe.schema import CHANNEL, PLANE


def _keep(indices: Iterable[int] | None, size: Column) -> Column:
    """The selection, sorted and distinct; None is everything, what is out of range is dropped."""
    if indices is None:
        return ints(F.lit(0), size - 1)
    wanted = F.array(*(F.lit(int(i)) for i in sorted({int(i) for i in indices}))).cast("array<int>")
    return F.filter(wanted, lambda i: (i >= 0) & (i < size))


def last_plane(planes: Column, t: Column, c: Column, z: Column) -> Column:
    """The plane at (t, c, z); the last of duplicates; null if there is none."""
    return F.try_element_at(F.filter(planes, lambda p: (p["t"] == t) & (p["c"] == c) & (p["z"] == z)), F.lit(-1))


def places(planes: Column, place) -> Column:
    """(k, i) by k: the numbers that ``place`` gives to planes, and where in ``planes`` each is; the last of duplicates, none for null.

    One pass and a sort of small pairs, however many places are asked for.
    """
    numbered = F.transform(planes, lambda p, i: F.struct(place(p).cast("int").alias("k"), i.alias("i")))
    ordered = F.array_sort(F.filter(numbered, lambda x: x["k"].isNotNull()))
    return let(ordered, lambda s: F.filter(s, lambda x, j: ~F.coalesce(F.get(s, j + 1)["k"] == x["k"], F.lit(False))))


def grid(planes: Column, place, size: Column, pixels) -> Column:
    """An array of ``size`` elements: ``pixels`` of the plane at each place, null where there is none."""
    none = F.lit(None).cast("array<int>")

    def built(s: Column) -> Column:
        before = lambda j: F.coalesce(F.get(s, j - 1)["k"], F.lit(-1))
        steps = F.transform(s, lambda x, j: F.concat(F.array_repeat(none, x["k"] - before(j) - 1), F.array(pixels(F.get(planes, x["i"])))))
        rest = size.cast("int") - 1 - F.coalesce(F.try_element_at(s, F.lit(-1))["k"], F.lit(-1))
        return F.concat(F.flatten(steps), F.array_repeat(none, F.greatest(rest, F.lit(0))))

    return let(places(planes, place), built)


def select_channels(channels: Column, size_c: Column, keep: Column) -> Column:
    """The kept channels, renumbered; a list of another length than size_c is replaced by bare ones."""

    def bare(k: Column) -> Column:
        nothing = {f.name: F.lit(None).cast(f.dataType) for f in CHANNEL.fields}
        nothing |= {"id": F.concat(F.lit("ch-"), k.cast("string")), "name": F.concat(F.lit("C"), k.cast("string")), "color_rgba": F.lit(0xFFFFFFFF).cast("long")}
        return F.struct(*(v.alias(n) for n, v in nothing.items()))

    def kept(old: Column, k: Column) -> Column:
        whole = F.get(channels, old)
        named = whole.withField("id", F.concat(F.lit("ch-"), k.cast("string"))).withField("name", F.coalesce(whole["name"], F.concat(F.lit("C"), k.cast("string"))))
        # Without a channel list the names count the old numbers, the ids the new.
        return F.when(F.size(channels) == size_c, named).otherwise(bare(k).withField("name", F.concat(F.lit("C"), old.cast("string"))))

    return F.transform(keep, kept)


def _bounds(x_min: int, x_max: int, y_min: int, y_max: int, size_x: Column, size_y: Column, keep: list[Column]) -> Column:
    """What is wrong with a crop and a selection; null if nothing is."""
    x0, x1, y0, y1 = (F.lit(int(v)) for v in (x_min, x_max, y_min, y_max))
    inside = (x0 >= 0) & (x0 < x1) & (x1 <= size_x) & (y0 >= 0) & (y0 < y1) & (y1 <= size_y)
    some = reduce(lambda a, b: a & b, (F.size(k) > 0 for k in keep))
    return F.when(~F.coalesce(inside, F.lit(False)), F.lit("crop bounds are outside the image")).when(~some, F.lit("the selection must keep an index of each of t, c and z"))


def _sizes(image: Column) -> dict[str, Column]:
    return {a: F.coalesce(image["pixels_meta"][f"size_{a}"].cast("int"), F.lit(1)) for a in "xyzct"}


def slice_problem(image: Column, x_min: int, x_max: int, y_min: int, y_max: int, t_indices: Iterable[int] | None = None, c_indices: Iterable[int] | None = None, z_indices: Iterable[int] | None = None) -> Column:
    """Why a record cannot be sliced so; null if it can."""
    sizes = _sizes(image)
    keep = [_keep(i, sizes[a]) for a, i in (("t", t_indices), ("c", c_indices), ("z", z_indices))]
    none = F.when(~F.coalesce(F.size(image["planes"]) > 0, F.lit(False)), F.lit("the record has no planes"))
    return F.coalesce(_bounds(x_min, x_max, y_min, y_max, sizes["x"], sizes["y"], keep), none)


_LENGTH = "a plane has the wrong length"


def slice_record(image: Column, x_min: int, x_max: int, y_min: int, y_max: int, t_indices: Iterable[int] | None = None, c_indices: Iterable[int] | None = None, z_indices: Iterable[int] | None = None, fill_missing: bool = True) -> Column:
    """A cropped copy of a record, with the selected t, c, z renumbered from 0.

    Bounds outside the image, an empty selection, no planes or a plane of the
    wrong length are errors.  Missing planes are zero, or left out without
    ``fill_missing``.  Of duplicate planes the last counts.
    """
    meta, sizes = image["pixels_meta"], _sizes(image)
    wanted = {"t": t_indices, "c": c_indices, "z": z_indices}
    keep = {a: _keep(i, sizes[a]) for a, i in wanted.items()}
    x0, x1, y0, y1 = (F.lit(int(v)) for v in (x_min, x_max, y_min, y_max))
    n = (x1 - x0) * (y1 - y0)
    bound = F.struct(image["planes"].alias("planes"), *(keep[a].alias(a) for a in "tcz"), *(sizes[a].alias(f"size_{a}") for a in "xytcz"))

    def sliced(b: Column) -> Column:
        count = {a: F.size(b[a]) for a in "tcz"}

        def at(p: Column, a: str) -> Column:
            """Where in the selection a plane's index is, from 0; null if it is not."""
            if wanted[a] is None:
                return F.when((p[a] >= 0) & (p[a] < b[f"size_{a}"]), p[a].cast("int"))
            return F.nullif(F.array_position(b[a], p[a].cast("int")), F.lit(0)) - 1

        def place(p: Column) -> Column:
            return (at(p, "t") * count["c"] + at(p, "c")) * count["z"] + at(p, "z")

        def cut(p: Column) -> Column:
            whole = F.size(p["pixels"]) == b["size_x"] * b["size_y"]
            return F.when(whole, crop(p["pixels"], b["size_x"], x0, x1, y0, y1)).otherwise(F.raise_error(F.lit(_LENGTH)).cast("array<int>"))

        def plane(k: Column, pixels: Column) -> Column:
            index = {"z": k % count["z"], "c": F.floor(k / count["z"]) % count["c"], "t": F.floor(k / (count["z"] * count["c"]))}
            return F.struct(*((index[f.name].cast(f.dataType) if f.name in index else pixels).alias(f.name) for f in PLANE.fields))

        if fill_missing:
            cells = grid(b["planes"], place, count["t"] * count["c"] * count["z"], cut)
            return F.transform(cells, lambda p, k: plane(k, F.coalesce(p, F.array_repeat(F.lit(0), n))))
        return F.transform(places(b["planes"], place), lambda x: plane(x["k"], cut(F.get(b["planes"], x["i"]))))

    new = {"size_x": x1 - x0, "size_y": y1 - y0, "size_z": F.size(keep["z"]), "size_c": F.size(keep["c"]).cast("short"), "size_t": F.size(keep["t"])}
    new_meta = meta
    for name, value in new.items():
        new_meta = new_meta.withField(name, value)
    new_meta = new_meta.withField("channels", select_channels(meta["channels"], sizes["c"], keep["c"]))
    problem = slice_problem(image, x_min, x_max, y_min, y_max, t_indices, c_indices, z_indices)
    planes = F.when(problem.isNull(), let(bound, sliced)).otherwise(F.raise_error(problem).cast(T.ArrayType(PLANE)))
    return F.when(image.isNotNull(), image.withField("pixels_meta", new_meta).withField("planes", planes))


def slice_images(df: DataFrame, *bounds, column: str = "image", **selection) -> DataFrame:
    return df.withColumn(column, slice_record(F.col(column), *bounds, **selection))


def latest(planes: DataFrame, key: str = "image_id") -> DataFrame:
    """Of duplicate planes the one with the greatest ``pos``.  One shuffle; only the winner's pixels are kept while aggregating."""
    rest = [c for c in planes.columns if c not in (key, "t", "c", "z", "pos")]
    best = planes.groupBy(key, "t", "c", "z").agg(F.max_by(F.struct("pos", *rest), "pos").alias("best"))
    return best.select(key, "t", "c", "z", "best.*")


def slice_planes(images: DataFrame, planes: DataFrame, x_min: int, x_max: int, y_min: int, y_max: int, t_indices: Iterable[int] | None = None, c_indices: Iterable[int] | None = None, z_indices: Iterable[int] | None = None, fill_missing: bool = True, key: str = "image_id") -> DataFrame:
    """Slice of normalised tables: (key, t, c, z, pixels).

    The selection filters planes at the scan; what is left is cropped where it
    meets the sizes of its image, so that later shuffles carry cropped pixels.
    Bounds outside an image, an empty selection and a plane of the wrong length
    are errors, as in records.  An image without any planes is all zeros, or no
    rows without ``fill_missing``.
    """
    wanted = {"t": t_indices, "c": c_indices, "z": z_indices}
    for axis, indices in wanted.items():
        if indices is not None:
            planes = planes.where(F.col(axis).isin(sorted({int(i) for i in indices})))
    keep = [_keep(i, F.col(f"size_{a}")) for a, i in wanted.items()]
    problem = _bounds(x_min, x_max, y_min, y_max, F.col("size_x"), F.col("size_y"), keep)
    sized = images.select(key, F.col("size_x").cast("int").alias("size_x"), F.col("size_y").cast("int").alias("size_y"))
    met = planes.join(sized, key)
    whole = F.coalesce(F.size("pixels") == F.col("size_x") * F.col("size_y"), F.lit(False))
    cut = crop(F.col("pixels"), F.col("size_x"), *(F.lit(v) for v in (x_min, x_max, y_min, y_max)))
    # A wrong plane is an error only if it counts, that is if it is the last of its place.
    met = met.select(key, "t", "c", "z", *(["pos"] if "pos" in planes.columns else []), whole.alias("whole"), F.when(whole, cut).alias("cut"))
    kept = latest(met, key) if "pos" in planes.columns else met
    cells = images.select(key, *(F.when(problem.isNull(), k).otherwise(F.raise_error(problem).cast("array<int>")).alias(f"keep_{a}") for k, a in zip(keep, wanted, strict=True)))
    # The outer form: else Spark would judge sizes, and raise, ahead of a filter on ``images``.
    for axis in wanted:
        cells = cells.withColumn(axis, F.explode_outer(f"keep_{axis}"))
    joined = cells.join(kept, [key, "t", "c", "z"], "left" if fill_missing else "inner")
    zeros = F.array_repeat(F.lit(0), (x_max - x_min) * (y_max - y_min))
    pixels = F.when(F.col("whole").isNull(), zeros).when(F.col("whole"), F.col("cut")).otherwise(F.raise_error(F.lit(_LENGTH)).cast("array<int>"))
    return joined.select(key, *((F.array_position(F.col(f"keep_{a}"), F.col(a).cast("int")) - 1).cast("int").alias(a) for a in wanted), pixels.alias("pixels"))


def plane_at(image: Column, t: int, c: int, z: int) -> Column:
    """The plane's pixels; an error if there is no such plane."""
    found = last_plane(image["planes"], F.lit(t), F.lit(c), F.lit(z))
    return F.when(found.isNotNull(), found["pixels"]).otherwise(F.raise_error(F.lit(f"no plane at t={t}, c={c}, z={z}")).cast("array<int>"))


def channel_problem(image: Column, c: int) -> Column:
    """A message if there is no channel ``c``, else null."""
    size = image["pixels_meta"]["size_c"]
    return F.when(~F.coalesce((F.lit(c) >= 0) & (F.lit(c) < size), F.lit(False)), F.lit(f"no channel {c}"))


def volume(image: Column, c: int) -> Column:
    """Planes of channel ``c`` at t = 0 by depth; missing ones are zero.  An error if there is no such channel."""
    meta, problem = image["pixels_meta"], channel_problem(image, c)

    def place(p: Column) -> Column:
        return F.when((p["t"] == 0) & (p["c"] == c) & (p["z"] >= 0) & (p["z"] < meta["size_z"]), p["z"])

    zero = F.array_repeat(F.lit(0), meta["size_x"] * meta["size_y"])
    stack = F.transform(grid(image["planes"], place, meta["size_z"], lambda p: p["pixels"]), lambda p: F.coalesce(p, zero))
    return F.when(problem.isNull(), stack).otherwise(F.raise_error(problem).cast("array<array<int>>"))


def downsampled_volume(image: Column, c: int, step: int, spacing_zyx: tuple[float, float, float] | None = None) -> Column:
    """Every ``step``-th voxel of a volume along z, y and x, with the spacing that belongs to it."""
    meta = image["pixels_meta"]
    spacing = [F.lit(float(s)) for s in spacing_zyx] if spacing_zyx else [falsy_or(meta[f"physical_size_{a}"].cast("double"), 1.0) for a in "zyx"]
    layers = F.filter(volume(image, c), lambda p, z: z % step == 0)
    return F.struct(
        F.transform(layers, lambda p: strided(p, meta["size_x"], meta["size_y"], step)).alias("layers"),
        *(F.ceil(meta[f"size_{a}"] / step).cast("int").alias(f"size_{a}") for a in "zyx"),
        *((s * step).alias(f"spacing_{a}") for a, s in zip("zyx", spacing, strict=True)),
    )
