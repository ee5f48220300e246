"""Records from array columns of any axis order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe import schema
from lumenframe.functions.pixels import clamp, ints, let

AXES = "TCZYX"


def dim_order_of(order: str | None, ndim: int) -> str:
    """The axes of an array: given ones must be distinct, of TCZYX, with Y and X; without any, the last ``ndim`` of TCZYX."""
    order = (order or AXES[-ndim:]).upper()
    if len(order) != ndim or len(set(order)) != ndim or set(order) - set(AXES) or not {"Y", "X"} <= set(order):
        raise ValueError(f"axes {order} do not name {ndim} dimensions of {AXES} with Y and X")
    return order


def split_planes(flat: Column, shape: dict[str, Column], order: str = AXES) -> Column:
    """Planes, in order of t, c, z, of a flat array in axes ``order``; axes that are missing have size 1.

    The array, sizes and strides are bound once, since a plan may write what they
    are made of into every use.  Planes or rows that lie together are slices.
    """
    order = order.upper()
    size = {a: shape[a].cast("int") if a in order else F.lit(1) for a in AXES}
    stride, step = {a: F.lit(0) for a in AXES}, F.lit(1)
    for a in reversed(order):
        stride[a], step = step, step * size[a]
    bound = F.struct(flat.alias("flat"), *(v.alias(f"size_{a}") for a, v in size.items()), *(v.alias(f"stride_{a}") for a, v in stride.items()))

    def split(b: Column) -> Column:
        n = {a: b[f"size_{a}"] for a in AXES}
        by = {a: b[f"stride_{a}"] for a in AXES}

        def row(first: Column) -> Column:
            if order.endswith("X"):
                return F.slice(b["flat"], first + 1, n["X"])
            at = F.when(n["X"] > 0, F.sequence(first, first + (n["X"] - 1) * by["X"], by["X"])).otherwise(F.array().cast("array<int>"))
            return F.transform(at, lambda i: F.get(b["flat"], i))

        def pixels(first: Column) -> Column:
            if order.endswith("YX"):
                return F.slice(b["flat"], first + 1, n["Y"] * n["X"])
            return F.flatten(F.transform(ints(F.lit(0), n["Y"] - 1), lambda y: row(first + y * by["Y"])))

        def plane(k: Column) -> Column:
            z, c, t = k % n["Z"], F.floor(k / n["Z"]).cast("int") % n["C"], F.floor(k / (n["Z"] * n["C"])).cast("int")
            first = t * by["T"] + c * by["C"] + z * by["Z"]
            return F.struct(z.alias("z"), t.alias("t"), c.cast("short").alias("c"), let(first, pixels).cast("array<int>").alias("pixels"))

        return F.transform(ints(F.lit(0), n["T"] * n["C"] * n["Z"] - 1), plane)

    return let(bound, split)


def from_arrays(df: DataFrame, flat: str, shape: dict[str, Column], dim_order: str | None = None, channel_names: Column | None = None, clamp_to_uint16: bool = True, column: str = "image", **fields) -> DataFrame:
    """``df`` with a record for the flat array in each row.

    ``shape`` gives a size for each axis of ``dim_order``.  The array's length
    must be their product.  Values are clamped to 16 bits unless told not to;
    ``fields`` are those of ``schema.image``.  Channel names of another number
    than the channels are replaced by ``C{i}``.
    """
    order = dim_order_of(dim_order, len(shape))
    shape = {a.upper(): v for a, v in shape.items()}
    if set(shape) != set(order):
        raise ValueError(f"sizes are needed for the axes {order}")
    whole = F.lit(1)
    for a in order:
        whole = whole * shape[a].cast("int")
    values = F.col(flat)
    if clamp_to_uint16:
        values = F.transform(values, lambda v: clamp(v, "uint16"))
    values = F.when(F.size(flat) == whole, values).otherwise(F.raise_error(F.lit("an array's length is not the product of its sizes")).cast("array<bigint>"))
    size = {a: shape.get(a, F.lit(1)).cast("int") for a in AXES}
    names = None if channel_names is None else channel_names
    record = schema.image(
        size_x=size["X"],
        size_y=size["Y"],
        size_z=size["Z"],
        size_c=size["C"],
        size_t=size["T"],
        channels=schema.synthetic_channels(size["C"], names),
        planes=split_planes(values, shape, order),
        **fields,
    )
    return df.withColumn(column, record)


def from_numpy(spark: SparkSession, array, dim_order: str | None = None, channel_names: list[str] | None = None, clamp_to_uint16: bool = True, image_id: str | None = None, name: str | None = None, physical_sizes_xyz: tuple[float, float, float] = (1.0, 1.0, 1.0), dtype: str | None = None, acquisition_datetime=None) -> DataFrame:
    """One image from an array of the driver, as a table of one row."""
    import numpy as np

    order = dim_order_of(dim_order, array.ndim)
    row = (array.astype(np.float64).ravel().tolist(),) if array.dtype.kind == "f" else (array.astype(np.int64).ravel().tolist(),)
    df = spark.createDataFrame([row], f"flat array<{'double' if array.dtype.kind == 'f' else 'bigint'}>")
    fields = {f"physical_size_{a}": F.lit(float(v)) for a, v in zip("xyz", physical_sizes_xyz, strict=True)}
    fields |= {"dtype": F.lit(dtype or array.dtype.name), "image_id": F.lit(image_id), "name": F.lit(name)}
    if acquisition_datetime is not None:
        fields["acquisition_datetime"] = F.lit(acquisition_datetime).cast("timestamp_ntz")
    names = F.array(*map(F.lit, channel_names)) if channel_names else None
    shape = {a: F.lit(int(n)) for a, n in zip(order, array.shape, strict=True)}
    return from_arrays(df, "flat", shape, order, names, clamp_to_uint16, **fields).select("image")
