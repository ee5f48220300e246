"""The image record: schema, construction, canonical form and checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe import __version__

#: Tags that new records carry; what a record says is never enforced.
TYPE_TAG = "lumenframe.image"
VERSION_TAG = __version__

CHANNEL = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("emission_um", T.FloatType()),
        T.StructField("excitation_um", T.FloatType()),
        T.StructField("illumination", T.StringType()),
        T.StructField("color_rgba", T.LongType()),  # packed 0xRRGGBBAA
    ]
)
PLANE = T.StructType(
    [
        T.StructField("z", T.IntegerType()),
        T.StructField("t", T.IntegerType()),
        T.StructField("c", T.ShortType()),
        T.StructField("pixels", T.ArrayType(T.IntegerType())),  # row-major, 0..65535
    ]
)
PIXELS_META = T.StructType(
    [
        T.StructField("dimension_order", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("size_x", T.IntegerType()),
        T.StructField("size_y", T.IntegerType()),
        T.StructField("size_z", T.IntegerType()),
        T.StructField("size_c", T.ShortType()),
        T.StructField("size_t", T.IntegerType()),
        T.StructField("physical_size_x", T.FloatType()),
        T.StructField("physical_size_y", T.FloatType()),
        T.StructField("physical_size_z", T.FloatType()),
        T.StructField("physical_size_x_unit", T.StringType()),
        T.StructField("physical_size_y_unit", T.StringType()),
        T.StructField("physical_size_z_unit", T.StringType()),
        T.StructField("channels", T.ArrayType(CHANNEL)),
    ]
)
IMAGE = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("acquisition_datetime", T.TimestampNTZType()),
        T.StructField("pixels_meta", PIXELS_META),
        T.StructField("planes", T.ArrayType(PLANE)),
    ]
)
#: Fixed defaults of a channel and of sizes.
DEFAULT_COLOR = 0xFFFFFFFF
DEFAULT_UNIT = "µm"
MOST_PIXEL = 65535


def now_utc() -> Column:
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.localtimestamp())


def dimension_order(size_z: Column) -> Column:
    """The hint that a record of this depth carries."""
    return F.when(size_z == 1, "XYCT").otherwise("XYZCT")


def channel(channel_id: Column, name: Column) -> Column:
    """A channel with nothing known but its names."""
    return F.struct(channel_id.cast("string").alias("id"), name.cast("string").alias("name"), F.lit(0.0).cast("float").alias("emission_um"), F.lit(0.0).cast("float").alias("excitation_um"), F.lit("Unknown").alias("illumination"), F.lit(DEFAULT_COLOR).cast("long").alias("color_rgba"))


def synthetic_channels(size_c: Column, names: Column | None = None) -> Column:
    """``ch-{i}`` for each channel, named by ``names`` if they are as many, else ``C{i}``."""
    at = F.when(size_c > 0, F.sequence(F.lit(0), size_c.cast("int") - 1)).otherwise(F.array().cast("array<int>"))

    def one(i: Column) -> Column:
        plain = F.concat(F.lit("C"), i.cast("string"))
        name = plain if names is None else F.when(F.size(names) == size_c, F.coalesce(F.get(names, i), plain)).otherwise(plain)
        return channel(F.concat(F.lit("ch-"), i.cast("string")), name)

    return F.transform(at, one)


def zero_pixels(n: Column) -> Column:
    return F.array_repeat(F.lit(0), n.cast("int"))


def image(
    *,
    image_id: Column | None = None,
    name: Column | None = None,
    acquisition_datetime: Column | None = None,
    dtype: Column | None = None,
    order: Column | None = None,
    size_x: Column | None = None,
    size_y: Column | None = None,
    size_z: Column | None = None,
    size_c: Column | None = None,
    size_t: Column | None = None,
    physical_size_x: Column | None = None,
    physical_size_y: Column | None = None,
    physical_size_z: Column | None = None,
    physical_size_unit: Column | None = None,
    channels: Column | None = None,
    planes: Column | None = None,
    type_tag: Column | None = None,
    version: Column | None = None,
    clock: Column | None = None,
) -> Column:
    """One record from what is given; nulls and what is left out take defaults.

    Without channels there is one, ``ch-0``/``default``; ids, names and
    illuminations of given ones become text.  Without planes there is a single
    zero plane at (0, 0, 0).  One unit serves x, y and z.  ``clock``
    replaces the current UTC time as the default of the acquisition time.
    """

    def given(value: Column | None, default: Column) -> Column:
        return default if value is None else F.coalesce(value, default)

    def texts(ch: Column) -> Column:
        for f in ("id", "name", "illumination"):
            ch = ch.withField(f, ch[f].cast("string"))
        return ch

    one = F.lit(1)
    sx, sy, sz, sc, st = (given(v, one) for v in (size_x, size_y, size_z, size_c, size_t))
    unit = given(physical_size_unit, F.lit(DEFAULT_UNIT))
    plain = F.array(channel(F.lit("ch-0"), F.lit("default")))
    empty = F.array(F.struct(F.lit(0).alias("z"), F.lit(0).alias("t"), F.lit(0).cast("short").alias("c"), zero_pixels(sx * sy).alias("pixels")))
    meta = F.struct(
        given(order, dimension_order(sz)).alias("dimension_order"),
        given(dtype, F.lit("uint16")).alias("type"),
        sx.cast("int").alias("size_x"),
        sy.cast("int").alias("size_y"),
        sz.cast("int").alias("size_z"),
        sc.cast("short").alias("size_c"),
        st.cast("int").alias("size_t"),
        *(given(v, F.lit(1.0)).cast("float").alias(f"physical_size_{a}") for a, v in zip("xyz", (physical_size_x, physical_size_y, physical_size_z), strict=True)),
        *(unit.alias(f"physical_size_{a}_unit") for a in "xyz"),
        (plain if channels is None else F.coalesce(F.transform(channels, texts), plain)).alias("channels"),
    )
    return F.struct(
        given(type_tag, F.lit(TYPE_TAG)).alias("type"),
        given(version, F.lit(VERSION_TAG)).alias("version"),
        given(image_id, F.lit("unknown")).cast("string").alias("id"),
        given(name, F.lit("unknown")).cast("string").alias("name"),
        given(acquisition_datetime, now_utc() if clock is None else clock).cast("timestamp_ntz").alias("acquisition_datetime"),
        meta.alias("pixels_meta"),
        (empty if planes is None else F.coalesce(planes, empty)).alias("planes"),
    )


_KINDS = (T.NumericType, T.StringType, (T.TimestampType, T.TimestampNTZType, T.DateType))


def _related(have: T.DataType, want: T.DataType) -> bool:
    """Whether values of one plain type can become the other's: numbers, texts or times."""
    return isinstance(have, T.NullType) or any(isinstance(have, k) and isinstance(want, k) for k in _KINDS)


def _holds(value: Column, have: T.DataType, want: T.DataType) -> Column | None:
    """Whether a value of a fitting type has nothing that is out of range for ``want``; None if it never has."""
    if have == want:
        return None
    if isinstance(want, T.StructType):
        own = {f.name: f.dataType for f in have.fields}
        parts = [ok for f in want.fields if f.name in own and (ok := _holds(value.getField(f.name), own[f.name], f.dataType)) is not None]
        return reduce(lambda a, b: a & b, parts, value.isNull() | F.lit(True)) if parts else None
    if isinstance(want, T.ArrayType):
        if _holds(F.lit(None), have.elementType, want.elementType) is None:
            return None
        return F.coalesce(F.forall(value, lambda x: F.coalesce(_holds(x, have.elementType, want.elementType), F.lit(True))), F.lit(True))
    return value.isNull() | value.try_cast(want).isNotNull()


def _fit(value: Column, have: T.DataType, want: T.DataType) -> Column:
    """``value`` with the fields of ``want`` by name: extra ones go, missing ones are null."""
    if isinstance(want, T.StructType):
        if not isinstance(have, T.StructType):
            raise TypeError(f"a struct is needed, not {have.simpleString()}")
        own = {f.name: f.dataType for f in have.fields}
        fields = [(_fit(value.getField(f.name), own[f.name], f.dataType) if f.name in own else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(want, T.ArrayType):
        if not isinstance(have, T.ArrayType):
            raise TypeError(f"an array is needed, not {have.simpleString()}")
        if isinstance(want.elementType, T.StructType):
            return F.transform(value, lambda x: _fit(x, have.elementType, want.elementType))
        if not _related(have.elementType, want.elementType):
            raise TypeError(f"{want.simpleString()} is needed, not {have.simpleString()}")
        return value.cast(want)
    if not _related(have, want):
        raise TypeError(f"{want.simpleString()} is needed, not {have.simpleString()}")
    return value.cast(want)


def canonical(df: DataFrame, column: str = "image") -> DataFrame:
    """``df`` with its record column in the schema IMAGE; raises TypeError where types cannot fit."""
    return df.withColumn(column, _fit(F.col(column), df.schema[column].dataType, IMAGE).cast(IMAGE))


def is_record_type(kind: T.DataType, strict: bool = False) -> bool:
    """Whether a column can hold records: the same field names (``masks`` may be there or not), or with ``strict`` the exact types."""
    if not isinstance(kind, T.StructType):
        return False
    if strict:
        return T.StructType([f for f in kind.fields if f.name != "masks"]).simpleString() == IMAGE.simpleString()
    return set(kind.names) - {"masks"} == set(IMAGE.names)


def pixels_in_range(planes: Column) -> Column:
    """Whether every pixel is an unsigned 16-bit value; true without planes."""
    return F.coalesce(F.forall(planes, lambda p: F.coalesce(F.forall(p["pixels"], lambda v: v.isNull() | v.between(0, MOST_PIXEL)), F.lit(True))), F.lit(True))


def verified(df: DataFrame, column: str = "image") -> Column:
    """Whether each row's value is a valid record.  Never raises.

    A column that cannot hold records, by its names or by the type of any field,
    is false throughout; a number that its field cannot hold, a pixel that is
    not an unsigned 16-bit value, or masks make a row false.  Null is valid.
    """
    if column not in df.columns:
        return F.lit(False)
    kind, value = df.schema[column].dataType, F.col(f"`{column}`")
    if not is_record_type(kind):
        return F.lit(False)
    try:
        _fit(value, kind, IMAGE)
    except TypeError:
        return F.lit(False)
    ok = pixels_in_range(value["planes"])
    if (fits := _holds(value, kind, IMAGE)) is not None:
        ok = ok & fits
    if "masks" in kind.names:
        ok = ok & value["masks"].isNull()
    return F.when(value.isNull(), F.lit(True)).otherwise(ok)


def problems(image: Column) -> Column:
    """Names of the integrity checks that a record fails: sizes, plane lengths, plane indices, duplicates, channels, pixel range, tag."""
    meta, planes = image["pixels_meta"], F.coalesce(image["planes"], F.array().cast(T.ArrayType(PLANE)))
    place = F.transform(planes, lambda p: F.struct(p["t"], p["c"], p["z"]))
    inside = F.forall(planes, lambda p: p["t"].between(0, meta["size_t"] - 1) & p["c"].between(0, meta["size_c"] - 1) & p["z"].between(0, meta["size_z"] - 1))
    checks = {
        "sizes": (meta["size_x"] > 0) & (meta["size_y"] > 0) & (meta["size_z"] > 0) & (meta["size_c"] > 0) & (meta["size_t"] > 0),
        "plane_length": F.forall(planes, lambda p: F.size(p["pixels"]) == meta["size_x"] * meta["size_y"]),
        "plane_index": inside,
        "duplicate_planes": F.size(F.array_distinct(place)) == F.size(place),
        "channels": F.size(meta["channels"]) == meta["size_c"],
        "pixel_range": pixels_in_range(planes),
    }
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items())))
