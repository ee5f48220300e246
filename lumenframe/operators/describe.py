"""What a record is, and the contrast limits of its pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kind(meta: Column) -> Column:
    """Class by the numbers of times and depths."""
    t, z = meta["size_t"], meta["size_z"]
    return F.when((t == 1) & (z == 1), "2D image").when((t == 1) & (z > 1), "3D image (z-stack)").when((t > 1) & (z == 1), "movie / timelapse").when((t > 1) & (z > 1), "4D timelapse-volume").otherwise("unknown")


def summary(meta: Column) -> Column:
    c = meta["size_c"].cast("int")
    channels = F.when(c > 1, F.concat(F.lit("multi-channel ("), c.cast("string"), F.lit(" channels)"))).otherwise("single-channel")
    shape = F.concat(*(p for a in "TCZYX" for p in (F.lit(f"{a}="), meta[f"size_{a.lower()}"].cast("string"), F.lit(", " if a != "X" else ""))))
    return F.concat(kind(meta), F.lit(", "), channels, F.lit(" - shape ("), shape, F.lit(")"))


def describe(df: DataFrame, column: str = "image", key: str = "image_id") -> DataFrame:
    """key, sizes, kind, channels, is_multichannel, summary.  Only header leaves are read."""
    meta = F.col(f"{column}.pixels_meta") if f"{column}" in df.columns else F.col("pixels_meta")
    return df.select(key, *(meta[f"size_{a}"].cast("int").alias(f"size_{a}") for a in "tczyx"), kind(meta).alias("kind"), meta["size_c"].cast("int").alias("channels"), (meta["size_c"] > 1).alias("is_multichannel"), summary(meta).alias("summary"))


def limits(pixels: Column, vmin: float | None = None, vmax: float | None = None) -> Column:
    """Display range of a plane: its least and greatest pixel unless given; never empty."""
    low = F.array_min(pixels).cast("double") if vmin is None else F.lit(float(vmin))
    high = F.array_max(pixels).cast("double") if vmax is None else F.lit(float(vmax))
    return F.struct(low.alias("vmin"), F.when(low == high, low + 1).otherwise(high).alias("vmax"))


def percentile_limits(pixels: DataFrame, by: list[str], low: float = 1.0, high: float = 99.9, value: str = "value", exact: bool = True) -> DataFrame:
    """Percentiles of the long form by group, linearly interpolated; an empty range is widened by 1.

    The exact form keeps a count per distinct value of a group, at most 65,536
    for 16-bit pixels, and is aggregated before the shuffle.
    """
    rank = F.array(F.lit(low / 100), F.lit(high / 100))
    both = F.percentile(value, rank) if exact else F.percentile_approx(value, rank).cast("array<double>")
    out = pixels.groupBy(*by).agg(both.alias("both"))
    lo, hi = F.get("both", F.lit(0)), F.get("both", F.lit(1))
    return out.select(*by, lo.alias("clim_low"), F.when(hi <= lo, lo + 1).otherwise(hi).alias("clim_high"))
