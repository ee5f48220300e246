"""``read`` and ``write``: one entry to all sources and sinks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe import view as _view
from lumenframe.operators import dense, slicing
from lumenframe.operators import describe as _describe
from lumenframe.schema import IMAGE, canonical
from lumenframe.sources import arrays, files, parquet, tiff, zarr

#: Sinks by name; ``_``, ``-`` and case do not matter.
SINKS = {"ometiff": tiff.write_tiff, "omezarr": zarr.write_zarr, "parquet": parquet.write_parquet, "omeparquet": parquet.write_interop}


def read(spark: SparkSession, source, **options) -> DataFrame:
    """A table with the column ``image`` from a path, a file pattern, an array, a record (a dict or an Arrow struct) or a DataFrame.

    Paths: ``<``, ``>`` or ``*`` in the file name make it a stack pattern (a
    regular expression without brackets), then ``.zarr``, ``.parquet`` and
    ``.tif``/``.tiff`` tell the source.
    """
    if isinstance(source, DataFrame):
        return canonical(source.withColumnRenamed(parquet.record_column(source), "image"))
    if isinstance(source, pa.StructScalar):
        source = source.as_py()
    if isinstance(source, dict):
        return canonical(spark.createDataFrame([(source,)], _loose(source)))
    if hasattr(source, "ndim") and hasattr(source, "dtype"):
        return arrays.from_numpy(spark, source, **options)
    if not isinstance(source, str):
        raise TypeError(f"cannot read an image from {type(source).__name__}")
    path = source.strip()
    folder, _, name = path.rpartition("/")
    if any(c in name for c in "<>*"):
        return tiff.read_stack(spark, folder or ".", name, **options)
    kind = path.rstrip("/").lower()
    if kind.endswith(".zarr"):
        return zarr.read_zarr(spark, path, **options)
    if kind.endswith((".parquet", ".pq")):
        return parquet.read_parquet(spark, path, **options)
    if kind.endswith((".tif", ".tiff")):
        return tiff.read_tiff(spark, path, **options)
    raise TypeError(f"cannot tell the kind of {source}")


def _loose(record: dict):
    return T.StructType([T.StructField("image", T.StructType([f for f in IMAGE.fields if f.name in record]))])


def write(df: DataFrame, how: str, out: str | None = None, **options):
    """``rows`` collects records as dicts, ``numpy`` as dense arrays in TCZYX (small tables only), ``arrow`` gives an Arrow table; the others write under ``out``."""
    if how == "rows":
        return [r["image"].asDict(recursive=True) for r in df.select("image").collect()]
    if how == "numpy":
        return to_numpy(df, **options)
    if how == "arrow":
        return df.toArrow()
    sink = SINKS.get(how.lower().replace("-", "").replace("_", ""))
    if sink is None:
        raise ValueError(f"unknown sink {how}")
    if out is None:
        raise ValueError(f"{how} needs out")
    return sink(df, out, **options)


def to_numpy(df: DataFrame, dtype: str = "uint16", strict: bool = True, clamp: bool = False) -> list[np.ndarray]:
    """Dense arrays (t, c, z, y, x) of the records of a small table, in its order."""
    meta = F.col("image.pixels_meta")
    rows = df.select(dense.dense(F.col("image"), dtype, strict, clamp)["pixels"].alias("planes"), F.array(*(meta[f"size_{a}"].cast("int") for a in "tczyx")).alias("shape")).collect()
    return [np.array(r["planes"]).astype(dtype).reshape(r["shape"]) for r in rows]


def info(df: DataFrame, key: str | None = None) -> DataFrame:
    """What each record is; only headers are read.

    Of Parquet these are the header's leaves.  Of a table that comes right from
    ``read`` of TIFF files, a stack or Zarr they are read anew, without decoding
    pixels; once such a table is changed, its pixels are decoded for the change.
    """
    df = files.headers_of(df)
    if key is None:
        df, key = df.withColumn("image_id", df["image.id"]), "image_id"
    return _describe.describe(df, "image", key)


def crop(df: DataFrame, x_min: int, x_max: int, y_min: int, y_max: int, **selection) -> DataFrame:
    return slicing.slice_images(df, x_min, x_max, y_min, y_max, **selection)


#: What ``view`` knows, by name.
VIEWS = {"plane": _view.plane, "volume": _view.volume, "png": _view.snapshot, "html": _view.summary_html}


def view(df: DataFrame, how: str = "plane", **options):
    """A viewer's data of the first record: ``plane``, ``volume`` or ``png``; ``html`` summarises records."""
    if how not in VIEWS:
        raise ValueError(f"unknown view {how}")
    return VIEWS[how](df, **options)
