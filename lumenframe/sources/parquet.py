"""Records in Parquet: Spark's own, and files with exact unsigned types and footer tags."""

from __future__ import annotations

import io

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe import schema
from lumenframe.sources import files

#: The record with exact types, as other Arrow tools declare it.
ARROW = pa.struct(
    [
        ("type", pa.string()),
        ("version", pa.string()),
        ("id", pa.string()),
        ("name", pa.string()),
        ("acquisition_datetime", pa.timestamp("us")),
        (
            "pixels_meta",
            pa.struct(
                [
                    ("dimension_order", pa.string()),
                    ("type", pa.string()),
                    ("size_x", pa.int32()),
                    ("size_y", pa.int32()),
                    ("size_z", pa.int32()),
                    ("size_c", pa.int16()),
                    ("size_t", pa.int32()),
                    *((f"physical_size_{a}", pa.float32()) for a in "xyz"),
                    *((f"physical_size_{a}_unit", pa.string()) for a in "xyz"),
                    ("channels", pa.list_(pa.struct([("id", pa.string()), ("name", pa.string()), ("emission_um", pa.float32()), ("excitation_um", pa.float32()), ("illumination", pa.string()), ("color_rgba", pa.uint32())]))),
                ]
            ),
        ),
        ("planes", pa.list_(pa.struct([("z", pa.int32()), ("t", pa.int32()), ("c", pa.int16()), ("pixels", pa.list_(pa.uint16()))]))),
        ("masks", pa.null()),
    ]
)


def record_column(df: DataFrame, column: str | None = None, strict: bool = False) -> str:
    """The named column if it can hold records, else the first that can.  ``strict``: the name must be right and the types exact."""
    if column is not None and column in df.columns:
        if schema.is_record_type(df.schema[column].dataType, strict):
            return column
        if strict:
            raise ValueError(f"column {column} is not of the record's type")
    elif column is not None and strict:
        raise ValueError(f"no column {column}")
    found = next((f.name for f in df.schema.fields if schema.is_record_type(f.dataType, strict)), None)
    if found is None:
        raise ValueError("no column holds image records")
    return found


def read_parquet(spark: SparkSession, path: str | list[str], column: str | None = "image", strict_schema: bool = False, row_index: int | None = None) -> DataFrame:
    """Records of Parquet files, all other columns with them; the record's column is named ``image``.

    ``row_index`` picks one row by its place in its file (a file only: Spark has
    no order across files); out of range raises.
    """
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    found = record_column(df, column, strict_schema)
    if row_index is not None:
        df = df.where(F.col("_metadata.row_index") == row_index)
        if row_index < 0 or not df.select(F.lit(1)).take(1):
            raise IndexError(f"no row {row_index} in {path}")
    if found != "image":
        df = df.drop("image").withColumnRenamed(found, "image")
    return schema.canonical(df, "image")


def write_parquet(df: DataFrame, out: str, column: str = "image", column_name: str | None = None, compression: str = "zstd", mode: str = "error", partition_by: list[str] | None = None) -> None:
    """Spark's writer: the engine's own form, any number of rows."""
    rows = df.withColumnRenamed(column, column_name) if column_name else df
    writer = rows.write.mode(mode).option("compression", compression or "none")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(out)


def write_interop(df: DataFrame, out: str, column: str = "image", column_name: str = "image", file_metadata: dict[str, str] | None = None, compression: str | None = "zstd", row_group_size: int | None = None, file_name=None) -> int:
    """A file for each record, ``{id}.parquet`` under ``out`` unless named, with exact types and tags in its footer.  Pixels out of range raise."""
    tags = {"image.type": schema.TYPE_TAG, "image.version": schema.VERSION_TAG} | {str(k): str(v) for k, v in (file_metadata or {}).items()}
    name = file_name if file_name is not None else F.concat(F.col(f"{column}.id"), F.lit(".parquet"))
    rows = schema.canonical(df, column).select(name.alias("file"), F.col(column).alias("record"))

    def one(row: dict):
        table = pa.table({column_name: pa.array([row["record"]], ARROW)}).replace_schema_metadata(tags)
        sink = io.BytesIO()
        pq.write_table(table, sink, compression=compression or "none", row_group_size=row_group_size)
        yield files.safe_name(row["file"]), sink.getvalue()

    return files.written(rows, one, out)


def read_tags(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, key, value): the tags in the footers of Parquet files, but for those of Arrow and Spark themselves."""
    files.prepare(spark)

    def run(batches):
        for batch in batches:
            for place, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = pq.read_metadata(pa.BufferReader(content.as_buffer())).metadata or {}
                own = {k.decode(): v.decode() for k, v in found.items() if not k.startswith((b"ARROW:", b"org.apache."))}
                yield pa.RecordBatch.from_arrays([pa.array([place] * len(own), pa.string()), pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.string())], names=["path", "key", "value"])

    return files.listing(spark, path, "*.parquet").select("path", "content").mapInArrow(run, "path string, key string, value string")
