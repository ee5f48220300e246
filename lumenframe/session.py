"""What an operator needs of the session: shared storage, bounded Arrow batches, and workers that find this package."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch sent to a Python worker, the same for all plans: texts and images can be long.
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20
_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
#: Spark's setting that removes a finished execution's shuffle files.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def reach(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches, one bound for every plan of the session, and let workers find this package.

    Spark reads the bound when a plan runs, not when it is defined.  All
    operators use the same one, so that the order of definition does not
    matter.  A stricter bound that the session has is kept.
    """
    for key, most in _LIMITS.items():
        now = spark.conf.get(key, None) or ""
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))
    reach(spark)


def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of batches as dicts, one at a time: a row may be a whole image."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def shared_folder(spark: SparkSession) -> str:
    """A new path under ``spark.checkpoint.dir``; a temporary folder only where that is unset and all workers are on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="lumenframe-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Executions within leave no shuffle files behind."""
    old = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, old)


def stored(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors.

    Spark removes the shuffle files of the write when it is done.  The result
    can serve a returned, lazy DataFrame; it stays until ``released`` or until
    the folder that ``spark.checkpoint.dir`` names is cleaned.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_stored_at"] = path
    return out


def numbered(rows: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """``rows`` with their places, from 0, in the order of columns.

    Rows are range-partitioned and sorted; a place is that in its partition plus
    the rows of the partitions before.  Only a row for each partition is
    gathered.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = stored(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()))
    runs = ranged.groupBy(F.shiftright("_place", 33).alias("_part")).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    joined = ranged.withColumn("_part", F.shiftright("_place", 33)).join(F.broadcast(runs), "_part")
    return joined.withColumn(name, F.col("_place") + F.col("_shift")).drop("_place", "_part", "_shift")


def _path_of(df: DataFrame) -> str | None:
    return df.__dict__.get("_stored_at")


def released(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete stored tables that nothing will read again: all that was derived from them is itself stored."""
    jvm = spark.sparkContext._jvm
    for df in frames:
        if path := _path_of(df):
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
