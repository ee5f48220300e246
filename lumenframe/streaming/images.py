"""New image files as a stream of planes."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.sources import files, tiff


#: Bytes of files in a micro-batch: each costs a commit of every state partition, however few files it has.
BATCH = 256 << 20
_LISTING, _OPENING = "spark.sql.sources.parallelPartitionDiscovery.parallelism", "spark.sql.files.openCostInBytes"


def stream_planes(spark: SparkSession, folder: str, glob: str = "*.tif*", clamp_to_uint16: bool = True, files_per_trigger: int | None = None) -> DataFrame:
    """Pages of TIFF files as they arrive in ``folder``: path, place, pixels and what the file says; ``modified`` is event time.

    A micro-batch takes files of ``BATCH`` bytes, or with ``files_per_trigger`` that many files.
    """
    files.prepare(spark)
    schema = spark.read.format("binaryFile").load(folder).schema
    bound = ("maxBytesPerTrigger", BATCH) if files_per_trigger is None else ("maxFilesPerTrigger", files_per_trigger)
    stream = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option(*bound).load(folder)
    return stream.select("path", "content").mapInArrow(lambda batches: tiff._decode(batches, clamp_to_uint16, True), tiff._READ)


@contextmanager
def many_files(spark: SparkSession) -> Iterator[None]:
    """A stream that runs within lists and reads many small files in a task; the session's settings are as before afterwards.

    Spark would list each file of a micro-batch in a task of its own, and read
    four of them in a task where a partition is 16 MB.  It asks the session
    that the stream was defined in, at each micro-batch.
    """
    own = {_LISTING: str(4 * spark.sparkContext.defaultParallelism), _OPENING: str(64 << 10)}
    old = {key: spark.conf.get(key) for key in own}
    for key, value in own.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)


def first_planes(planes: DataFrame) -> DataFrame:
    """Each (path, t, c, z) once."""
    return planes.dropDuplicates(["path", "t", "c", "z"])


def brightness(planes: DataFrame) -> DataFrame:
    """Running sums by channel: pixels and their total."""
    rows = planes.select("c", F.size("pixels").cast("long").alias("n"), F.aggregate("pixels", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))
    return rows.groupBy("c").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
