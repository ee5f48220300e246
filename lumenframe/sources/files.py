"""Files of images in any store: reading through Spark, writing from tasks.

Reading is Spark's ``binaryFile``, so every store that Spark reads will do.
Writing one file per image is done by tasks through ``pyarrow.fs``; a file
appears under its name only when it is whole, so a task that runs twice does no
harm.  The target must be a store that all executors see.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.fs  # noqa: F401  (pa.fs)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions.pixels import file_name, stem
from lumenframe.session import BATCH_ROWS, one_by_one, prepare, shuffles_removed


def store_of(path: str):
    """The store of a path or URI, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return pa.fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return pa.fs.LocalFileSystem(), path


def put(store, path: str, data: bytes) -> None:
    """Write a file whole or not at all; an older one is replaced."""
    folder = path.rpartition("/")[0]
    part = f"{folder}/.{uuid.uuid4().hex}.part"
    try:
        out = store.open_output_stream(part, compression=None)
    except FileNotFoundError:
        store.create_dir(folder, recursive=True)
        out = store.open_output_stream(part, compression=None)
    with out:
        out.write(data)
    store.move(part, path)


def listing(spark: SparkSession, paths: str | list[str], glob: str | None = None, recursive: bool = False) -> DataFrame:
    """(path, name, stem, folder, length, content) of files; ``content`` is read only if selected."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    path = F.col("path")
    return reader.load(paths).select("path", file_name(path).alias("name"), stem(path).alias("stem"), F.regexp_extract(path, r"^(.*)/", 1).alias("folder"), "length", "content")


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt over tasks (by columns): few partitions of a table can be very many small files."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *by)


def _ignored(name: str) -> bool:
    """Names that Spark's readers leave out."""
    return name.endswith("._COPYING_") or name.startswith(".") or (name.startswith("_") and "=" not in name and not name.startswith(("_metadata", "_common_metadata")))


def root_of(spark: SparkSession, folder: str) -> tuple[str, str] | None:
    """A folder as Spark writes its path, and its path in its store; None where only Spark's readers reach it."""
    if any(c in folder for c in "*?[]{}%\\"):
        return None
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toString().rstrip("/")
    try:
        store, root = _store(whole)
        return (whole, root.rstrip("/")) if store.get_file_info(root).type == pa.fs.FileType.Directory else None
    except (OSError, ValueError, NotImplementedError):
        return None


def _store(whole: str):
    return (pa.fs.LocalFileSystem(), whole.removeprefix("file:")) if whole.startswith("file:/") else store_of(whole)


def walked(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, folder) of the files at or below ``folder``.

    One task lists the folder itself, others what lies below its folders, so
    the driver holds no list and no task has a single small folder.  Where only
    Spark's readers reach the store they list it.
    """
    prepare(spark)
    found = root_of(spark, folder)
    if found is None:
        return listing(spark, folder, recursive=True).select("path", "name", "folder")
    whole, root = found

    def inside(store, path: str) -> list:
        return [i for i in store.get_file_info(pa.fs.FileSelector(path)) if not _ignored(i.base_name)]

    def packed(rows: Iterator[tuple[str, bool]]) -> Iterator[pa.RecordBatch]:
        while part := list(islice(rows, BATCH_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array([whole + p[len(root) :] for p, _ in part], pa.string()), pa.array([d for _, d in part], pa.bool_())], names=["path", "deep"])

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from packed((i.path, i.type == pa.fs.FileType.Directory) for i in inside(_store(whole)[0], root))

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = _store(whole)[0]

        def names() -> Iterator[tuple[str, bool]]:
            for batch in batches:
                for path, deep in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    place = root + path[len(whole) :]
                    if not deep:
                        yield place, False
                    left = [place] if deep else []
                    while left:
                        for i in inside(store, left.pop()):
                            if i.type == pa.fs.FileType.Directory:
                                left.append(i.path)
                            else:
                                yield i.path, False

        return packed(names())

    kinds, path = "path string, deep boolean", F.col("path")
    rows = spread(spark.range(0, 1, 1, 1).mapInArrow(top, kinds)).mapInArrow(below, kinds)
    return rows.select("path", file_name(path).alias("name"), F.regexp_extract(path, r"^(.*)/", 1).alias("folder"))


def loader(root: tuple[str, str]) -> Callable[[str], bytes]:
    """What reads a file below a root in a task, by its path as Spark writes it."""
    whole, inner = root
    store = _store(whole)[0]

    def load(path: str) -> bytes:
        with store.open_input_file(inner + path[len(whole) :]) as f:
            return f.read()

    return load


def written(df: DataFrame, one: Callable[[dict], Iterator[tuple[str, bytes]]], out: str) -> int:
    """Write the files that ``one`` makes of each row, named relative to ``out``; returns their number."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(out)
        n = 0
        for row in one_by_one(batches):
            for name, data in one(row):
                put(store, f"{root.rstrip('/')}/{name}", data)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["files"])

    with shuffles_removed(df.sparkSession):
        return df.mapInArrow(run, "files long").agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]


def safe_name(text: str) -> str:
    """A file name from an id: separators and control characters are percent-encoded."""
    return "".join(c if c.isalnum() or c in "._- " else "".join(f"%{b:02X}" for b in c.encode()) for c in text) or "_"


def with_headers(df: DataFrame, make: Callable[[], DataFrame]) -> DataFrame:
    """``df``, read from files, and how to read the same records without their pixels."""
    df.__dict__["_headers"] = make
    return df


def headers_of(df: DataFrame) -> DataFrame:
    """The records of a table without their pixels if it comes right from files, else the table itself."""
    make = df.__dict__.get("_headers")
    return df if make is None else make()
