"""Shared storage, Arrow plumbing and connected components for the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.session import prepare, released, shared_folder, stored

__all__ = ["components", "map_arrow", "prepare", "released", "shared_folder", "stored"]


def map_arrow(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` with a function of one batch; empty batches pass no rows."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := function(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def with_text_columns(docs: DataFrame, text: str, function: Callable[[pa.Array], list[pa.Array]], fields: list[T.StructField]) -> DataFrame:
    """``docs`` with new columns that ``function`` makes of a batch of the column ``text``.

    Other columns ride along in one struct, so they may have any names; old ones
    of the new names are replaced.  No shuffle.
    """
    new = {f.name.lower() for f in fields}
    kept = [c for c in docs.columns if c.lower() not in new or c == text]
    others = [c for c in kept if c != text]
    rest = F.struct(*(F.col(f"`{c}`") for c in others)) if others else F.lit(None).cast("struct<none:int>")
    packed = docs.select(rest.alias("rest"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([*packed.schema.fields, *(T.StructField(f"new_{i}", f.dataType) for i, f in enumerate(fields))])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, *function(batch.column(1))], names=schema.names)

    out = map_arrow(packed, run, schema)
    old = {c: F.col("text") if c == text else F.col("rest").getField(c) for c in kept}
    return out.select(*(v.alias(c) for c, v in old.items()), *(F.col(f"new_{i}").alias(f.name) for i, f in enumerate(fields)))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b) as (node, component): the smallest node reachable.

    Each round points every node at its smallest neighbour, follows the
    pointers to their ends and contracts the edges.  Only local minima are
    ends, so at least half of the nodes of each component go in a round, and
    following doubles the reach of all pointers at once.  Every aggregation
    pre-aggregates before its shuffle, and hubs appear only on the many-row
    side of joins against tables with one row a node, which Spark's skew join
    splits.  Null ends and loops are ignored.
    """
    edges = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    edges = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    for _ in range(most_rounds):
        if not edges.take(1):
            break
        parent = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("to")))
        parent = stored(parent.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("to")))
        for _ in range(most_rounds):
            up = parent.select(F.col("node").alias("to"), F.col("to").alias("top"))
            followed = stored(parent.join(up, "to", "left").select("node", "to", F.coalesce("top", "to").alias("top")))
            parent = followed.select("node", F.col("top").alias("to"))
            if not followed.where("top <> to").take(1):
                break
        up = parent.select(F.col("node").alias("component"), F.col("to").alias("top"))
        labels = parent.select("node", F.col("to").alias("component")) if labels is None else labels.join(up, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
        labels = stored(labels)
        for end in ("a", "b"):
            edges = edges.join(parent.select(F.col("node").alias(end), F.col("to").alias("to")), end).drop(end).withColumnRenamed("to", end)
        edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    if labels is None:
        labels = edges.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    return labels
