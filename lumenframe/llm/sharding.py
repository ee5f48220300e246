"""Shards of near equal bytes by a k-d tree over document metadata.

Documents with equal texts form a group that is never split.  Groups are points
in metadata space (first id, bytes, language, source); a node of the tree is cut
at the distributed weighted median along its widest dimension until a leaf
carries its target of bytes.  All nodes of a level are cut together: groups are
range-partitioned by node and coordinate, and a group's place among its node's
bytes is the sum of the partitions before it and of the rows before it in its
own.  Nodes, spans and cuts are tables; the driver sees a few numbers however
many groups or leaves there are.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.shared import prepare, released, stored

DIMENSIONS = ("d_id", "d_bytes", "d_lang", "d_source")


def _groups(docs: DataFrame) -> DataFrame:
    """One row per distinct text (null is the empty text) with its weight and its point in metadata space."""
    name = lambda c: F.xxhash64(F.coalesce(F.col(c), F.lit(""))).cast("double")
    return docs.groupBy("text_key").agg(F.sum("size").alias("weight"), F.min(F.col("doc_id").cast("double")).alias("d_id"), F.min(F.col("size").cast("double")).alias("d_bytes"), F.min(name("lang")).alias("d_lang"), F.min(name("source")).alias("d_source")).select("text_key", "weight", *(F.coalesce(d, F.lit(0.0)).alias(d) for d in DIMENSIONS))


def _placed(rows: DataFrame, order: tuple[str, ...], by: str, weight: Column) -> DataFrame:
    """``rows`` with ``below``: the weight of the rows of the same ``by`` that come before in ``order``, which starts with ``by``.

    Rows are range-partitioned and sorted.  A window sums within a partition's
    run of one ``by``, another over the runs of a ``by``: one row for each
    partition that it spans.  No window holds more than a partition.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.withColumn("own_weight", weight).repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    ranged = stored(ranged.withColumn("part", F.shiftright("place", 33)))
    runs = ranged.groupBy(by, "part").agg(F.sum("own_weight").alias("run"))
    earlier = Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(by, "part", F.coalesce(F.sum("run").over(earlier), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy(by, "part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    found = ranged.withColumn("within", F.coalesce(F.sum("own_weight").over(inside), F.lit(0)))
    return found.join(runs, [by, "part"]).withColumn("below", F.col("earlier") + F.col("within")).drop("own_weight", "place", "part", "within", "earlier")


def _alone(groups: DataFrame, shards: int, total: int) -> DataFrame:
    """(text_key, alone) of groups heavier than an equal share of what heavier ones leave: each gets a shard, the last first.

    At most ``shards`` groups are looked at; one window goes over them.
    """
    order = Window.orderBy(F.desc("weight"), "text_key")
    top = groups.orderBy(F.desc("weight"), "text_key").limit(shards).select("text_key", "weight")
    before = F.coalesce(F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.lit(shards + 1) - F.row_number().over(order)
    top = top.select("text_key", "weight", left.alias("left"), (F.lit(total) - before).alias("rest"))
    heavy = ((F.col("left") > 1) & (F.col("weight") * F.col("left") > F.col("rest"))).cast("int")
    top = top.withColumn("alone", F.min(heavy).over(Window.orderBy(F.desc("left")).rowsBetween(Window.unboundedPreceding, 0)))
    return top.where("alone = 1").select("text_key", (F.col("left") - 1).cast("int").alias("alone"))


def _cut(groups: DataFrame, whole: dict[str, float]) -> DataFrame:
    """One level: every node of several shards is cut in two; ``groups`` has node (its first shard) and shards."""
    open_groups = groups.where("shards > 1")
    spans = open_groups.groupBy("node").agg(F.sum("weight").alias("total"), *((F.max(d) - F.min(d)).alias(f"span_{d}") for d in DIMENSIONS))
    wide = F.array(*(F.col(f"span_{d}") / F.lit(whole[d]) for d in DIMENSIONS))
    spans = spans.select("node", "total", F.array_position(wide, F.array_max(wide)).cast("int").alias("dimension"))
    at = open_groups.join(spans, "node").withColumn("x", F.element_at(F.array(*DIMENSIONS), F.col("dimension")))
    at = _placed(at, ("node", "x", "text_key"), "node", F.col("weight"))
    half = F.floor(F.col("shards") / 2).cast("int")
    # A group goes to the side that leaves the halves nearer to their shares.
    right = 2 * F.col("below") + F.col("weight") >= 2.0 * F.col("total") * half / F.col("shards")
    cut = at.select("text_key", "weight", *DIMENSIONS, F.when(right, F.col("node") + half).otherwise(F.col("node")).cast("int").alias("node"), F.when(right, F.col("shards") - half).otherwise(half).cast("int").alias("shards"))
    return groups.where("shards = 1").unionByName(cut)


def kd_shards(docs: DataFrame, shards: int) -> DataFrame:
    """``docs`` (doc_id, text_key, size, lang, source) with the column ``shard``, 0 to ``shards - 1``.

    A group heavier than an equal share of what is left gets a shard of its
    own first, which leaves the others as even as can be.  There is a level of
    cuts for each doubling of ``shards``.
    """
    groups = stored(_groups(docs))
    facts = groups.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("total"), *((F.max(d) - F.min(d)).alias(d) for d in DIMENSIONS)).first()
    alone = stored(_alone(groups, shards, facts["total"]))
    left = shards - alone.count()
    known = F.col("alone").isNotNull()
    groups = groups.join(alone, "text_key", "left").select("text_key", "weight", *DIMENSIONS, F.coalesce("alone", F.lit(0)).alias("node"), F.when(known, 1).otherwise(left).alias("shards"))
    whole = groups.where("shards > 1").agg(*((F.max(d) - F.min(d)).alias(d) for d in DIMENSIONS)).first()
    whole = {d: whole[d] or 1.0 for d in DIMENSIONS}
    groups = stored(groups)
    for _ in range(ceil(log2(left)) if left > 1 else 0):
        new = stored(_cut(groups, whole))
        released(docs.sparkSession, groups)
        groups = new
    return docs.join(groups.select("text_key", F.col("node").alias("shard")), "text_key")


def with_slots(rows: DataFrame) -> DataFrame:
    """``rows`` with ``slot``: 0, 1, ... within each shard, in order of text_key and doc_id."""
    return _placed(rows, ("shard", "text_key", "doc_id"), "shard", F.lit(1).cast("long")).withColumnRenamed("below", "slot")


def shard_documents(docs: DataFrame, shards: int = 8, target_bytes: int | None = None) -> DataFrame:
    """All rows as (doc_id, size, text_crc32, law, shard, slot, grown_shard), sharded by bytes.

    ``docs`` has doc_id, text, lang and source; other columns are left out, null
    lang and source count as empty.  size: UTF-8 bytes of the text (null: none) plus 1.  With ``target_bytes``
    the number of shards follows from the table.  The law is ``bytes``: shards
    are as near equal as whole groups allow.  Repeated rows each take a slot;
    null texts group with empty ones; an empty table gives no rows.  Texts stay
    in the scan: only digests and metadata are shuffled.
    """
    prepare(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", "lang", "source", F.md5(text).alias("text_key"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = stored(rows)
    if target_bytes:
        shards = max(1, ceil((rows.agg(F.sum("size")).first()[0] or 0) / target_bytes))
    rows = with_slots(kd_shards(rows, shards))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
