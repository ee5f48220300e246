"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A sketch has COORDINATES bins.  In round i every shingle is hashed to one
random bin with value i + v; the first round to reach a bin fills it.  Rounds
COORDINATES + j send every shingle to bin j, so that all bins are filled after
at most twice as many rounds (for usual documents after a few).  Two sketches
agree in a bin with probability equal to the Jaccard similarity, with
concentration as for independent sampling.

1. Texts with equal word sequences form one class.
2. Bands of the classes' sketches are shuffled by hash; lone ones go.
3. Stars: in each bucket every class is compared with the smallest one.
4. Blocks: where a bucket still spans components, all pairs across components
   whose sizes allow a link are compared by sketch, block against block, so
   that no link is lost.
5. All candidates are verified on full sets; links give the components.  Blocks
   verify their candidates themselves and pass on a spanning forest of links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import kernels as K
from lumenframe.llm.shared import components, map_arrow, prepare, released, stored

WIDTH = 5
#: A pair at the threshold 0.75 shares no band with probability (1 - 0.75**5)**50 = 1.3e-6.
BANDS, ROWS = 50, 5
COORDINATES = BANDS * ROWS
#: In blocks, pairs whose sketches agree in fewer coordinates are no candidates: 5 deviations below the threshold.
LEAST_AGREE = int(COORDINATES * 0.75 - 5 * (COORDINATES * 0.75 * 0.25) ** 0.5)
#: Classes in a block.
BLOCK = 256
#: Sizes of linked sets differ by a factor of 4/3 at most, so their layers, whole logarithms to this base, are equal or adjacent.
LAYER = 1.34
_SEEDS = np.random.default_rng(77).integers(1, 2**63, 2 * COORDINATES, dtype=np.uint64)
_BAND_MUL = np.random.default_rng(78).integers(1, 2**63, ROWS, dtype=np.uint64) | np.uint64(1)
_BAND_SEED = np.random.default_rng(79).integers(1, 2**63, BANDS, dtype=np.uint64)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """COORDINATES 64-bit values of a non-empty set of shingle hashes: round and hash."""
    out = np.zeros(COORDINATES, dtype=np.uint64)
    empty = np.ones(COORDINATES, dtype=bool)
    low = np.uint64((1 << 48) - 1)
    for i in range(COORDINATES):
        h = K.mix(shingles ^ _SEEDS[i])
        bins = ((h >> np.uint64(48)) * np.uint64(COORDINATES)) >> np.uint64(16)
        keyed = np.sort(bins << np.uint64(48) | (h & low))
        at = (keyed >> np.uint64(48)).astype(np.int64)
        first = np.ones(len(at), dtype=bool)
        first[1:] = at[1:] != at[:-1]
        at, keyed = at[first], keyed[first]
        new = empty[at]
        out[at[new]] = (keyed[new] & low) | np.uint64(i << 48)
        empty[at[new]] = False
        if not empty.any():
            return out
    for j in np.flatnonzero(empty):
        h = K.mix(shingles ^ _SEEDS[COORDINATES + j])
        out[j] = (int(h.min()) >> 16) | (COORDINATES + int(j)) << 48
    return out


def bands(values: np.ndarray) -> np.ndarray:
    rows = K.mix(values).reshape(BANDS, ROWS)
    return K.mix((rows * _BAND_MUL).sum(axis=1, dtype=np.uint64) ^ _BAND_SEED)


def shingle_sets(column) -> Iterator[tuple[bytes, np.ndarray]]:
    """For each text: a digest of its words (empty if it has none) and its sorted distinct shingle hashes."""
    data, offsets = K.text_buffer(column)
    for a, b in K.blocks(offsets):
        part, own = K.LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
        starts, ends, first = K.word_bounds(part, own)
        hashes = K.word_hashes(part, starts, ends)
        found, begin = K.shingles(hashes, first, WIDTH)
        for d in range(b - a):
            if first[d] == first[d + 1]:
                yield b"", found[:0]
                continue
            mine = hashes[first[d] : first[d + 1]]
            yield hashlib.blake2b(mine.tobytes(), digest_size=16).digest(), np.unique(found[begin[d] : begin[d + 1]])


def _signatures(batch: pa.RecordBatch) -> pa.RecordBatch:
    keys, sizes, marks, banded = [], [], [], []
    seen: dict[bytes, tuple] = {}
    for key, own in shingle_sets(batch.column(1)):
        keys.append(key or None)
        sizes.append(len(own))
        if not key:
            marks.append(None)
            banded.append(None)
            continue
        if key not in seen:
            values = sketch(own)
            seen[key] = (K.mix(values).astype(np.uint8).tobytes(), bands(values).astype(np.int64))
        marks.append(seen[key][0])
        banded.append(seen[key][1])
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), pa.array(banded, pa.list_(pa.int64()))], names=["doc_id", "key", "class", "n_shingles", "sketch", "bands"])


def _sets(batch: pa.RecordBatch) -> pa.RecordBatch:
    keys, sets = [], []
    for key, own in shingle_sets(batch.column(0)):
        keys.append(key or None)
        sets.append(own.tobytes())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], names=["class", "shingles"])


def _verify(batch: pa.RecordBatch) -> pa.RecordBatch:
    left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
    keep = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(left, right, strict=True)]
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


_BLOCKS = "bucket long, low long, high long, nodes array<binary>, pairs binary"


def _block_pairs(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Candidates across components of one bucket's block, or between its two blocks: pairs whose sketches nearly agree.

    One row holds the block's candidates.  A pair that shares several buckets
    belongs to the first of them.
    """
    bucket, low, high = (k.as_py() for k in key)
    names = table["node"]
    marks = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(-1, COORDINATES)
    banded = np.asarray(table["bands"].combine_chunks().flatten()).reshape(-1, BANDS)
    part = np.unique(np.array(table["component"].to_pylist(), dtype=object), return_inverse=True)[1]
    side = np.array(table["side"].to_pylist())
    found = []
    for i in range(len(names)):
        others = np.flatnonzero((part != part[i]) & ((np.arange(len(names)) > i) if low == high else (side > side[i])))
        others = others[(marks[others] == marks[i]).sum(axis=1) >= LEAST_AGREE]
        first = (banded[others] == banded[i]).argmax(axis=1)
        others = others[banded[i][first] == bucket]
        found.append(np.stack([np.full(len(others), i), others], axis=1))
    pairs = np.concatenate(found)
    if not len(pairs):
        return pa.table([pa.array([], k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.binary())], names=["bucket", "low", "high", "nodes", "pairs"])
    used, back = np.unique(pairs, return_inverse=True)
    nodes = names.take(pa.array(used)).to_pylist()
    columns = [pa.array([bucket], pa.int64()), pa.array([low], pa.int64()), pa.array([high], pa.int64()), pa.array([nodes], pa.list_(pa.binary())), pa.array([back.astype(np.int32).tobytes()], pa.binary())]
    return pa.table(columns, names=["bucket", "low", "high", "nodes", "pairs"])


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets are linked: 100 * intersection >= 75 * union."""
    small, large = min(len(x), len(y)), max(len(x), len(y))
    if 100 * small < 75 * large:
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= 75 * (len(x) + len(y) - common)


def _block_links(members: pa.Table, blocks: pa.Table) -> pa.Table:
    """Of a block's candidates, verified on full sets, links enough to connect what they connect."""
    left, right = [], []
    if blocks.num_rows:
        nodes, pairs = blocks["nodes"][0].as_py(), np.frombuffer(blocks["pairs"][0].as_py(), np.int32).reshape(-1, 2)
        sets = {k: np.frombuffer(v, np.uint64) for k, v in zip(members["node"].to_pylist(), members["shingles"].to_pylist(), strict=True)}
        up = list(range(len(nodes)))

        def top(i: int) -> int:
            while up[i] != i:
                up[i] = i = up[up[i]]
            return i

        for i, j in pairs.tolist():
            if top(i) != top(j) and similar(sets[nodes[i]], sets[nodes[j]]):
                up[top(i)] = top(j)
                left.append(nodes[i])
                right.append(nodes[j])
    return pa.table([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["a", "b"])


def _node(head: Column, digest: Column) -> Column:
    """A class as a binary value that sorts by its smallest doc_id, classes without one last."""
    turned = head.bitwiseXOR(F.lit(-(2**63)))
    known = F.concat(F.lit("00"), F.lpad(F.hex(turned), 16, "0"))
    return F.concat(F.unhex(F.when(head.isNull(), F.lit("01" + "0" * 16)).otherwise(known)), digest)


def _head(node: Column) -> Column:
    """The doc_id in a node; null if it has none."""
    turned = F.conv(F.hex(F.substring(node, 2, 8)), 16, -10).cast("long")
    return F.when(F.hex(F.substring(node, 1, 1)) == "00", turned.bitwiseXOR(F.lit(-(2**63))))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the distinct pairs (a, b) whose full sets are similar."""
    for end in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(end), F.col("shingles").alias(f"set_{end}")), end)
    return map_arrow(pairs.select("a", "b", "set_a", "set_b"), _verify, "a binary, b binary")


def near_duplicates(docs: DataFrame, key: str | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept, class (a digest of the words; null without words).

    A string column ``key`` rides along if named.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; a set
    holds the distinct 5-word shingles as 64-bit hashes, with fewer words the
    whole sequence.  Documents are linked if 100 * intersection >= 75 * union;
    component_id is the smallest doc_id reachable.  Texts without words (or
    null) are linked with nothing and kept.  Documents with a null doc_id take
    part; if no member has a doc_id the component_id is null and kept is true.
    Repeated rows and ids are rows of their own; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.col(key) if key else F.lit(None)).cast("string").alias("key"))
    signed = stored(map_arrow(docs, _signatures, "doc_id long, key string, class binary, n_shingles long, sketch binary, bands array<long>"))
    heads = signed.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("head"))
    heads = stored(heads.withColumn("node", _node(F.col("head"), F.col("class"))))
    # One row for each class: that with its smallest doc_id; repeated ids give equal rows, of which one is kept.
    own = signed.where("class is not null").select("class", "doc_id", F.col("n_shingles").alias("size"), "sketch", "bands")
    own = stored(own.join(heads, "class").where("doc_id <=> head").select("node", "size", "sketch", "bands").dropDuplicates(["node"]))
    rows = own.select("node", "size", F.explode("bands").alias("bucket"))
    # The star has the smallest doc_id: copies tend to be nearer to what they copy than to each other.
    buckets = stored(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node", "size")).alias("star")).where("n > 1"))
    members = stored(rows.join(buckets.select("bucket", "star"), "bucket"))
    released(docs.sparkSession, buckets)
    near = 4 * F.least("size", "star.size") >= 3 * F.greatest("size", "star.size")
    stars = stored(members.where((F.col("node") != F.col("star.node")) & near).select(F.col("star.node").alias("a"), F.col("node").alias("b")).distinct())

    def full_sets() -> DataFrame:
        """Sets of the nodes that share a bucket, from the texts of their first documents."""
        named = stored(members.select("node").distinct().join(heads, "node"))
        ids = named.select(F.col("head").alias("doc_id")).distinct()
        # The ids grow with the corpus: never a broadcast.
        texts = docs.join(ids.hint("merge"), docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi").select("text")
        found = map_arrow(texts, _sets, "class binary, shingles binary")
        return stored(found.join(named.select("class", "node"), "class").select("node", "shingles").dropDuplicates(["node"]))

    sets = full_sets()
    links = stored(_confirmed(stars, sets))
    labels = components(links)
    placed = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = stored(placed.select("node", "bucket", F.floor(F.log(LAYER, "size")).cast("int").alias("layer"), "component"))
    released(docs.sparkSession, members, stars)
    # Of a bucket that spans components, how many blocks each layer has; layers are few.
    layers = placed.groupBy("bucket", "layer").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("sides"), F.min("component").alias("low"), F.max("component").alias("high"))
    layers = layers.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("layer", "sides"))).alias("sides"), F.min("low").alias("low"), F.max("high").alias("high"))
    placed = placed.join(layers.where("low <> high").select("bucket", "sides"), "bucket").join(own.drop("size"), "node")

    def side(layer: Column, number: Column) -> Column:
        return F.shiftleft(layer.cast("long"), 32) + number

    placed = placed.withColumn("side", side(F.col("layer"), F.pmod(F.xxhash64("node"), F.try_element_at("sides", F.col("layer")))))
    placed = placed.withColumn("beside", F.explode(F.array(*(F.col("layer") + d for d in (-1, 0, 1)))))
    others = F.try_element_at("sides", F.col("beside"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), others - 1))).withColumn("other", side(F.col("beside"), F.col("other")))
    placed = placed.withColumns({"low": F.least("side", "other"), "high": F.greatest("side", "other")}).drop("sides", "layer", "beside", "other")
    block = ["bucket", "low", "high"]
    blocks = stored(placed.groupBy(*block).applyInArrow(_block_pairs, _BLOCKS))
    wanted = blocks.select(*(F.col(c).alias(f"of_{c}") for c in block), F.explode("nodes").alias("node")).join(sets, "node")
    more = stored(wanted.groupBy(*(f"of_{c}" for c in block)).cogroup(blocks.groupBy(*block)).applyInArrow(_block_links, "a binary, b binary"))
    if more.take(1):
        labels = components(links.unionByName(more))
    classes = heads.join(labels, "node", "left").select("class", _head(F.coalesce("component", "node")).alias("component_id"))
    out = signed.select("doc_id", "key", "n_shingles", "class").join(classes, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "class", *([F.col("key").alias(key)] if key else []))
