"""Removal of repeated byte strings by a sparse, distributed suffix array.

Every string of LENGTH bytes contains the suffix start that is its minimizer:
the GRAM-byte gram of smallest hash, the leftmost of equals.  It depends on
the string alone, so equal strings have it at the same place, and suffixes
need be sorted at minimizers only.

1. The grams at minimizers are range-partitioned by sampled splitters over
   their leading bytes; buckets sort them by multikey quicksort and report
   those found in two or more distinct texts.  A task settles what repeats
   among its own texts itself and passes on one entry for each gram and text.
2. The suffixes at reported minimizers, with the bytes before them that their
   strings need, are range-partitioned by (suffix, left bytes, doc_id, place).
   Buckets sort locally by multikey quicksort; common prefixes of neighbours
   give the groups of equal strings, and all but those of the smallest doc_id go.
3. Groups at a bucket's edges are compared across boundaries: each bucket passes
   on one row for each of them, with its smallest doc_id and where that stands;
   the least by string is aggregated and answers the rows.

Splitters have two levels.  At most RANGES ranges have splitters from a sample
of fixed size, which is all that the driver sees.  Where a range should hold
several buckets, its task cuts it again by splitters from its own first entries
(step 1), or takes it a bucket at a time in Spark's spilling sort order (step 2).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.llm import kernels as K
from lumenframe.llm.shared import map_arrow, prepare, released, stored
from lumenframe.session import one_by_one

LENGTH = 50
GRAM = 16
#: Minimizers that a task sorts at a time, and that a bucket is meant to hold.
FLUSH = 1 << 20
BUCKET = 3 << 19
#: Suffixes meant for a bucket of the second sort.
SUFFIXES = 100_000
#: First-level ranges at most, and documents whose grams give their splitters; only the balance of ranges depends on them.
RANGES, SAMPLE_DOCS, SAMPLE_WORDS = 8192, 512, 256
#: Occurrences that a row of an edge group lists at most; further rows list the rest.
HITS = 20_000
#: Bytes of a very long text that are looked at together.
SEGMENT = 1 << 20
_M0, _M1 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words_at(data: np.ndarray) -> np.ndarray:
    """At each byte the next 8 as a big-endian number; zeros follow the end."""
    x = np.zeros(len(data) + 7, dtype=np.uint64)
    x[: len(data)] = data
    x = x[:-1] << np.uint64(8) | x[1:]
    x = x[:-2] << np.uint64(16) | x[2:]
    return x[:-4] << np.uint64(32) | x[4:]


def minimizers(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """For documents in ``data``: document, position, first and last string start of each minimizer, its gram's two words and hash.

    Positions are relative to ``data``.  Each start of a string of ``length``
    bytes within a document belongs to exactly one minimizer.
    """
    none = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(np.uint64)
    w = words_at(data)
    second = np.zeros(len(data), dtype=np.uint64)
    second[:-8] = w[8:]
    h = K.mix(w * _M0 + K.mix(second * _M1))
    key = (h >> np.uint64(24)) << np.uint64(24) | np.arange(len(data), dtype=np.uint64)
    span, m = length - GRAM + 1, key
    step = 1
    while step * 2 <= span:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    if span > step:
        m = np.minimum(m[: len(m) - (span - step)], m[span - step :])
    sizes = np.diff(offsets)
    for_docs = sizes >= length
    edges = np.zeros(len(data) + 1, dtype=np.int32)
    np.add.at(edges, offsets[:-1][for_docs], 1)
    np.add.at(edges, offsets[1:][for_docs] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(edges[:-1]) > 0)
    if not len(starts):
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(np.uint64)
    at = (m[starts] & np.uint64(0xFFFFFF)).astype(np.int64)
    first = np.ones(len(at), dtype=bool)
    first[1:] = at[1:] != at[:-1]
    begin = np.flatnonzero(first)
    at, low = at[begin], starts[begin]
    high = starts[np.append(begin[1:], len(starts)) - 1]
    doc = np.searchsorted(offsets, at, "right") - 1
    return doc, at, low, high, w[at], second[at], h[at]


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, byte offset, bytes, offsets) of blocks; a very long document comes in segments that overlap by a string less a byte."""
    for a, b in K.blocks(offsets):
        lo, hi = int(offsets[a]), int(offsets[b])
        if hi - lo <= SEGMENT:
            yield a, lo, data[lo:hi], offsets[a : b + 1] - lo
            continue
        for s in range(lo, hi, SEGMENT):
            e = min(hi, s + SEGMENT + length - 1)
            yield a, s, data[s:e], np.array([0, e - s])


def multikey_order(words: np.ndarray) -> np.ndarray:
    """An order that sorts rows of 8-byte characters: by one character, then ties by the next."""
    order = np.argsort(words[:, 0], kind="quicksort")
    key = words[order, 0]
    new = np.ones(len(order), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    for d in range(1, words.shape[1]):
        tied = ~new
        tied[:-1] |= ~new[1:]
        rows = np.flatnonzero(tied)
        if not len(rows):
            break
        group, own = np.cumsum(new)[rows], order[rows]
        key = words[own, d]
        o = np.lexsort((key, group))
        order[rows], key = own[o], key[o]
        differ = np.ones(len(rows), dtype=bool)
        differ[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        new[rows] = differ
    return order


def _pack(array: np.ndarray) -> bytes:
    """Sorted words compress well byte plane by byte plane."""
    planes = np.ascontiguousarray(array).view(np.uint8).reshape(len(array), -1).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(data: bytes, kind, n: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(-1, n).T).view(kind).reshape(n)


_GRAMS = "bucket int, n int, grams binary, seconds binary, rows binary, ids binary, digests binary, hashes binary"
_REPORTS = "place int, n int, ids binary, digests binary, rows binary, hashes binary"


def _distinct_texts(gram_new: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """For each row of runs of equal grams: whether its run has two distinct texts."""
    run = np.cumsum(gram_new) - 1
    first = digest[np.flatnonzero(gram_new)][run]
    many = np.zeros(run[-1] + 1 if len(run) else 0, dtype=bool)
    many[run[digest != first]] = True
    return many[run]


def _new_runs(w0: np.ndarray, w1: np.ndarray) -> np.ndarray:
    new = np.ones(len(w0), dtype=bool)
    new[1:] = (w0[1:] != w0[:-1]) | (w1[1:] != w1[:-1])
    return new


def _gram_hash(w0: np.ndarray, w1: np.ndarray) -> np.ndarray:
    return (K.mix(w0 * _M0 + K.mix(w1 * _M1)) >> np.uint64(32)).astype(np.uint32)


def _found(doc: np.ndarray, hashes: np.ndarray, ids: np.ndarray, digests: np.ndarray, places: int) -> Iterator[tuple]:
    """Packed reports: (place, n, ids, digests, rows, hashes) of the documents that go to one place."""
    if not len(doc):
        return
    place = (K.mix(ids.view(np.uint64))[doc] % np.uint64(places)).astype(np.int32)
    o = np.lexsort((doc, place))
    doc, hashes, place = doc[o], hashes[o], place[o]
    cuts = np.append(np.flatnonzero(np.append(True, place[1:] != place[:-1])), len(place))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        used, back = np.unique(doc[a:b], return_inverse=True)
        yield int(place[a]), int(b - a), ids[used].tobytes(), digests[used].tobytes(), back.astype(np.int32).tobytes(), hashes[a:b].tobytes()


def _row(values: list, schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[k]) for v, (_, k) in zip(values, fields, strict=True)], names=[n for n, _ in fields])


def _pieces(bucket: np.ndarray, doc: np.ndarray, w0: np.ndarray, w1: np.ndarray, ids: np.ndarray, digests: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Packed entries, sorted by ``bucket``; -1 in ``doc`` stands for several texts."""
    cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        used, back = np.unique(doc[a:b], return_inverse=True)
        rows = (back - (1 if used[0] < 0 else 0)).astype(np.int32)
        used = used[used >= 0]
        yield _row([int(bucket[a]), int(b - a), _pack(w0[a:b]), _pack(w1[a:b]), _pack(rows), ids[used].tobytes(), digests[used].tobytes(), None], _GRAMS)


def _opened(held: list[dict]) -> tuple[np.ndarray, ...]:
    """doc (a row of ids and digests, or -1), w0, w1, ids, digests of packed entries."""
    w0 = np.concatenate([_unpack(x["grams"], np.uint64, x["n"]) for x in held])
    w1 = np.concatenate([_unpack(x["seconds"], np.uint64, x["n"]) for x in held])
    ids = np.concatenate([np.frombuffer(x["ids"], np.int64) for x in held])
    digests = np.concatenate([np.frombuffer(x["digests"], np.dtype("V16")) for x in held])
    doc, base = [], 0
    for x in held:
        rows = _unpack(x["rows"], np.int32, x["n"]).astype(np.int64)
        doc.append(np.where(rows < 0, -1, rows + base))
        base += len(x["ids"]) // 8
    return np.concatenate(doc), w0, w1, ids, digests


def _grams(batches: Iterator[pa.RecordBatch], splitters: np.ndarray, length: int, places: int) -> Iterator[pa.RecordBatch]:
    """Entries (gram, text) of a task's documents for the buckets, and reports of grams that already repeat here."""
    ids, digests, parts, held = [], [], [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        own_ids, own_digests = np.array(ids, dtype=np.int64), np.frombuffer(b"".join(digests), dtype=np.dtype("V16"))
        doc, w0, w1 = (np.concatenate([p[i] for p in parts]) for i in range(3))
        # Of copies only the one with the smallest id goes on: the others go whole.
        text = np.unique(own_digests.view(np.uint64).reshape(-1, 2), axis=0, return_inverse=True)[1].reshape(-1)
        order = np.lexsort((own_ids, text))
        head = np.zeros(len(own_ids), dtype=bool)
        head[order] = np.append(True, text[order][1:] != text[order][:-1])
        keep = head[doc]
        doc, w0, w1 = doc[keep], w0[keep], w1[keep]
        if not len(doc):
            return
        o = multikey_order(np.stack([w0, w1], axis=1))
        doc, w0, w1 = doc[o], w0[o], w1[o]
        new = _new_runs(w0, w1)
        many = _distinct_texts(new, text[doc])
        for place, n, *report in _found(doc[many], _gram_hash(w0[many], w1[many]), own_ids, own_digests, places):
            yield _row([-1 - place, n, None, None, report[2], report[0], report[1], report[3]], _GRAMS)
        # One entry for a gram that repeats here (no document: any other text with it repeats it), else one for its text.
        doc = np.where(many, -1, doc)[new].astype(np.int32)
        w0, w1 = w0[new], w1[new]
        yield from _pieces(np.searchsorted(splitters, w0, "right"), doc, w0, w1, own_ids, own_digests)

    for batch in batches:
        data, offsets = K.text_buffer(batch.column(1))
        base = len(ids)
        ids += batch.column(0).to_pylist()
        digests += batch.column(2).to_pylist()
        for a, _, part, own in segments(data, offsets, length):
            doc, _, _, _, w0, w1, _ = minimizers(part, own, length)
            parts.append((doc + (base + a), w0, w1))
            held += len(doc)
            if held >= FLUSH:
                yield from flush()
                parts, held = [], 0
        if not held:
            ids, digests = [], []
    if held:
        yield from flush()


def _recut(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """A range's entries cut into ``buckets`` by second-level splitters: quantiles of the first FLUSH of them.  Reports pass through."""
    held: list[dict] = []
    splitters, size = None, 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal splitters
        doc, w0, w1, ids, digests = _opened(held)
        held.clear()
        o = np.argsort(w0, kind="stable")
        doc, w0, w1 = doc[o], w0[o], w1[o]
        if splitters is None:
            splitters = np.unique(w0[np.arange(1, buckets) * len(w0) // buckets])
        yield from _pieces(np.searchsorted(splitters, w0, "right"), doc, w0, w1, ids, digests)

    for x in one_by_one(batches):
        if x["bucket"] < 0:
            yield _row(list(x.values()), _GRAMS)
            continue
        held.append(x)
        size += x["n"]
        if size >= FLUSH:
            yield from flush()
            size = 0
    if held:
        yield from flush()


def _repeats(batches: Iterator[pa.RecordBatch], places: int) -> Iterator[pa.RecordBatch]:
    """Sort each bucket's entries; report the documents of grams that two distinct texts have.  Reports pass through."""
    held: list[dict] = []

    def settle() -> Iterator[pa.RecordBatch]:
        doc, w0, w1, ids, digests = _opened(held)
        held.clear()
        o = multikey_order(np.stack([w0, w1], axis=1))
        doc, w0, w1 = doc[o], w0[o], w1[o]
        text = np.unique(digests.view(np.uint64).reshape(-1, 2), axis=0, return_inverse=True)[1].reshape(-1) if len(digests) else np.zeros(0, np.int64)
        # An entry without a document stands for two texts at least.
        mark = np.where(doc < 0, -1 - np.arange(len(doc)), text[doc] if len(text) else 0)
        new = _new_runs(w0, w1)
        many = _distinct_texts(new, mark) & (doc >= 0)
        for report in _found(doc[many], _gram_hash(w0[many], w1[many]), ids, digests, places):
            yield _row(report, _REPORTS)

    for x in one_by_one(batches):
        if x["bucket"] < 0:
            yield _row([-1 - x["bucket"], x["n"], x["ids"], x["digests"], x["rows"], x["hashes"]], _REPORTS)
            continue
        if held and held[0]["bucket"] != x["bucket"]:
            yield from settle()
        held.append(x)
    if held:
        yield from settle()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each reported document: doc_id, digest, the hashes of its grams.  Takes reports sorted by place."""
    held: list[dict] = []

    def settle() -> Iterator[pa.RecordBatch]:
        key = np.concatenate([np.frombuffer(x["digests"], np.dtype("V16")) for x in held])
        ids = np.concatenate([np.frombuffer(x["ids"], np.int64) for x in held])
        full = np.concatenate([ids.view(np.uint64)[:, None], key.view(np.uint64).reshape(-1, 2)], axis=1)
        own, number = np.unique(full, axis=0, return_inverse=True)
        rows, base = [], 0
        for x in held:
            rows.append(np.frombuffer(x["rows"], np.int32) + base)
            base += len(x["ids"]) // 8
        doc = number.reshape(-1)[np.concatenate(rows)]
        hashes = np.concatenate([np.frombuffer(x["hashes"], np.uint32) for x in held])
        held.clear()
        both = np.unique(doc.astype(np.uint64) << np.uint64(32) | hashes.astype(np.uint64))
        doc, hashes = (both >> np.uint64(32)).astype(np.int64), both.astype(np.uint32)
        first = np.searchsorted(doc, np.arange(len(own) + 1))
        for a in range(0, len(own), 5000):
            part = np.arange(a, min(a + 5000, len(own)))
            texts = pa.array([own[i, 1:].tobytes() for i in part], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(own[part, 0]).view(np.int64)), texts, pa.array([hashes[first[i] : first[i + 1]].tobytes() for i in part], pa.binary())], names=["doc_id", "digest", "hashes"])

    for x in one_by_one(batches):
        if held and held[0]["place"] != x["place"]:
            yield from settle()
        held.append(x)
    if held:
        yield from settle()


def _suffixes(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows (row_id, doc_id, pos, before, after, left, suffix) of minimizers whose grams are reported.

    ``before``, ``after``: how far the first and last of its string starts lie
    before the minimizer.  ``left``: the bytes before it that its strings need.
    """
    for batch in batches:
        data, offsets = K.text_buffer(batch.column(2))
        raw, cuts = K.text_buffer(batch.column(3))
        wanted = np.repeat(np.arange(batch.num_rows, dtype=np.uint64), np.diff(cuts) // 4) << np.uint64(32) | np.ascontiguousarray(raw).view(np.uint32)
        rows, doc_ids = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        for a, base, part, own in segments(data, offsets, length):
            doc, at, low, high, _, _, h = minimizers(part, own, length)
            doc = doc + a
            take = np.isin(doc.astype(np.uint64) << np.uint64(32) | h >> np.uint64(32), wanted)
            if not take.any():
                continue
            doc, at, low, high = doc[take], at[take] + base, low[take] + base, high[take] + base
            columns = [pa.array(rows[doc]), pa.array(doc_ids[doc]), pa.array(at - offsets[doc]), pa.array((at - low).astype(np.int32)), pa.array((at - high).astype(np.int32)), K.slices(data, low, at - low), K.slices(data, at, high + length - at)]
            yield pa.RecordBatch.from_arrays(columns, names=["row_id", "doc_id", "pos", "before", "after", "left", "suffix"])


_FLAGS = "row_id long, pos long, mask binary, low long, high long, doc_id long, back int, hits binary"


def _settle(batches: Iterator[pa.RecordBatch], length: int, most: int | None) -> Iterator[pa.RecordBatch]:
    """A partition's buckets: all of it, or ``most`` suffixes at a time where Spark has sorted it."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if most and n >= most:
            yield from _bucket(held, length)
            held, n = [], 0
    if held:
        yield from _bucket(held, length)


def _bucket(batches: list[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Sort a bucket's suffixes; flag strings that a smaller doc_id has too; report the groups at the edges.

    Flag rows have ``mask``: for each ``back`` from ``after`` to ``before``
    whether the string starting that far before the minimizer goes.  Edge rows
    have ``low`` and ``high`` (128 bits of the string), the group's smallest
    ``doc_id``, and in ``hits`` the (row_id, pos) of its occurrences there.
    """
    table = pa.Table.from_batches(batches).combine_chunks()
    batches.clear()
    row_id, doc_id, pos = (table[c].to_numpy() for c in ("row_id", "doc_id", "pos"))
    before, after = (table[c].to_numpy().astype(np.int64) for c in ("before", "after"))
    reach = length - GRAM
    suffix = K.matrix(table["suffix"], -(-length // 8) * 8)
    left = K.matrix(table["left"], max(reach, 1), True)
    words = suffix.view(">u8").astype(np.uint64)
    lengths = np.diff(K.text_buffer(table["suffix"])[1])
    order = multikey_order(np.concatenate([words, lengths[:, None].astype(np.uint64)], axis=1))
    row_id, doc_id, pos, before, after, left, suffix, lengths = (x[order] for x in (row_id, doc_id, pos, before, after, left, suffix, lengths))
    n = len(order)
    differ = suffix[1:] != suffix[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), suffix.shape[1])
    common = np.minimum(common, np.minimum(lengths[1:], lengths[:-1]))
    flags = np.zeros((n, reach + 1), dtype=bool)
    edges: list[tuple[np.ndarray, ...]] = []
    left_hash = np.zeros(n, dtype=np.uint64)
    for back in range(reach + 1):
        if back:
            left_hash = K.mix(left_hash * _M0 + left[:, reach - back].astype(np.uint64) + np.uint64(1))
        need = length - back
        run = np.zeros(n, dtype=np.int64)
        np.cumsum(common < need, out=run[1:])
        own = np.flatnonzero((after <= back) & (back <= before))
        if not len(own):
            continue
        group = K.mix(left_hash[own] ^ K.mix(run[own].astype(np.uint64)))
        o = np.argsort(group, kind="quicksort")
        group, own = group[o], own[o]
        r, d = run[own], doc_id[own]
        new = np.ones(len(o), dtype=bool)
        new[1:] = group[1:] != group[:-1]
        least = np.minimum.reduceat(d, np.flatnonzero(new))[np.cumsum(new) - 1]
        flags[own, back] = d > least
        edge = np.flatnonzero(((r == 0) | (r == run[-1])) & (d == least))
        if len(edge):
            # A row for each group; a long one goes on in further rows.
            at, number = own[edge], (np.cumsum(new) - 1)[edge]
            nth = np.arange(len(at)) - np.searchsorted(number, number)
            begin = np.flatnonzero(nth % HITS == 0)
            heads = at[begin]
            string = np.concatenate([left[heads][:, reach - back :] if back else left[heads][:, :0], suffix[heads][:, :need]], axis=1)
            digest = np.frombuffer(b"".join(hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in string), np.int64).reshape(-1, 2)
            places = np.stack([row_id[at], pos[at]], axis=1).astype("<i8").view(np.uint8).reshape(-1)
            hits = K.slices(places, begin * 16, np.diff(np.append(begin, len(at))) * 16)
            edges.append((digest[:, 0], digest[:, 1], doc_id[heads], np.full(len(heads), back, dtype=np.int32), hits))
    some = np.flatnonzero(flags.any(axis=1))
    names = [x.split()[0] for x in _FLAGS.split(", ")]
    packed = np.packbits(flags, axis=1)
    for a in range(0, len(some), 20_000):
        at = some[a : a + 20_000]
        n = len(at)
        yield pa.RecordBatch.from_arrays([pa.array(row_id[at]), pa.array(pos[at]), pa.array([packed[i].tobytes() for i in at], pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
    for low, high, docs, back, hits in edges:
        n = len(low)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(low), pa.array(high), pa.array(docs), pa.array(back), hits], names=names)


def _answered(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The occurrences (row_id, pos, back) that edge rows list."""
    data, offsets = K.text_buffer(batch.column("hits"))
    places = np.ascontiguousarray(data).view("<i8").reshape(-1, 2)
    back = np.repeat(np.asarray(batch.column("back")), np.diff(offsets) // 16)
    return pa.RecordBatch.from_arrays([pa.array(places[:, 0].copy()), pa.array(places[:, 1].copy()), pa.array(back)], names=["row_id", "pos", "back"])


def _covered(marks, offsets: np.ndarray, size: int, length: int) -> np.ndarray:
    """Which bytes of a batch flagged strings cover.  ``marks``: a list of (pos, mask, back) for each text."""
    cuts = np.asarray(marks.value_lengths().fill_null(0))
    flat = marks.flatten()
    doc = np.repeat(np.arange(len(marks)), cuts)
    pos = np.asarray(flat.field("pos"))
    mask, back = flat.field("mask"), flat.field("back")
    single = np.asarray(mask.is_null())
    starts = [offsets[doc[single]] + pos[single] - np.asarray(back.fill_null(0))[single]]
    if not single.all():
        data, at = K.text_buffer(mask.filter(pa.array(~single)))
        row, bit = np.nonzero(np.unpackbits(data.reshape(len(at) - 1, -1), axis=1))
        starts.append(offsets[doc[~single][row]] + pos[~single][row] - bit)
    starts = np.concatenate(starts)
    change = np.bincount(starts, minlength=size + 1) - np.bincount(starts + length, minlength=size + 1)
    return np.cumsum(change[:size]) > 0


def _finish(batch: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """Append n_bytes, n_removed, n_spans, kept_sha256 and kept_text."""
    data, offsets = K.text_buffer(batch.column("text"))
    gone = _covered(batch.column("marks"), offsets, len(data), length) if len(data) else np.zeros(0, dtype=bool)
    edge = np.zeros(len(data), dtype=bool)
    edge[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = gone.copy()
    starts[1:] &= ~gone[:-1] | edge[1:]
    sums = [np.concatenate([[0], np.cumsum(x)]) for x in (gone, starts)]
    removed, spans = (x[offsets[1:]] - x[offsets[:-1]] for x in sums)
    kept = data[~gone].tobytes()
    cuts = offsets - sums[0][offsets]
    hashes = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    # Characters that a span covers in part stay whole.
    if len(data):
        begin = np.flatnonzero((data & 0xC0 != 0x80) | edge)
        gone = np.repeat(np.minimum.reduceat(gone, begin), np.diff(np.append(begin, len(data))))
    total = np.concatenate([[0], np.cumsum(gone)])
    whole, cuts = np.ascontiguousarray(data[~gone]), offsets - total[offsets]
    text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(np.ascontiguousarray(cuts)), pa.py_buffer(whole)]).cast(pa.binary()).cast(pa.string())
    names = [c for c in batch.schema.names if c not in ("text", "marks")]
    new = [pa.array(np.diff(offsets)), pa.array(removed), pa.array(spans), pa.array(hashes, pa.string()), text]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *new], names=[*names, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])


def _leading(batch: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """Leading words of up to about SAMPLE_WORDS minimizers, evenly spread over each text."""
    out = []
    for text in batch.column("text").cast(pa.binary()).to_pylist():
        data = np.frombuffer(text, np.uint8)
        found = [minimizers(part, own, length)[4] for _, _, part, own in segments(data, np.array([0, len(data)]), length)]
        words = np.concatenate(found)
        out.append(words[:: len(words) // SAMPLE_WORDS + 1].tobytes())
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(out, pa.binary())], names=["doc_id", "digest", "words"])


def _splitters(texts: DataFrame, ranges: int, length: int) -> np.ndarray:
    """Quantiles of the leading words of minimizers in SAMPLE_DOCS documents.

    Ids are sampled first; the texts stay in their tasks, which send at most
    SAMPLE_WORDS words of each.
    """
    if ranges < 2:
        return np.zeros(0, dtype=np.uint64)
    picked = texts.select("doc_id", "digest").orderBy(F.xxhash64("doc_id", "digest")).limit(SAMPLE_DOCS).distinct()
    # At most SAMPLE_DOCS ids are broadcast.
    sample = texts.join(F.broadcast(picked), ["doc_id", "digest"], "left_semi")
    rows = map_arrow(sample, partial(_leading, length=length), "doc_id long, digest binary, words binary").dropDuplicates(["doc_id", "digest"]).select("words").collect()
    words = np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r["words"], np.uint64) for r in rows)]))
    return np.unique(words[np.arange(1, ranges) * len(words) // ranges]) if len(words) else words


#: Columns that the result adds; old ones of these names are replaced.
RESULTS = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")


def repeated_strings(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` (doc_id, text, other columns that ride along) as rows with n_bytes, n_removed, n_spans, kept_sha256 and kept_text.

    A byte goes if a string of ``length`` bytes that covers it also starts in a
    document with a smaller doc_id; strings are judged on the input texts and do
    not cross documents.  ``kept_text`` leaves characters whole that a span
    covers in part.  Null text is empty (kept_text stays null).  Rows with a
    null doc_id are neither cut nor compared.  Rows that share a doc_id never
    cut each other.  Other columns may have any names (they ride in one struct);
    old ones named as results are replaced.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    extra = [c for c in docs.columns if c.lower() not in ("doc_id", "text", *RESULTS)]
    rest = F.struct(*(F.col(f"`{c}`") for c in extra)) if extra else F.lit(None).cast("struct<none:int>")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", rest.alias("rest"), F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).alias("digest"))
    usable = docs.where((F.octet_length("text") >= length) & F.col("doc_id").isNotNull()).select("doc_id", "text", "digest")
    total = usable.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), round(total * 2 / (length - GRAM + 2) / BUCKET))
    ranges = min(buckets, RANGES)
    # Reports go to as many places; a partition takes its places one after the other.
    places, parts = buckets, ranges
    splitters = _splitters(usable, ranges, length)
    grams = usable.mapInArrow(partial(_grams, splitters=splitters, length=length, places=places), _GRAMS)
    own = F.when(F.col("bucket") < 0, F.pmod(-1 - F.col("bucket"), F.lit(ranges))).otherwise(F.col("bucket")).cast("int")
    grams = grams.repartitionById(ranges, own)
    if buckets > ranges:
        grams = grams.mapInArrow(partial(_recut, buckets=-(-buckets // ranges)), _GRAMS)
    reports = grams.sortWithinPartitions("bucket").mapInArrow(partial(_repeats, places=places), _REPORTS)
    reports = reports.repartitionById(parts, F.pmod("place", F.lit(parts)).cast("int")).sortWithinPartitions("place")
    reports = stored(reports.mapInArrow(_merge, "doc_id long, digest binary, hashes binary"))
    ids = usable.select("doc_id", "digest").distinct()
    heads = ids.groupBy("digest").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "head")
    copies = stored(ids.join(heads, "digest").where("doc_id > head").select("doc_id", "digest"))
    wanted = reports.join(copies, ["doc_id", "digest"], "left_anti")
    facts = wanted.select("doc_id", "digest", "hashes", F.lit(False).alias("copy")).unionByName(copies.select("doc_id", "digest", F.lit(None).cast("binary").alias("hashes"), F.lit(True).alias("copy")))
    # The texts are shuffled once; those without a reported gram are done here.
    placed = docs.join(facts, ["doc_id", "digest"], "left").drop("digest").withColumn("copy", F.coalesce("copy", F.lit(False)))
    done = _done_or_open(placed, length)
    done = stored(done.withColumn("row_id", F.monotonically_increasing_id()))
    released(spark, reports, copies)
    open_rows = done.where("hashes is not null")
    suffixes = stored(open_rows.select("row_id", "doc_id", "text", "hashes").mapInArrow(partial(_suffixes, length=length), "row_id long, doc_id long, pos long, before int, after int, left binary, suffix binary"))
    wanted_parts = max(1, suffixes.count() // SUFFIXES)
    order = ("suffix", "left", "doc_id", "row_id", "pos")
    ranged = suffixes.repartitionByRange(min(wanted_parts, RANGES), *order)
    if wanted_parts > RANGES:
        ranged = ranged.sortWithinPartitions(*order)
    flags = stored(ranged.mapInArrow(partial(_settle, length=length, most=SUFFIXES if wanted_parts > RANGES else None), _FLAGS))
    released(spark, suffixes)
    edges = flags.where("mask is null").select("low", "high", "doc_id", "back", "hits")
    # Only strings that several buckets hold, from different documents, have an answer.
    least = edges.groupBy("low", "high").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("low", "high", "least")
    asked = edges.join(least, ["low", "high"]).where("doc_id > least").select("back", "hits")
    across = map_arrow(asked, _answered, "row_id long, pos long, back int").select("row_id", "pos", F.lit(None).cast("binary").alias("mask"), "back")
    marks = flags.where("mask is not null").select("row_id", "pos", "mask", "back").unionByName(across)
    marks = marks.groupBy("row_id").agg(F.collect_list(F.struct("pos", "mask", "back")).alias("marks"))
    open_rows = open_rows.select("row_id", "doc_id", "rest", "text").join(marks, "row_id", "left").drop("row_id")
    cut = map_arrow(open_rows, partial(_finish, length=length), _schema(docs))
    out = done.where("hashes is null").select(cut.columns).unionByName(cut)
    return out.select("doc_id", *(F.col("rest").getField(c).alias(c) for c in extra), *RESULTS)


def _schema(docs: DataFrame) -> T.StructType:
    kinds = (T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.StringType())
    return T.StructType([docs.schema["doc_id"], docs.schema["rest"], *(T.StructField(c, k) for c, k in zip(RESULTS, kinds, strict=True))])


def _done_or_open(placed: DataFrame, length: int) -> DataFrame:
    """Results for texts that no report concerns; the others with text and hashes."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    size = F.octet_length(raw).cast("long")
    whole = F.col("copy") & (size >= length)
    is_open = F.col("hashes").isNotNull()
    return placed.select(
        "doc_id",
        "rest",
        size.alias("n_bytes"),
        F.when(whole, size).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("n_spans"),
        F.sha2(F.when(whole, F.lit("").cast("binary")).otherwise(raw), 256).alias("kept_sha256"),
        F.when(~is_open, F.when(whole, F.lit("")).otherwise(F.col("text"))).alias("kept_text"),
        F.when(is_open, F.col("text")).alias("text"),
        "hashes",
    )
