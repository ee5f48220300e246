"""Vectorised text kernels shared by the operators of this subpackage.

Everything here works on one Arrow batch inside a Python worker: a byte buffer
plus document offsets.  Memory is a small multiple of the batch's text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: White space of the word pattern ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

#: Words longer than this are hashed one by one; the others in blocks.
LONG_WORD = 4096
BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_WORD_MUL = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | U64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=U64)
    filled, step = 1, base
    while filled < n:
        m = min(filled, n - filled)
        out[filled : filled + m] = out[:m] * U64(step)
        filled, step = filled + m, step * step % 2**64
    return out


_SIZE = BLOCK + LONG_WORD + 1
_POW = _powers(_BASE, _SIZE)
_INV = _powers(pow(_BASE, -1, 2**64), _SIZE)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; bijective."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets (one more than rows) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.cast(pa.large_binary() if big else pa.binary()).fill_null(b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if big else np.int32, n + 1, column.offset * (8 if big else 4)).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.BinaryArray:
    """Stretches of ``data`` as a binary column."""
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(lengths, out=offsets[1:])
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)
    out = np.ascontiguousarray(data[at])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(out)]).cast(pa.binary())


def matrix(column, width: int, right: bool = False) -> np.ndarray:
    """A binary column as rows of ``width`` bytes, zero-padded at the right end, or with ``right`` at the left."""
    data, offsets = text_buffer(column)
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), width), dtype=np.uint8)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(data)) - np.repeat(offsets[:-1] - (width - sizes if right else 0), sizes)
    out[row, at] = data
    return out


def blocks(offsets: np.ndarray, most: int = 1 << 20):
    """Ranges of documents (first, last + 1) of about ``most`` bytes; a longer document stands alone."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document the index of its first word (one more than documents)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = SPACE[data]
    edge = np.empty(len(data) + 1, dtype=bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = space[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    edge[cuts] = True
    starts = np.flatnonzero(edge[:-1] & ~space)
    edge[1:-1] = space[1:]
    edge[cuts] = True
    ends = np.flatnonzero(edge[1:] & ~space) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    out = np.empty(len(starts), dtype=U64)
    a, n = 0, len(starts)
    while a < n:
        b = int(np.searchsorted(starts, starts[a] + BLOCK, "left"))
        lo, hi = int(starts[a]), int(min(ends[b - 1], starts[a] + _SIZE - 1))
        total = np.zeros(hi - lo + 1, dtype=U64)
        np.cumsum(_BYTE[data[lo:hi]] * _POW[: hi - lo], out=total[1:])
        s, e = starts[a:b] - lo, np.minimum(ends[a:b] - lo, hi - lo)
        out[a:b] = mix((total[e] - total[s]) * _INV[s])
        a = b
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word windows within documents, and each document's first window.

    A document with 1 to ``width - 1`` words has one window: all its words.
    """
    counts = np.diff(first)
    n = len(hashes)
    if n >= width:
        h = np.zeros(n - width + 1, dtype=U64)
        for j in range(width):
            h += hashes[j : n - width + 1 + j] * _WORD_MUL[j]
        h = mix(h)
    else:
        h = np.zeros(0, dtype=U64)
    per = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    begin = np.zeros(len(first), dtype=np.int64)
    np.cumsum(per, out=begin[1:])
    out = np.empty(int(begin[-1]), dtype=U64)
    full = counts >= width
    keep = np.repeat(full, per)
    at = np.arange(int(begin[-1])) - np.repeat(begin[:-1] - first[:-1], per)
    out[keep] = h[at[keep]]
    for d in np.flatnonzero((counts > 0) & ~full):
        own = hashes[first[d] : first[d + 1]]
        out[begin[d]] = int(mix((own * _WORD_MUL[: len(own)]).sum(dtype=U64, keepdims=True) + U64(len(own)))[0])
    return out, begin
