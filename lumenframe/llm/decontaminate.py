"""Benchmark passages in documents, by CGK embedding and bit sampling.

Texts are sequences of words.  The CGK walk (Chakraborty, Goldenberg, Koucky)
reads a window with random pauses: at step j it shows the word it stands on and
a random bit of (j, word) tells whether it moves on.  Two windows walked with the
same bits resynchronise after an edit, so few edits mean few differing steps.
Each repetition samples SAMPLED steps; windows that agree with a window of an
item there are candidates, and the exact edit distance decides.  Before it, a
candidate whose stretch has too few runs of 1, 2 and 3 words of the items is left
out: ``k`` edits spare ``n - q + 1 - q * k`` of an item's runs of ``q`` words at least.

Windows are as long as the item's size class, which is at most half of the item
but for the shortest.  Those of documents start at every ``stride``-th word and
those of items at every word, so an unedited stretch of an item always meets its
like.  Repetitions are many and each occurrence offers several windows, which
brings recall to the target (measured in the tests).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.llm import kernels as K
from lumenframe.llm.shared import prepare, stored, with_text_columns

#: Edits allowed for each word of an item.
RATIO = 0.2
REPETITIONS, SAMPLED = 24, 6
#: Size classes: words of a window, words between window starts in documents, least words of an item (several times their sum
#: for long ones, so that an occurrence that lost a fifth of its words to cuts still offers windows with few edits).
CLASSES = ((32, 8, 160), (16, 8, 64), (8, 4, 14), (4, 1, 5), (2, 1, 2), (1, 1, 1))
#: Items that are searched for in one pass, and about the characters that they may have together.
ITEMS, ITEM_BYTES = 5000, 16 << 20
_TABLE = 16
_RUNS = (1, 2, 3)
_CHUNK = 1 << 15
_RNG = np.random.default_rng(4242)
_BITS = {n: _RNG.integers(1, 2**63, (REPETITIONS, 2 * n), dtype=np.uint64) | np.uint64(1) for n, *_ in CLASSES}
_STEPS = {n: [np.sort(_RNG.choice(2 * n, min(SAMPLED, 2 * n), replace=False)) for _ in range(REPETITIONS)] for n, *_ in CLASSES}
_FOLD = np.uint64(0x9E3779B97F4A7C15)


def _walk(words: np.ndarray, starts: np.ndarray, size: int, repetition: int, tables: list[np.ndarray] | None = None) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Keys of the sampled steps of windows; with ``tables`` windows that no item can agree with are left on the way.

    ``words`` holds ``size`` zeros beyond the last window's start.  Also returns
    the keys after each sampled step, and which windows are left.
    """
    bits, steps = _BITS[size][repetition], _STEPS[size][repetition]
    at, key, left, trail = starts, np.zeros(len(starts), dtype=np.uint64), np.arange(len(starts)), []
    end = starts + size
    step = 0
    for k, target in enumerate(steps):
        while True:
            word = words[at]
            if 2 * step >= size:
                word = np.where(at < end, word, np.uint64(0))
            if step == target:
                break
            at = at + ((word * bits[step]) >> np.uint64(63)).astype(np.int64)
            if 2 * step >= size:
                at = np.minimum(at, end)
            step += 1
        key = K.mix(key * _FOLD + word)
        trail.append(key)
        if tables is not None:
            keep = np.flatnonzero(tables[k][(key >> np.uint64(64 - _TABLE)).astype(np.int64)])
            at, key, left, end = at[keep], key[keep], left[keep], end[keep]
            if not len(left):
                break
    return key, trail, left


def _runs(words: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all runs of ``q`` words."""
    n = max(len(words) - q + 1, 0)
    return reduce(np.add, (words[j : n + j] * K._WORD_MUL[j] for j in range(q)))


class Index:
    """Windows of items by class and repetition; made once in each worker."""

    def __init__(self, items: list[tuple[int, str]], ratio: float = RATIO):
        self.items = [(i, t or "") for i, t in items]
        data, offsets = K.text_buffer(pa.array([t.encode("utf-8", "surrogateescape") for _, t in self.items], pa.binary()))
        data = K.LOWER[data]
        starts, ends, first = K.word_bounds(data, offsets)
        hashes = K.word_hashes(data, starts, ends)
        self.words = [hashes[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        self.sizes = np.array([len(w) for w in self.words], dtype=np.int64)
        self.most = np.array([int(ratio * len(w)) for w in self.words], dtype=np.int64)
        self.masks: dict[int, dict[int, int]] = {}
        # Of each item the longest runs that must occur, and how often.
        self.own = []
        for words, n, most in zip(self.words, self.sizes.tolist(), self.most.tolist(), strict=True):
            q = max((q for q in _RUNS if n - q + 1 - q * most > 0), default=1)
            self.own.append((q, n - q + 1 - q * most, frozenset(_runs(words, q).tolist())))
        # Runs of all items, by the first bits of their hashes: others may share them, none is left out.
        self.runs = []
        for q in _RUNS:
            runs = np.concatenate([np.zeros(0, dtype=np.uint64), *(_runs(w, q) for w in self.words)])
            shift = np.uint64(64 - min(max((16 * len(runs)).bit_length(), _TABLE), 26))
            table = np.zeros(1 << 64 - int(shift), dtype=bool)
            table[(runs >> shift).astype(np.int64)] = True
            self.runs.append((q, shift, table))
        self.classes = []
        for size, stride, least in CLASSES:
            mine = [i for i, w in enumerate(self.words) if len(w) and self._class(len(w)) == (size, stride, least)]
            if not mine:
                continue
            padded = np.concatenate([np.concatenate([self.words[i], np.zeros(size + 1, dtype=np.uint64)]) for i in mine])
            base, starts, owner, shift = 0, [], [], []
            for i in mine:
                n = len(self.words[i]) - size + 1
                starts.append(base + np.arange(n))
                owner.append(np.full(n, i))
                shift.append(np.arange(n))
                base += len(self.words[i]) + size + 1
            starts, owner, shift = (np.concatenate(x) for x in (starts, owner, shift))
            repetitions = []
            for r in range(REPETITIONS):
                key, trail, _ = _walk(padded, starts, size, r)
                tables = []
                for t in trail:
                    table = np.zeros(1 << _TABLE, dtype=bool)
                    table[(t >> np.uint64(64 - _TABLE)).astype(np.int64)] = True
                    tables.append(table)
                o = np.argsort(key, kind="stable")
                repetitions.append((tables, key[o], owner[o], shift[o]))
            self.classes.append((size, stride, repetitions))

    @staticmethod
    def _class(n: int) -> tuple[int, int, int]:
        return next(c for c in CLASSES if c[2] <= n)

    def candidates(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct candidates: items, and where each would start in the words of documents; ``words`` ends in zeros."""
        counts = np.diff(first)
        # An item and a place in one number; a start may lie before the first word.
        back = int(self.sizes.max(initial=0))
        span = len(words) + back
        found = [np.zeros(0, dtype=np.int64)]
        for size, stride, repetitions in self.classes:
            per = -(-counts // stride)
            begin = np.concatenate([[0], np.cumsum(per)])
            starts = np.repeat(first[:-1], per) + (np.arange(begin[-1]) - np.repeat(begin[:-1], per)) * stride
            for a in range(0, len(starts), _CHUNK):
                part = starts[a : a + _CHUNK]
                for r, (tables, keys, owner, shift) in enumerate(repetitions):
                    key, _, left = _walk(words, part, size, r, tables)
                    if not len(left):
                        continue
                    low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                    n = high - low
                    hit = np.repeat(low, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
                    found.append(owner[hit] * span + (part[np.repeat(left, n)] - shift[hit] + back))
        item, at = np.divmod(np.unique(np.concatenate(found)), span)
        return item, at - back

    def stretches(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Distinct (document, item, first word, last word + 1) in which the item of a candidate may lie."""
        item, at = self.candidates(words, first)
        if not len(item):
            return
        n, most = self.sizes[item], self.most[item]
        anchor, last = at + n // 2, len(first) - 2
        doc = np.searchsorted(first, np.maximum(at, 0), "right") - 1
        other = (at < 0) | (doc > last) | (anchor >= first[np.minimum(doc, last) + 1])
        doc = np.where(other, np.searchsorted(first, np.clip(anchor, 0, first[-1] - 1), "right") - 1, doc)
        low, high = np.maximum(first[doc], at - 2 * most - 1), np.minimum(first[doc + 1], at + n + 2 * most + 1)
        keep = high - low >= n - most
        runs = {q: _runs(words, q) for q in _RUNS}
        for q, shift, table in self.runs:
            known = np.concatenate([[0], np.cumsum(table[(runs[q] >> shift).astype(np.int64)])])
            keep &= known[np.maximum(low, high - q + 1)] - known[low] >= n - q + 1 - q * most
        for place in dict.fromkeys(zip(*(x[keep].tolist() for x in (doc, item, low, high)), strict=True)):
            _, i, lo, hi = place
            q, least, own = self.own[i]
            if sum(r in own for r in runs[q][lo : max(lo, hi - q + 1)].tolist()) >= least:
                yield place

    def distance(self, item: int, words: list[int]) -> int:
        """The least word edit distance of the item to any stretch of ``words`` (bit-parallel)."""
        pattern = self.words[item]
        n = len(pattern)
        if item not in self.masks:
            masks: dict[int, int] = {}
            for i, w in enumerate(pattern.tolist()):
                masks[w] = masks.get(w, 0) | 1 << i
            self.masks[item] = masks
        masks, full, top = self.masks[item], (1 << n) - 1, 1 << n - 1
        up, down, score, best = full, 0, n, n
        for w in words:
            eq = masks.get(w, 0)
            across = (((eq & up) + up) ^ up) | eq
            plus, minus = down | (~(across | up) & full), up & across
            if plus & top:
                score += 1
            elif minus & top:
                score -= 1
            plus, minus = (plus << 1) & full, (minus << 1) & full
            inside = eq | down
            up, down = minus | (~(inside | plus) & full), plus & inside
            best = min(best, score)
        return best

    def leaks(self, column) -> list[dict[int, int]]:
        """For each text the items found in it with their edit distance."""
        data, offsets = K.text_buffer(column)
        out: list[dict[int, int]] = [{} for _ in range(len(offsets) - 1)]
        for a, b in K.blocks(offsets):
            part, own = K.LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
            starts, ends, first = K.word_bounds(part, own)
            words = np.concatenate([K.word_hashes(part, starts, ends), np.zeros(max((c[0] for c in self.classes), default=0) + 1, dtype=np.uint64)])
            for doc, item, lo, hi in self.stretches(words, first):
                most = int(self.most[item])
                if out[a + doc].get(item, most + 1) == 0:
                    continue
                d = self.distance(item, words[lo:hi].tolist())
                if d <= most:
                    out[a + doc][item] = min(d, out[a + doc].get(item, d))
        return out


_INDEX: dict[tuple, Index] = {}


def _index(key: str, items: list[tuple[int, str]], ratio: float) -> Index:
    """One index for each worker process: that of the block it searches for."""
    if (key, ratio) not in _INDEX:
        _INDEX.clear()
        _INDEX[key, ratio] = Index(items, ratio)
    return _INDEX[key, ratio]


_LEAKS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("edits", T.LongType()), T.StructField("item_words", T.LongType())]))
_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int64()), ("item_words", pa.int64())]))


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The distinct items with a text, ITEMS of them or about ITEM_BYTES at a time."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct().orderBy("item_id", "text")
    held, size = [], 0
    for row in rows.toLocalIterator():
        held.append((row["item_id"], row["text"]))
        size += len(row["text"])
        if len(held) == ITEMS or size >= ITEM_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _searched(docs: DataFrame, items: list[tuple[int, str]], text: str, leaks: str, ratio: float) -> DataFrame:
    """``docs`` with the items of one block that are found in each text: one Python worker a task."""
    shipped = docs.sparkSession.sparkContext.broadcast(items)
    key = hashlib.sha256(repr(items).encode()).hexdigest()

    def found(column: pa.Array) -> list[pa.Array]:
        index = _index(key, shipped.value, ratio)
        rows = [[{"item_id": index.items[i][0], "edits": d, "item_words": len(index.words[i])} for i, d in sorted(x.items())] for x in index.leaks(column)]
        return [pa.array(rows, _ARROW)]

    return with_text_columns(docs, text, found, [T.StructField(leaks, _LEAKS)])


def with_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", leaks: str = "leaks", ratio: float = RATIO) -> DataFrame:
    """``docs`` with the column ``leaks``: the items of ``benchmark`` (item_id, text) found in the text.

    An item is found if some stretch of the text's words (``[^\\x20\\x09-\\x0D]+``,
    A-Z lower-cased) differs from the item's by at most ``ratio`` edits a word.
    Items without words are never found, nor is anything in null or empty texts.
    Repeated rows are judged alike.  Items are the query set: they reach the
    workers in blocks of ITEMS, and every row is read whole against each block.
    One block needs no shuffle.  Of several each is a scan of its own, and what
    they find is joined to the rows, so that a task never holds more than one
    block's index.  Other columns may have any names; an old ``leaks`` is replaced.
    """
    prepare(docs.sparkSession)
    docs = docs.drop(leaks)
    blocks = list(_blocks(benchmark))
    if not blocks:
        return docs.withColumn(leaks, F.array().cast(_LEAKS))
    if len(blocks) == 1:
        return _searched(docs, blocks[0], text, leaks, ratio)
    columns = docs.columns
    held = stored(docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row")).withColumn("row_id", F.monotonically_increasing_id()))
    texts = held.select("row_id", F.col("row").getField(text).alias("text"))
    found = reduce(DataFrame.unionByName, (_searched(texts, items, "text", "leaks", ratio).where(F.size("leaks") > 0).select("row_id", "leaks") for items in blocks))
    found = found.groupBy("row_id").agg(F.array_sort(F.flatten(F.collect_list("leaks"))).alias("leaks"))
    out = held.join(found, "row_id", "left")
    return out.select(*(F.col("row").getField(c).alias(c) for c in columns), F.coalesce("leaks", F.array().cast(_LEAKS)).alias(leaks))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item found in it: doc_id, item_id, edits, item_words; repeated rows repeat theirs.

    Blocks of items are scans beside each other: no shuffle however many there are.
    """
    prepare(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    none = docs.where("false").select("doc_id", F.explode(F.array().cast(_LEAKS)).alias("leak"))
    parts = [_searched(docs, items, "text", "leaks", RATIO).select("doc_id", F.explode("leaks").alias("leak")) for items in _blocks(benchmark)]
    found = reduce(DataFrame.unionByName, parts) if parts else none
    return found.select("doc_id", "leak.item_id", "leak.edits", "leak.item_words")
