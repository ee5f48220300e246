"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

Features are the n-grams of characters (A-Z lower-cased) that a text has, hashed.
Each is scaled by the log ratio of its share in toxic and other training texts;
a logistic regression with an L2 penalty is fit on the scaled features that tell
the classes apart best.  Tasks count their own texts' features; Spark sums the
counts and picks the features; one task fits the model on what is left of the
training texts, a list of small numbers for each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.llm import kernels as K
from lumenframe.llm.shared import map_arrow, prepare, released, stored, with_text_columns
from lumenframe.llm.suffix_dedup import words_at

SIZES = (4, 5, 6, 7)
BITS = 20
#: Training texts of each class at most; those with the smallest hash of their id.
SAMPLE = 4000
FEATURES = 8192
LEAST_DOCS = 3
PENALTY = 1e-3
STEPS = 200
#: Bytes of a very long text that are looked at together.
SEGMENT = 1 << 20
_MUL = {n: np.uint64(m) for n, m in zip(SIZES, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93), strict=True)}
_BASE = np.uint64(0x2127599BF4325C37)


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters of texts, each as the number that its UTF-8 bytes make, and the offsets of texts among them."""
    lead = data & 0xC0 != 0x80
    lead[offsets[:-1][np.diff(offsets) > 0]] = True
    at = np.flatnonzero(lead)
    sizes = np.minimum(np.diff(np.append(at, len(data))), 8).astype(np.uint64)
    return words_at(data)[at] >> (np.uint64(64) - np.uint64(8) * sizes), np.searchsorted(at, offsets)


def grams(chars: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each size the feature of the n-gram that starts at each character; the last ones of a text run over its end."""
    held = chars
    for j in range(1, max(SIZES)):
        held = held * _BASE
        held[: len(chars) - j] += chars[j:]
        if j + 1 in SIZES:
            yield j + 1, (held * _MUL[j + 1] >> np.uint64(64 - BITS)).astype(np.int64)


def _parts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, Iterable[tuple[np.ndarray, np.ndarray]]]]:
    """Ranges of texts with their characters; a very long text comes alone, in segments that overlap by more than an n-gram."""
    for a, b in K.blocks(offsets):
        part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        if len(part) <= SEGMENT:
            yield a, b, [characters(K.LOWER[part], own)]
            continue

        def whole(at: int) -> int:
            """The next place between characters."""
            while at < len(part) and part[at] & 0xC0 == 0x80:
                at += 1
            return min(at, len(part))

        cuts = [0]
        while cuts[-1] + SEGMENT < len(part):
            cuts.append(whole(cuts[-1] + SEGMENT))
        ends = [whole(c + 8 * max(SIZES)) for c in cuts[1:]] + [len(part)]
        segments = (K.LOWER[part[c:e]] for c, e in zip(cuts, ends, strict=True))
        yield a, b, (characters(x, np.array([0, len(x)])) for x in segments)


def feature_blocks(column, wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct (text, feature) pairs, sorted, a block of texts at a time; with ``wanted`` (a mark for each feature) only those marked."""
    data, offsets = K.text_buffer(column)
    for a, _, parts in _parts(data, offsets):
        found = np.zeros(0, dtype=np.int64)
        for chars, own in parts:
            pairs = [found]
            for n, ids in grams(chars):
                at = np.arange(len(ids)) if wanted is None else np.flatnonzero(wanted[ids])
                doc = np.searchsorted(own, at, "right") - 1
                inside = at + n <= own[doc + 1] if len(at) else np.zeros(0, dtype=bool)
                pairs.append((doc[inside] + a) << BITS | ids[at[inside]])
            found = np.unique(np.concatenate(pairs))
        yield found >> BITS, found & ((1 << BITS) - 1)


def document_counts(column, groups: np.ndarray, most: int) -> np.ndarray:
    """For each group (0 to ``most - 1``, a number for each text) how many of its texts have each feature."""
    data, offsets = K.text_buffer(column)
    out = np.zeros((most, 1 << BITS), dtype=np.int64)
    seen = np.zeros(1 << BITS, dtype=bool)
    for a, b, parts in _parts(data, offsets):
        for chars, own in parts:
            ids = list(grams(chars))
            for d in range(len(own) - 1):
                for n, x in ids:
                    seen[x[own[d] : max(own[d], own[d + 1] - n + 1)]] = True
                if b - a > 1 or len(own) > 2:
                    found = np.flatnonzero(seen)
                    out[groups[a + d], found] += 1
                    seen[found] = False
        if seen.any():
            out[groups[a], seen] += 1
            seen[:] = False
    return out


def features(column, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of ``feature_blocks``."""
    found = [(np.zeros(0, dtype=np.int64),) * 2, *feature_blocks(column, wanted)]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


@dataclass
class Model:
    """Weights by feature, and the intercept; no features: the share of toxic texts."""

    weights: np.ndarray
    intercept: float

    def scores(self, column) -> np.ndarray:
        doc, feature = features(column, self.weights != 0)
        z = self.intercept + np.bincount(doc, self.weights[feature], len(column))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def minimise(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int = STEPS, memory: int = 10) -> np.ndarray:
    """Limited-memory BFGS with a backtracking line search, for smooth convex ``loss`` (value, gradient)."""
    value, gradient = loss(x)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        if np.abs(gradient).max(initial=0) < 1e-6:
            break
        way, kept = -gradient, []
        for s, y, rho in reversed(pairs):
            kept.append(rho * (s @ way))
            way = way - kept[-1] * y
        if pairs:
            s, y, rho = pairs[-1]
            way = way / (rho * (y @ y))
        for (s, y, rho), a in zip(pairs, reversed(kept), strict=True):
            way = way + s * (a - rho * (y @ way))
        slope = float(gradient @ way)
        step = 1.0 if pairs else 1.0 / max(1.0, float(np.abs(gradient).sum()))
        while True:
            new = x + step * way
            new_value, new_gradient = loss(new)
            if new_value <= value + 1e-4 * step * slope or step < 1e-12:
                break
            step /= 2
        s, y = new - x, new_gradient - gradient
        if value - new_value <= 1e-10 * max(1.0, abs(value)):
            return new if new_value < value else x
        if (curve := float(s @ y)) > 1e-12:
            pairs = [*pairs[1 - memory :], (s, y, 1 / curve)] if len(pairs) >= memory else [*pairs, (s, y, 1 / curve)]
        x, value, gradient = new, new_value, new_gradient
    return x


def fitted(doc: np.ndarray, col: np.ndarray, toxic: np.ndarray, ratio: np.ndarray, shares: tuple[float, float]) -> tuple[np.ndarray, float]:
    """Weights of the features and the intercept, from (text, feature) pairs, labels of texts, log ratios of features, and weights of the classes."""
    x, r = ratio[col], len(ratio)
    pos, neg = int(toxic.sum()), int(len(toxic) - toxic.sum())
    share = np.where(toxic == 1, shares[0] / pos, shares[1] / neg)

    def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(doc, x * v[col], len(toxic)) + v[-1]
        error = share * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - toxic)
        value = float((share * (np.logaddexp(0, z) - toxic * z)).sum()) + PENALTY / 2 * float(v[:-1] @ v[:-1])
        return value, np.append(np.bincount(col, x * error[doc], r) + PENALTY * v[:-1], error.sum())

    start = np.zeros(r + 1)
    start[-1] = np.log(shares[0] / shares[1])
    found = minimise(loss, start)
    return found[:-1] * ratio, float(found[-1])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, neg, pos): how many of a task's texts of either class have it."""
    total = np.zeros((2, 1 << BITS), dtype=np.int64)
    for batch in batches:
        if batch.num_rows:
            total += document_counts(batch.column(0), np.asarray(batch.column(1)), 2)
    at = np.flatnonzero(total.any(axis=0))
    for i in range(0, len(at), 50_000):
        part = at[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[0, part]), pa.array(total[1, part])], names=["feature", "neg", "pos"])


def _sparse(batch: pa.RecordBatch, number: np.ndarray) -> pa.RecordBatch:
    """(key, toxic, columns): the picked features of each text as 16-bit numbers."""
    doc, feature = features(batch.column(0), number >= 0)
    cuts = np.searchsorted(doc, np.arange(batch.num_rows + 1))
    column = number[feature].astype(np.uint16)
    return pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), pa.array([column[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], names=["key", "toxic", "columns"])


def _fit_task(batches: Iterator[pa.RecordBatch], ratio: np.ndarray, shares: tuple[float, float]) -> Iterator[pa.RecordBatch]:
    toxic, columns = [], []
    for batch in batches:
        toxic += batch.column(1).to_pylist()
        columns += [np.frombuffer(x, np.uint16) for x in batch.column(2).to_pylist()]
    if toxic:
        doc = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
        weights, intercept = fitted(doc, np.concatenate(columns).astype(np.int64), np.array(toxic, dtype=np.int64), ratio, shares)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(len(weights)), -1)), pa.array(np.append(weights, intercept))], names=["number", "weight"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from up to ``sample`` labelled documents of each class.

    ``labels`` (doc_id, toxic) holds training rows only; null ids and labels
    are left out.  Of rows that share a labelled id one text counts, that with
    the smallest digest.  The classes weigh as the square roots of their counts
    over all of ``labels``, so that the rare one is heard.  With labels of one
    class, or none, every score is the same.  Texts stay in their tasks; the
    task that fits holds at most 2 * ``sample`` lists of at most FEATURES
    16-bit numbers, the driver FEATURES rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    own = labels.select(F.col("doc_id").cast("long").alias("labelled_id"), (F.col("toxic") == 1).cast("int").alias("toxic_label")).where("labelled_id is not null and toxic_label is not null").distinct()
    counts = {r["toxic_label"]: r["n"] for r in own.groupBy("toxic_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = [own.where(F.col("toxic_label") == t).orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(sample) for t in (0, 1)]
    picked = picked[0].unionByName(picked[1])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # At most twice ``sample`` pairs of numbers are broadcast.
    rows = texts.join(F.broadcast(picked), texts["doc_id"] == picked["labelled_id"])
    rows = rows.groupBy("labelled_id", "toxic_label").agg(F.min_by("text", F.md5(F.col("text").cast("binary"))).alias("text"))
    rows = stored(rows.select("text", "toxic_label", "labelled_id"))
    seen = {r["toxic_label"]: r["n"] for r in rows.groupBy("toxic_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = seen.get(1, 0), seen.get(0, 0)
    weights = np.zeros(1 << BITS)
    if not pos or not neg:
        released(spark, rows)
        share = (pos + 0.5) / (pos + neg + 1) if pos or neg else 0.25
        return Model(weights, float(np.log(share / (1 - share))))
    found = stored(rows.mapInArrow(_counted, "feature long, neg long, pos long").groupBy("feature").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")))
    total = found.agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")).first()
    total = {c: float((total[c] or 0) + (1 << BITS)) for c in ("neg", "pos")}
    both = F.col("pos") + F.col("neg")
    apart = F.pow(F.col("pos") / pos - F.col("neg") / neg, F.lit(2)) / (both / (pos + neg))
    best = found.where(both >= min(LEAST_DOCS, pos)).select("feature", "neg", "pos", apart.alias("apart")).where("apart > 0")
    best = best.orderBy(F.desc("apart"), "feature").limit(FEATURES).collect()
    ratio = np.array([np.log((r["pos"] + 1.0) / total["pos"]) - np.log((r["neg"] + 1.0) / total["neg"]) for r in best])
    number = np.full(1 << BITS, -1, dtype=np.int32)
    number[[r["feature"] for r in best]] = np.arange(len(best))
    shipped = spark.sparkContext.broadcast(number)
    weigh = sqrt(counts.get(1, 0)), sqrt(counts.get(0, 0))
    shares = weigh[0] / sum(weigh), weigh[1] / sum(weigh)
    sparse = map_arrow(rows, lambda batch: _sparse(batch, shipped.value), "key long, toxic int, columns binary").repartition(1).sortWithinPartitions("key", "toxic")
    solved = sparse.mapInArrow(lambda batches: _fit_task(batches, ratio, shares), "number long, weight double").collect()
    intercept = 0.0
    for r in solved:
        if r["number"] < 0:
            intercept = r["weight"]
        else:
            weights[best[r["number"]]["feature"]] = r["weight"]
    released(spark, rows, found)
    return Model(weights, intercept)


_MODELS: dict[tuple, Model] = {}


def _model(parts) -> Model:
    """One model for each worker process and set of weights."""
    key = (parts[0].tobytes(), parts[1].tobytes(), parts[2])
    if key not in _MODELS:
        _MODELS.clear()
        weights = np.zeros(1 << BITS)
        weights[parts[0]] = parts[1]
        _MODELS[key] = Model(weights, parts[2])
    return _MODELS[key]


def with_scores(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with ``score`` of each whole text (null counts as empty): 0 to 1, higher for toxic.  No shuffle.

    Other columns may have any names; an old ``score`` is replaced.
    """
    prepare(docs.sparkSession)
    at = np.flatnonzero(model.weights)
    shipped = docs.sparkSession.sparkContext.broadcast((at, model.weights[at], model.intercept))
    return with_text_columns(docs, text, lambda column: [pa.array(_model(shipped.value).scores(column))], [T.StructField(score, T.DoubleType())])


def held_out(doc_id: str = "doc_id"):
    """Whether a row's label may not be learned from; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted; learned from labels that are not held out."""
    docs = docs.select("doc_id", "text")
    model = fit(docs, labels.where(~held_out()))
    scored = with_scores(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
