"""Quality rules: a decision list learned by sequential covering.

Rules are conjunctions of thresholds on a text's statistics.  One rule at a
time is grown on part of the labelled rows by information gain, pruned on the
rest, and the rows that it covers are taken out.  The list is emitted as one
ordered conditional Spark expression.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.llm import kernels as K
from lumenframe.llm.shared import prepare, with_text_columns

#: Labelled rows that the rules are learned from at most; those with the smallest hash of their id.
SAMPLE = 20_000
#: A rule must be right on this share of the rows it covers, grown or held back, and cover so many.
LEAST_PRECISION, LEAST_COVER, MOST_RULES, MOST_TERMS = 0.9, 5, 20, 4
SYMBOLS = np.zeros(256, dtype=np.int64)
SYMBOLS[list(b"#*$%&|<>")] = 1
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def count(column) -> np.ndarray:
    """COUNTS of each text, as rows."""
    data, offsets = K.text_buffer(column)
    out = np.zeros((len(offsets) - 1, len(COUNTS)), dtype=np.int64)
    for a, b in K.blocks(offsets):
        part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, first = K.word_bounds(part, own)
        out[a:b, 0] = np.diff(first)
        for i, marks in ((1, ~K.SPACE[part] & (part & 0xC0 != 0x80)), (2, SYMBOLS[part])):
            total = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
            out[a:b, i] = total[own[1:]] - total[own[:-1]]
        hashes = K.word_hashes(part, starts, ends)
        windows, begin = K.shingles(hashes, first, WINDOW)
        for d in range(b - a):
            lines = [x for x in part[own[d] : own[d + 1]].tobytes().split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
            out[a + d, 3] = len(lines) - len(set(lines))
            h = windows[begin[d] : begin[d + 1]]
            if len(h) > 1:
                o = np.argsort(h)
                same = h[o][1:] == h[o][:-1]
                if same.any():
                    twice = np.zeros(len(h) + 1, dtype=bool)
                    twice[:-1][o[1:][same]] = True
                    twice[:-1][o[:-1][same]] = True
                    at = np.zeros(len(h) + WINDOW, dtype=np.int32)
                    where = np.flatnonzero(twice)
                    at[where] += 1
                    at[where + WINDOW] -= 1
                    out[a + d, 4] = int((np.cumsum(at) > 0).sum())
    return out


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with COUNTS of each whole text (null: none); old columns of these names are replaced, others may have any names."""
    prepare(docs.sparkSession)

    def counted(column: pa.Array) -> list[pa.Array]:
        found = count(column)
        return [pa.array(np.ascontiguousarray(found[:, i])) for i in range(len(COUNTS))]

    return with_text_columns(docs, text, counted, [T.StructField(c, T.LongType()) for c in COUNTS])


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


#: Statistics that thresholds are put on, by name.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1L)",
    "chars_per_word": "word_chars / greatest(n_words, 1L)",
    "dup_lines_per_word": "n_dup_lines / greatest(n_words, 1L)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1L)",
}


@dataclass(frozen=True)
class Term:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


def _covers(rule: tuple[Term, ...], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, dtype=bool)
    for term in rule:
        out &= term.holds(x)
    return out


def _best_term(x: dict[str, np.ndarray], y: np.ndarray, covered: np.ndarray) -> tuple[float, Term | None]:
    """The term of greatest gain p * (log p/(p+n) - log P/(P+N)) over all thresholds between values."""
    p_all, n_all = int(y[covered].sum()), int(covered.sum())
    best, term = 1e-9, None
    for feature in FEATURES:
        v, own = x[feature][covered], y[covered]
        o = np.argsort(v, kind="stable")
        v, own = v[o], own[o]
        cut = np.flatnonzero(v[1:] != v[:-1])
        if not len(cut):
            continue
        p_low, n_low = np.cumsum(own)[cut], cut + 1
        for above, p, n in ((False, p_low, n_low), (True, p_all - p_low, n_all - n_low)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / n) - log2(p_all / n_all)), -1.0)
            i = int(gain.argmax())
            if gain[i] > best and n[i] >= min(LEAST_COVER, p_all):
                best, term = float(gain[i]), Term(feature, above, float((v[cut[i]] + v[cut[i] + 1]) / 2))
    return best, term


def learn(x: dict[str, np.ndarray], y: np.ndarray, seed: int = 7) -> list[tuple[Term, ...]]:
    """Ordered rules that reject; ``y`` is 1 for rows to reject.  No such rows, no rules."""
    rng = np.random.default_rng(seed)
    rules: list[tuple[Term, ...]] = []
    left = np.ones(len(y), dtype=bool)
    while left.any() and y[left].any() and len(rules) < MOST_RULES:
        grow = left & (rng.random(len(y)) < 2 / 3)
        prune = left & ~grow
        rule: tuple[Term, ...] = ()
        while len(rule) < MOST_TERMS:
            covered = grow & _covers(rule, x, len(y))
            if not y[covered].any() or y[covered].all():
                break
            _, term = _best_term(x, y, covered)
            if term is None:
                break
            rule = (*rule, term)

        def worth(r: tuple[Term, ...], prune=prune) -> float:
            covered = prune & _covers(r, x, len(y))
            p, n = int(y[covered].sum()), int(covered.sum())
            return (2 * p - n) / n if n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        covered = left & _covers(rule, x, len(y))
        if not rule or covered.sum() < LEAST_COVER or y[covered].mean() < LEAST_PRECISION:
            break
        held = prune & covered
        if held.any() and y[held].mean() < LEAST_PRECISION:
            break
        rules.append(rule)
        left &= ~covered
    return rules


def verdict(rules: list[tuple[Term, ...]]) -> Column:
    """The decision list: the first rule that holds rejects; else the text is kept."""
    out = None
    for rule in rules:
        holds = rule[0].column()
        for term in rule[1:]:
            holds = holds & term.column()
        out = F.when(holds, F.lit(False)) if out is None else out.when(holds, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[tuple[Term, ...]]:
    """Rules learned from up to ``sample`` labels (quality 0 is to be rejected) of documents that pass the base rules.

    Of rows that share a labelled id one counts: that with the smallest
    statistics.  Null ids and labels are left out.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("labelled_id"), F.col("quality").cast("int").alias("quality_label")).where("labelled_id is not null and quality_label is not null").distinct()
    own = own.orderBy(F.xxhash64("labelled_id"), "labelled_id", "quality_label").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # At most ``sample`` pairs of numbers are broadcast.
    rows = with_counts(texts.join(F.broadcast(own), texts["doc_id"] == own["labelled_id"]).select("text", "labelled_id", "quality_label"))
    rows = rows.where(~base_failed()).select("labelled_id", "quality_label", F.struct(*(F.expr(e).alias(c) for c, e in FEATURES.items())).alias("x"))
    # One row for each label, so at most ``sample`` reach the driver, which sorts them: order does not depend on the partitioning.
    found = rows.groupBy("labelled_id", "quality_label").agg(F.min("x").alias("x")).select("x", "quality_label").collect()
    found.sort(key=lambda r: (tuple(r["x"]), r["quality_label"]))
    x = {c: np.array([r["x"][c] for r in found], dtype=float) for c in FEATURES}
    y = np.array([int(r["quality_label"] == 0) for r in found], dtype=np.int64)
    return learn(x, y)


def judge(docs: DataFrame, rules: list[tuple[Term, ...]]) -> DataFrame:
    """``docs`` with COUNTS, base_failed and kept.

    Base: fewer than 10 words, or over a fifth of the words in repeated
    windows.  Null and empty texts have no words and fail.  Repeated rows are
    judged alike; an empty table gives no rows.
    """
    judged = with_counts(docs).withColumn("base_failed", base_failed())
    return judged.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(rules)))
