import zlib

import numpy as np
import pyarrow as pa
import pytest

from lumenframe.llm import toxicity as X

DATA = "/root/testdata/sf0.01"


def area(score, label):
    """Area under the ROC curve; ties count half."""
    pos, neg = score[label == 1], score[label == 0]
    return np.mean([(p > neg).mean() + 0.5 * (p == neg).mean() for p in pos])


def wanted_features(texts):
    """(text, feature) of every n-gram of characters, by looking at each."""
    want = set()
    for d, t in enumerate(texts):
        own = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for n in X.SIZES:
            for i in range(len(own) - n + 1):
                held = 0
                for c in own[i : i + n]:
                    held = (held * int(X._BASE) + int.from_bytes(c.encode())) % 2**64
                want.add((d, held * int(X._MUL[n]) % 2**64 >> 64 - X.BITS))
    return want


@pytest.mark.parametrize("segment", [1 << 20, 50])
def test_features_against_brute_force(monkeypatch, segment):
    monkeypatch.setattr(X, "SEGMENT", segment)
    texts = ["", None, "ab", "Abc", "abcabcabc", "é" * 9, "xyz abc xyz", "中文字符测试", "a😀b中é" * 40, "Ж" * 3 + "word " * 30]
    real = X.K.blocks
    monkeypatch.setattr(X.K, "blocks", lambda offsets: real(offsets, segment))
    doc, feature = X.features(pa.array(texts))
    got = sorted(zip(doc.tolist(), feature.tolist(), strict=True))
    want = wanted_features(texts)
    assert got == sorted(want)
    groups = [0, 1, 0, 1, 0, 1, 1, 0, 1, 0]
    counts = X.document_counts(pa.array(texts), np.array(groups), 2)
    for g in (0, 1):
        found = np.bincount([f for d, f in want if groups[d] == g], minlength=1 << X.BITS)
        assert (counts[g] == found).all()


def test_the_fit_is_the_least_loss(spark):
    """Distributed counts, picked features and the fitted weights, against the plain sums and the gradient at the solution."""
    rng = np.random.default_rng(3)
    texts = [(i, " ".join(rng.choice(["fine", "good", "awful", "vile", "day"], 6)) + (" vile awful" if i % 3 == 0 else "")) for i in range(90)]
    labels = [(i, int(i % 3 == 0)) for i in range(90)]
    model = X.fit(spark.createDataFrame(texts, "doc_id long, text string").repartition(5), spark.createDataFrame(labels, "doc_id long, toxic int"))
    want = wanted_features([t for _, t in texts])
    y = np.array([t for _, t in labels])
    p, n = (np.bincount([f for d, f in want if y[d] == g], minlength=1 << X.BITS) for g in (1, 0))
    apart = (p / y.sum() - n / (1 - y).sum()) ** 2
    usable = (p + n >= X.LEAST_DOCS) & (apart > 0)
    ratio = np.log((p + 1) / (p.sum() + len(p))) - np.log((n + 1) / (n.sum() + len(n)))
    assert set(np.flatnonzero(model.weights)) <= set(np.flatnonzero(usable))
    share = np.where(y == 1, np.sqrt(30) / (np.sqrt(30) + np.sqrt(60)) / 30, np.sqrt(60) / (np.sqrt(30) + np.sqrt(60)) / 60)
    rows = np.zeros((90, 1 << X.BITS), dtype=bool)
    for d, f in want:
        rows[d, f] = True
    z = rows @ model.weights + model.intercept
    error = share * (1 / (1 + np.exp(-z)) - y)
    gradient = (rows.T.astype(float) @ error)[usable] * ratio[usable] + X.PENALTY * (model.weights[usable] / ratio[usable])
    assert np.abs(gradient).max() < 1e-3 and abs(error.sum()) < 1e-3


def test_repeated_ids_count_once(spark):
    docs = [(1, f"bad text number {i}") for i in range(50)] + [(i, f"good words {i}") for i in range(2, 20)]
    labels = spark.createDataFrame([(1, 1), *((i, 0) for i in range(2, 20))], "doc_id long, toxic int")
    seen = []
    real = X.stored
    with pytest.MonkeyPatch.context() as m:
        m.setattr(X, "stored", lambda df: seen.append((out := real(df)).count()) or out)
        X.fit(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), labels)
    assert seen[0] == 19


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    out = X.score_documents(docs, labels)
    rows = out.collect()
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    return docs.count(), rows, truth


def test_every_row_and_the_split(scored):
    n, rows, _ = scored
    assert len(rows) == n
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_held_out_accuracy(scored):
    _, rows, truth = scored
    own = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    score, label = np.array([r["score"] for r in own]), np.array([truth[r["doc_id"]] for r in own])
    assert label.sum() >= 5
    assert area(score, label) > 0.95
    assert (np.array([r["predicted"] for r in own]) == label).mean() > 0.95


def test_labels_held_out_are_never_learned(spark):
    docs = spark.createDataFrame([(i, f"text number {i} " + ("awful" if i % 2 else "fine")) for i in range(60)], "doc_id long, text string")
    labels = [(i, i % 2) for i in range(60)]
    turned = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels]
    got = [sorted(tuple(r) for r in X.score_documents(docs, spark.createDataFrame(x, "doc_id long, toxic int")).collect()) for x in (labels, turned)]
    assert got[0] == got[1]
    assert all(r[3] == r[0] % 2 for r in got[0])


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a"), (1, None), (1, ""), (2, "x" * 200_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = X.score_documents(docs, none).collect()
    assert len(rows) == 4 and all(r["predicted"] == 0 for r in rows)
    assert X.score_documents(docs.limit(0), none).collect() == []
    one = spark.createDataFrame([(2, 1), (None, 0), (1, None)], "doc_id long, toxic int")
    assert len(X.score_documents(docs, one).collect()) == 4
