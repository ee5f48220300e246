import hashlib
import random

import numpy as np
import pytest

from lumenframe.llm import suffix_dedup as S

DATA = "/root/testdata/sf0.001"


def brute(docs, length):
    """{doc index: (n_bytes, n_removed, n_spans, sha)} by looking at every string."""
    least = {}
    raw = [(d, (t or "").encode()) for d, t in docs]
    for d, t in raw:
        if d is not None:
            for i in range(len(t) - length + 1):
                s = t[i : i + length]
                if s not in least or d < least[s]:
                    least[s] = d
    out = []
    for d, t in raw:
        gone = np.zeros(len(t) + 2, dtype=np.int8)
        if d is not None:
            for i in range(len(t) - length + 1):
                if least[t[i : i + length]] < d:
                    gone[i + 1 : i + 1 + length] = 1
        kept = bytes(b for b, g in zip(t, gone[1:-1], strict=True) if not g)
        out.append((d, len(t), int(gone.sum()), int((np.diff(gone) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def run(spark, docs, length):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = S.repeated_strings(df, length).collect()
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows), key=repr), rows


def fixture(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé ") for _ in range(rng.randrange(1, 5)))
    passages = [" ".join(word() for _ in range(rng.randrange(5, 60))) for _ in range(6)]
    docs = []
    for d in range(n):
        parts = []
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            parts.append(rng.choice([p, p[a:], p[:a], " ".join(word() for _ in range(20))]))
        docs.append((d, "".join(parts)))
    docs += [(3, docs[3][1]), (5, "another text with the same id " * 3), (None, docs[7][1]), (n, None), (n + 1, ""), (n + 2, "x" * 400), (n + 3, "x" * 300), (n + 4, docs[9][1])]
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    docs = fixture(seed)
    got, _ = run(spark, docs, 50)
    assert got == brute(docs, 50)
    assert sum(r[2] for r in got) > 0


def test_small_buckets_compare_across_boundaries(spark, monkeypatch):
    monkeypatch.setattr(S, "SUFFIXES", 15)
    monkeypatch.setattr(S, "BUCKET", 200)
    monkeypatch.setattr(S, "SEGMENT", 150)
    docs = fixture(3)
    got, _ = run(spark, docs, 50)
    assert got == brute(docs, 50)


def test_on_documents(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    docs = [(r[0], r[1]) for r in rows]
    got, full = run(spark, docs, 50)
    assert got == brute(docs, 50)
    for r in full:
        assert r["kept_text"].encode().decode() == r["kept_text"]


def test_empty(spark):
    assert run(spark, [], 50)[0] == []


def test_multikey_order_sorts():
    rng = np.random.default_rng(5)
    words = rng.integers(0, 3, (5000, 4)).astype(np.uint64)
    got = words[S.multikey_order(words)]
    assert (got == words[np.lexsort(words.T[::-1])]).all()


def test_long_runs_are_taken_in_pieces(spark):
    docs = [(0, "ab" * 700_000), (1, "x" + "ab" * 100 + "y" * 60), (2, "ab" * 700_000 + "z")]
    got, _ = run(spark, docs, 50)
    assert [r[:4] for r in got] == [(0, 1_400_000, 0, 0), (1, 261, 200, 1), (2, 1_400_001, 1_400_000, 1)]


@pytest.mark.parametrize("seed", [4, 5])
def test_second_level_of_splitters(spark, monkeypatch, seed):
    monkeypatch.setattr(S, "RANGES", 3)
    monkeypatch.setattr(S, "BUCKET", 100)
    monkeypatch.setattr(S, "SUFFIXES", 20)
    docs = fixture(seed)
    got, _ = run(spark, docs, 50)
    assert got == brute(docs, 50)


def test_common_strings_in_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(S, "SUFFIXES", 10)
    monkeypatch.setattr(S, "HITS", 7)
    line = "one very common line that is found in nearly every text of a table "
    docs = [(d, f"own {d} " + line * (d % 5 + 1) + f"end {d % 7}") for d in range(120)] + [(200, "-" * 300 + line), (201, "-" * 200), (202, "-" * 250 + line * 2)]
    got, _ = run(spark, docs, 50)
    assert got == brute(docs, 50)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    kept = []
    real = S.stored
    monkeypatch.setattr(S, "stored", lambda x: kept.append(out := real(x)) or out)
    S.repeated_strings(df, 50).collect()
    flags = next(x for x in kept if "hits" in x.columns).where("mask is null")
    # A string at an edge is one row in each bucket, but for lists of more than HITS places.
    assert flags.groupBy("low", "high", "doc_id").count().where("count > 100").count() == 0


def test_other_columns_may_have_any_names(spark):
    docs = [(d, t) for d, t in fixture(6) if d is not None][:40]
    names = ["digest", "hashes", "copy", "marks", "row_id", "rest", "pos", "mask", "low", "head", "n", "a.b", "back", "suffix", "words"]
    rows = [(d, t, *(f"{c}{i}" for c in names)) for i, (d, t) in enumerate(docs)]
    df = spark.createDataFrame(rows, ["doc_id", "text", *names])
    found = S.repeated_strings(df.withColumn("n_bytes", S.F.lit("old"))).collect()
    assert found[0].__fields__ == ["doc_id", *names, *S.RESULTS]
    assert sorted(tuple(r)[: len(names) + 1] for r in found) == sorted((r[0], *r[2:]) for r in rows)
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found), key=repr) == brute(docs, 50)
