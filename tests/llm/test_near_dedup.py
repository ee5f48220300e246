import math
import random
import re

import pytest

from lumenframe.llm import near_dedup as N

DATA = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs):
    sets = []
    for _, text in docs:
        w = words(text)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    up = list(range(len(docs)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    out = [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(docs)]
    return sorted(((*r, r[0] == r[2]) for r in out), key=repr)


def run(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return sorted((tuple(r)[:4] for r in N.near_duplicates(df).collect()), key=repr)


def fixture(seed, n=150):
    rng = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(300)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 8, 40, 120, 300]))] for _ in range(12)]
    docs = []
    for d in range(n):
        text = list(rng.choice(bases))
        for _ in range(rng.randrange(1 + len(text) // 15)):
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
        docs.append((d, rng.choice([" ", "\n", "  "]).join(text)))
    return docs + [(4, docs[9][1].lower()), (7, docs[7][1]), (None, docs[3][1]), (None, "only here without an id at all"), (n, ""), (n + 1, None), (n + 2, " \t\n"), (n + 3, "")]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    docs = fixture(seed)
    got = run(spark, docs)
    assert got == brute(docs)
    assert sum(not r[3] for r in got) > 20


def test_blocks_find_what_stars_miss(spark, monkeypatch):
    # A chain: only neighbours are linked, so stars around the smallest class cannot see them all.
    monkeypatch.setattr(N, "BLOCK", 8)
    base = [f"w{i}" for i in range(400)]
    docs = [(d, " ".join(base[d * 10 : d * 10 + 150])) for d in range(25)]
    assert run(spark, docs) == brute(docs)
    assert {r[2] for r in brute(docs)} == {0}


def test_blocks_across_sizes(spark, monkeypatch):
    # Each text holds the one before and a few words more: links lead through sizes of many layers.
    monkeypatch.setattr(N, "BLOCK", 4)
    base = [f"w{i}" for i in range(900)]
    docs = [(d, " ".join(base[: 40 + int(1.12**d * 8)])) for d in range(40)]
    assert run(spark, docs) == brute(docs)
    assert len({int(math.log(r[1], N.LAYER)) for r in brute(docs)}) > 6


def test_on_documents(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    docs = [(r[0], r[1]) for r in rows]
    assert run(spark, docs) == brute(docs)


def test_empty(spark):
    assert run(spark, []) == []


def test_nodes_sort_by_id(spark):
    ids = [-(2**63), -5, -1, 0, 1, 2**40, 2**63 - 1, None]
    df = spark.createDataFrame([(i, bytes([k])) for k, i in enumerate(ids)], "head long, digest binary")
    rows = df.withColumn("node", N._node(df["head"], df["digest"])).select("head", "node", N._head(N.F.col("node")).alias("back")).orderBy("node").collect()
    assert [r["head"] for r in rows] == ids == [r["back"] for r in rows]
