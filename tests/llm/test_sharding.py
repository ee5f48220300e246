import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from lumenframe.llm import sharding

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def checked(rows, got, shards):
    assert len(got) == len(rows)
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
    for own in slots.values():
        assert sorted(own) == list(range(len(own)))
    groups = defaultdict(set)
    for r in got:
        groups[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(len(s) == 1 for s in groups.values())
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    return [sizes[s] for s in range(shards)]


def test_documents_near_equal(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    sizes = checked(rows, sharding.shard_documents(df).collect(), 8)
    largest = max(len((t or "").encode()) + 1 for _, t, *_ in rows)
    assert max(sizes) - min(sizes) <= 2 * largest


def test_a_third_in_one_group_and_odd_rows(spark):
    rng = random.Random(4)
    rows = [(i, f"text {i} " * rng.randrange(1, 40), "en", f"src{i % 3}", 1) for i in range(400)]
    rows += [(1000 + i, "hot " * 30, None, "src0", 1) for i in range(400)]
    rows += [(None, "no id", None, None, None), (5, None, "en", None, 0), (6, "", "fr", "s", 0), (7, "same", "a", "b", 1), (7, "same", "a", "b", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    sizes = sorted(checked(rows, sharding.shard_documents(df).collect(), 8))
    total, hot = sum(sizes), 400 * 121
    assert sizes[-1] == hot
    assert max(sizes[:-1]) - min(sizes[:-1]) <= 700 and abs(sizes[0] - (total - hot) / 7) < 700


def test_equal_metadata_and_other_counts(spark):
    rows = [(1, f"t{i:03d}", "en", "s", 4) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    sizes = checked(rows, sharding.shard_documents(df, shards=6).collect(), 6)
    assert max(sizes) - min(sizes) <= 15
    sizes = checked(rows, sharding.shard_documents(df, target_bytes=500).collect(), 3)
    assert max(sizes) - min(sizes) <= 15


def test_few_and_no_rows(spark):
    assert sharding.shard_documents(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, "a", "en", "s", 1), (2, "b", "en", "s", 1)]
    checked(rows, sharding.shard_documents(spark.createDataFrame(rows, SCHEMA)).collect(), 8)


def brute(rows, shards):
    """{text: shard} by the plain recursion on one machine."""

    def name(x):
        h = xxhash.xxh64_intdigest((x or "").encode(), seed=42)
        return float(h - 2**64 if h >= 2**63 else h)

    by = defaultdict(list)
    for d, t, lang, source, _ in rows:
        size = len((t or "").encode()) + 1
        by[t or ""].append((size, None if d is None else float(d), name(lang), name(source)))
    groups = []
    for t, own in by.items():
        ids = [x[1] for x in own if x[1] is not None]
        point = (min(ids, default=0.0), float(own[0][0]), min(x[2] for x in own), min(x[3] for x in own))
        groups.append((hashlib.md5(t.encode()).hexdigest(), sum(x[0] for x in own), point, t))
    out, left, total = {}, shards, sum(g[1] for g in groups)
    for g in sorted(groups, key=lambda g: (-g[1], g[0])):
        if left == 1 or g[1] * left <= total:
            break
        out[g[3]], left, total = left - 1, left - 1, total - g[1]
    groups = [g for g in groups if g[3] not in out]
    width = [max(g[2][i] for g in groups) - min(g[2][i] for g in groups) or 1.0 for i in range(4)] if groups else []

    def cut(own, first, n):
        if n == 1 or not own:
            out.update({g[3]: first for g in own})
            return
        spans = [(max(g[2][i] for g in own) - min(g[2][i] for g in own)) / width[i] for i in range(4)]
        i = spans.index(max(spans))
        weight, below, sides = sum(g[1] for g in own), 0, ([], [])
        for g in sorted(own, key=lambda g: (g[2][i], g[0])):
            sides[2 * below + g[1] >= 2.0 * weight * (n // 2) / n].append(g)
            below += g[1]
        cut(sides[0], first, n // 2)
        cut(sides[1], first + n // 2, n - n // 2)

    cut(groups, 0, left)
    return out


@pytest.mark.parametrize("shards", [1, 5, 8, 100])
def test_the_tree_against_brute_force(spark, shards):
    rng = random.Random(shards)
    rows = [(rng.randrange(10_000), f"text {rng.randrange(300)} " * rng.randrange(1, 30), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", ""]), 1) for _ in range(500)]
    rows += [(20_000 + i, "hot " * 300, "en", "a", 1) for i in range(60)] + [(None, None, None, None, None), (3, "", "de", "a", 0), (3, "", "de", "a", 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sharding.shard_documents(df, shards=shards).collect()
    checked(rows, got, shards)
    want = Counter((d, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1, s) for (d, t, *_), s in ((r, brute_of[r[1] or ""]) for brute_of in [brute(rows, shards)] for r in rows))
    assert Counter((r["doc_id"], r["text_crc32"], r["size"], r["shard"]) for r in got) == want
