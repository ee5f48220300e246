import random
import re

import numpy as np
import pytest

from lumenframe.llm import quality as Q

DATA = "/root/testdata/sf0.01"


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    hit = set()
    for i, x in enumerate(windows):
        if windows.count(x) > 1:
            hit.update(range(i, i + 5))
    lines, dup, seen = text.split("\n"), 0, set()
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit))


def texts():
    rng = random.Random(1)
    out = [None, "", " \n\t", "one", "a b c d", "a b c d e", "é 中 #", "x\n x\nx\n\n\n", "a a a a a a a"]
    for _ in range(200):
        out.append("".join(rng.choice(["a ", "b ", "cc\n", "d\n", "é#", " ", "|", "\x0b"]) for _ in range(rng.randrange(60))))
    return out


def test_counts(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "n_words long, text string").withColumnRenamed("n_words", "id").repartition(3)
    got = {r["id"]: tuple(r[c] for c in Q.COUNTS) for r in Q.with_counts(df).collect()}
    assert got == {i: brute(t) for i, t in rows}


def test_learns_planted_rules():
    rng = np.random.default_rng(3)
    n = 3000
    x = {f: rng.random(n) for f in Q.FEATURES}
    y = ((x["symbols_per_word"] > 0.8) | ((x["chars_per_word"] <= 0.3) & (x["n_words"] > 0.6))).astype(int)
    rules = Q.learn(x, y)
    said = np.zeros(n, dtype=bool)
    for rule in rules:
        said |= Q._covers(rule, x, n)
    assert 2 <= len(rules) <= 6
    assert (said == (y == 1)).mean() > 0.98


def test_noise_gives_no_rules():
    rng = np.random.default_rng(4)
    x = {f: rng.random(2000) for f in Q.FEATURES}
    assert Q.learn(x, (rng.random(2000) < 0.2).astype(int)) == []
    assert Q.learn({f: v[:0] for f, v in x.items()}, np.zeros(0, dtype=int)) == []
    assert Q.learn(x, np.zeros(2000, dtype=int)) == []


def test_list_is_an_ordered_expression(spark):
    rules = [(Q.Term("symbols_per_word", True, 0.5), Q.Term("n_words", False, 20.0)), (Q.Term("chars_per_word", True, 9.0),)]
    rows = [(10, 50, 8, 0, 0), (30, 150, 30, 0, 0), (10, 120, 0, 0, 0), (0, 0, 0, 0, 0)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in Q.COUNTS))
    assert [r[0] for r in df.select(Q.verdict(rules)).collect()] == [False, True, False, True]
    assert [r[0] for r in df.select(Q.verdict([])).collect()] == [True] * 4


@pytest.fixture(scope="module")
def judged(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    rules = Q.fit(docs, labels)
    return rules, Q.judge(docs, rules).join(labels, "doc_id").select("quality", "kept", "base_failed").collect()


def test_agrees_with_labels(judged):
    rules, rows = judged
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert rules and sum(good) / len(good) > 0.97
    assert sum(bad) / len(bad) < 0.2


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "", "y"), (1, "word " * 9, "z"), (2, " ".join(f"w{i}" for i in range(50)), "k")], "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(1, None), (None, 0), (2, 1), (2, 1)], "doc_id long, quality int")
    rules = Q.fit(docs, labels)
    assert rules == []
    assert [r["kept"] for r in Q.judge(docs, rules).orderBy("n_words").collect()] == [False, False, False, True]
    assert Q.judge(docs.limit(0), Q.fit(docs.limit(0), labels.limit(0))).collect() == []
