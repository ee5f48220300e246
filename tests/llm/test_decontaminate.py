import random

import numpy as np
import pytest

from lumenframe.llm import decontaminate as D
from tests.llm.test_near_dedup import words

DATA = "/root/testdata/sf0.001"


def distance(pattern, text):
    """Least edit distance of ``pattern`` to any stretch of ``text``, by the plain table, a row at a time."""
    number = {}
    pattern, text = (np.array([number.setdefault(w, len(number)) for w in x], dtype=np.int64) for x in (pattern, text))
    steps = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, dtype=np.int64)
    for i, p in enumerate(pattern):
        new = np.append(i + 1, np.minimum(row[:-1] + (text != p), row[1:] + 1))
        # From the left each step costs one.
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


def brute(docs, items):
    out = []
    for d, text in docs:
        own = words(text)
        for i, item in items:
            p = words(item)
            if p and (e := distance(p, own)) <= int(D.RATIO * len(p)) and e < len(p):
                out.append((d, i, e, len(p)))
    return sorted(out, key=repr)


def run(spark, docs, items):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return sorted((tuple(r) for r in D.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()), key=repr)


def test_bit_parallel_distance():
    rng = random.Random(1)
    for _ in range(300):
        p, t = ([rng.choice("abcd") for _ in range(rng.randrange(1, 40))] for _ in range(2))
        index = D.Index([(0, " ".join(p))])
        hashes = D.Index([(0, " ".join(t))]).words[0].tolist()
        assert index.distance(0, hashes) == distance(p, t)


def test_exact_passages_of_all_lengths_are_found(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(2000)]
    items = [(n, " ".join(rng.choice(vocabulary) for _ in range(n))) for n in (1, 2, 3, 5, 8, 11, 16, 23, 40, 90, 200)]
    around = lambda: [rng.choice(["x", "y"]) for _ in range(rng.randrange(30))]
    docs = [(i, " ".join([*around(), t.upper(), *around()])) for i, t in items]
    got = run(spark, docs, items)
    assert {(i, i, 0, len(words(t))) for i, t in items} <= set(got)
    assert got == brute(docs, items)


def test_recall_of_edited_passages():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(15, 60)))) for i in range(150)]
    index, found, total = D.Index(items), 0, 0
    for i, item in items:
        own = words(item)
        for _ in range(rng.randrange(1, int(D.RATIO * len(own)) + 1)):
            at = rng.randrange(len(own))
            own[at : at + 1] = rng.choice([[], [rng.choice(vocabulary)], [own[at], rng.choice(vocabulary)]])
        around = [[rng.choice(vocabulary) for _ in range(rng.randrange(50))] for _ in range(2)]
        text = around[0] + own + around[1]
        if distance(words(item), text) <= int(D.RATIO * len(words(item))):
            total += 1
            found += i in {index.items[k][0] for k in index.leaks(D.pa.array([" ".join(text)]))[0]}
    assert total > 100
    assert found / total >= 0.9


def edited_recall(n, trials, kinds=("cut", "swap", "add"), rate=D.RATIO):
    """Share of passages of ``n`` words found after ``rate`` edits a word of these kinds."""
    rng = random.Random(n)
    vocabulary = [f"w{i}" for i in range(2000)]
    items, docs = [], []
    for i in range(trials):
        item = [rng.choice(vocabulary) for _ in range(n)]
        own = list(item)
        for _ in range(int(rate * n)):
            at = rng.randrange(len(own))
            own[at : at + 1] = {"cut": [], "swap": [rng.choice(vocabulary)], "add": [own[at], rng.choice(vocabulary)]}[rng.choice(kinds)]
        around = [[rng.choice(vocabulary) for _ in range(rng.randrange(20, 60))] for _ in range(2)]
        items.append((i, " ".join(item)))
        docs.append(" ".join(around[0] + own + around[1]))
    return sum(i in found for i, found in enumerate(D.Index(items).leaks(D.pa.array(docs)))) / trials


def test_recall_at_the_limit_around_class_edges():
    for n in (14, 23, 32, 39, 63, 64, 79, 143, 200):
        assert edited_recall(n, 60) >= 0.95, n


@pytest.mark.parametrize("kinds", [("cut",), ("swap",), ("add",), ("cut", "add")])
def test_recall_at_the_limit_by_kind_of_edit(kinds):
    for n in (5, 15, 32, 64, 79, 143, 300):
        assert edited_recall(n, 40, kinds) >= 0.95, n


def test_whole_item_after_a_piece_of_it_at_the_start():
    rng = random.Random(4)
    items = [(i, [f"w{rng.randrange(2000)}" for _ in range(20)]) for i in range(200)]
    docs = [" ".join([*t[6:14], *t, *(rng.choice("xy") for _ in range(30))]) for _, t in items]
    found = D.Index([(i, " ".join(t)) for i, t in items]).leaks(D.pa.array(docs))
    assert [x.get(i) for i, x in enumerate(found)] == [0] * len(items)


def test_prose_of_the_words_of_items_is_not_compared(monkeypatch):
    """The edit distance, a step of Python a word, is left to stretches that share runs of words with an item."""
    rng = random.Random(5)
    weights = [1 / (i + 1) for i in range(400)]
    prose = lambda n: rng.choices([f"w{i}" for i in range(400)], weights, k=n)
    items = [(i, " ".join(prose(rng.randrange(15, 60)))) for i in range(100)]
    index = D.Index(items)
    docs = [" ".join(prose(500)) for _ in range(60)] + [" ".join(prose(50) + words(t)[:-1] + prose(50)) for _, t in items[:10]]
    calls, distance = [], D.Index.distance
    monkeypatch.setattr(D.Index, "distance", lambda self, item, region: calls.append(item) or distance(self, item, region))
    found = index.leaks(D.pa.array(docs))
    assert [i in found[60 + i] for i in range(10)] == [True] * 10
    assert len(calls) < 200


def test_no_place_of_an_item_at_the_limit_is_left_out():
    """Edits that break the most runs: alone, as far apart as they can be; the place itself is given."""
    rng = random.Random(6)
    for n in (1, 2, 4, 5, 9, 10, 14, 15, 24, 25, 64, 200):
        for kind in ("cut", "swap", "add"):
            for few in (False, True):
                item = [rng.choice("abc") if few else f"w{rng.randrange(1000)}" for _ in range(n)]
                own, k = list(item), int(D.RATIO * n)
                for e in reversed(range(k)):
                    at = (2 * e + 1) * n // (2 * k)
                    own[at : at + 1] = {"cut": [], "swap": ["?"], "add": ["?", own[at]]}[kind]
                for before in (0, 40):
                    index = D.Index([(0, " ".join(item))])
                    index.candidates = lambda words, first, at=before: (np.array([0]), np.array([at]))
                    text = ["x"] * before + own + ["y"] * (before % 3)
                    assert index.leaks(D.pa.array([" ".join(text)])) == [{0: distance(item, text)}]


def test_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    docs.append((10**6, " ".join(t or "" for _, t in docs)))
    assert len(words(docs[-1][1])) > 10_000
    assert run(spark, docs, items) == brute(docs, items)


def test_odd_rows_and_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(D, "ITEMS", 2)
    item = "one two three four five six seven eight nine ten eleven twelve"
    items = [(1, item), (1, item), (2, ""), (3, None), (None, "null item with words in it"), (4, " \n ")]
    docs = [(None, item), (1, None), (2, ""), (3, item.replace(" ", "\n\t")), (3, item), (4, "one two"), (5, "x " * 3000 + item.upper())]
    assert run(spark, docs, items) == sorted([(None, 1, 0, 12), (3, 1, 0, 12), (3, 1, 0, 12), (5, 1, 0, 12)], key=repr)
    assert run(spark, docs, []) == [] and run(spark, [], items) == []


def test_columns_ride_along(spark):
    df = spark.createDataFrame([("a", "t", "l")], "item_id string, text string, leaks string")
    out = D.with_leaks(df, spark.createDataFrame([(1, "t")], "item_id long, text string"))
    assert out.columns == ["item_id", "text", "leaks"] and out.first()["leaks"][0]["item_id"] == 1


def test_any_names_and_several_blocks_in_one_worker_a_task(spark, monkeypatch):
    item = "one two three four five six seven eight nine ten eleven twelve"
    items = spark.createDataFrame([(i, item + f" thirteen{i}") for i in range(5)], "item_id long, text string")
    names = ["leaks_0", "row", "row_id", "a.b", "found", "item_id"]
    df = spark.createDataFrame([(1, item, *names), (2, None, *names), (1, item, *names)], ["doc_id", "text", *names])
    one = D.with_leaks(df, items)
    monkeypatch.setattr(D, "ITEMS", 2)
    many = D.with_leaks(df, items)
    assert one.columns == many.columns == [*df.columns, "leaks"]
    assert sorted(one.collect(), key=repr) == sorted(many.collect(), key=repr)
    assert sorted(len(r["leaks"]) for r in one.collect()) == [0, 5, 5]
    # Each pass over the rows holds one worker, whatever the number of blocks.
    for line in D.contaminated(df, items)._jdf.queryExecution().executedPlan().toString().split("Union")[-1].split("\n:- "):
        assert line.count("MapInArrow") <= 2
