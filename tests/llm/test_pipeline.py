import hashlib

import pytest

import corpus_pipeline as P
from tests.llm import test_decontaminate as leaks
from tests.llm import test_near_dedup as near
from tests.llm import test_suffix_dedup as strings
from tests.llm.test_quality import brute as counts

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output rows of every stage, each written and read again."""
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "rows")
        stage(spark, docs, DATA).write.parquet(path)
        new = spark.read.parquet(path)
        out.append((docs.collect(), new.collect(), docs.columns, new.columns))
        docs = new
    return out


def test_columns(stages):
    for before, _, columns, new in stages[:-1]:
        assert columns == new and len({r["doc_id"] for r in before}) == len(before)


def test_quality(stages):
    before, after, *_ = stages[0]
    ids = {r["doc_id"] for r in after}
    for r in before:
        c = counts(r["text"])
        if c[0] < 10 or 100 * c[4] > 20 * c[0]:
            assert r["doc_id"] not in ids
    assert len(ids) > 0.7 * len(before) and {tuple(r) for r in after} <= {tuple(r) for r in before}


def test_near_dedup(stages):
    before, after, *_ = stages[1]
    want = {r[0] for r in near.brute([(r["doc_id"], r["text"]) for r in before]) if r[3]}
    assert {r["doc_id"] for r in after} == want and {tuple(r) for r in after} <= {tuple(r) for r in before}


def test_suffix_dedup(stages):
    before, after, *_ = stages[2]
    want = {r[0]: r for r in strings.brute([(r["doc_id"], r["text"]) for r in before], 50)}
    old = {r["doc_id"]: r for r in before}
    for r in after:
        d, n, removed, _, sha = want[r["doc_id"]]
        assert r["n_chars"] == (len(r["text"]) if removed else old[d]["n_chars"])
        if hashlib.sha256(r["text"].encode()).hexdigest() != sha:
            assert removed and 0 <= len(r["text"].encode()) - (n - removed) < 60
    assert len(after) == len(before)


def test_decontamination(stages):
    before, after, *_ = stages[3]
    items = P.SparkSession.getActiveSession().read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()
    every = [(r["doc_id"], r["text"]) for r in before]
    bad = {r[0] for r in leaks.brute(every, [tuple(i) for i in items])}
    assert {r["doc_id"] for r in after} == {d for d, _ in every} - bad


def test_tokens(stages):
    before, after, *_ = stages[4]
    texts = {r["doc_id"]: r["text"] for r in before}
    for r in after:
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, r["token_ids"])).encode()).hexdigest()
        assert r["n_tokens"] == len(r["token_ids"])
    assert len(after) == len(before)


def test_odd_rows_pass_through_all_stages(spark, tmp_path):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(1, good, "x", 5), (1, good, "x", 5), (None, good + " more", "y", None), (2, None, None, 0), (3, "", "z", 0), (4, "short", "z", 5)]
    schema = "doc_id long, text string, kept string, n_chars long"
    for own in (rows, []):
        sf = str(tmp_path / f"sf{len(own)}")
        spark.createDataFrame(own, schema).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        got = P.run(spark, sf).collect()
        assert [r["doc_id"] for r in got] == ([1] if own else [])
