import pytest

from lumenframe.llm import queries
from tests import oracle

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(DATA)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_its_sql(spark, con, name):
    assert oracle.check(spark, con, queries.QUERIES[name], queries.ORACLE_SQL[name], DATA) > 0


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_gives_whole_tables(spark, name):
    rows = queries.QUERIES[name](spark, DATA)
    assert "doc_id" in rows.columns
    if name != "op3_benchmark_passages":
        assert rows.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()


def test_ten_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
