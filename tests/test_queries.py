import pytest

from lumenframe.plans import queries
from tests import oracle

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(DATA)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_its_sql(spark, con, name):
    assert oracle.check(spark, con, queries.QUERIES[name], queries.ORACLE_SQL[name], DATA) > 0
