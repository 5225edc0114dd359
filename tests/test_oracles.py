import pytest

from stratalens import catalog
from tests.oracle import compare, connect

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, name, catalog.queries()[name], catalog.oracle_sql().get(name), SMALL) is None
