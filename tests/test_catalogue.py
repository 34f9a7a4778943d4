import pytest

from tessera.plans import catalogue
from tests.compare import connect, same

NAMES = sorted(catalogue.queries())


def test_every_query_has_sql():
    assert set(catalogue.oracle_sql()) == set(NAMES)


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, sf, con, name):
    same(catalogue.queries()[name](spark, sf), con, catalogue.oracle_sql()[name])
