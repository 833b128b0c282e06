"""Every catalogue query against its SQL statement, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from recallspark.plans.catalogue import QUERIES
from recallspark.plans.oracles import ORACLES
from tests.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys() <= entry.queries().keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    assert difference(entry.queries()[name](spark, FOLDER), con, entry.oracle_sql()[name]) is None


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(r.status == "READY" and r.prompt for r in rows)
