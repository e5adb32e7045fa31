"""Every registered query against its SQL on the small tables."""

import pytest

import __spark_entry__ as entry
from compare import connect, difference
from labelkit.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def db(sf):
    return connect(sf)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf, db, name):
    ours = QUERIES[name](spark, sf).toPandas()
    assert len(ours)
    assert difference(ours, db.execute(ORACLES[name]).df()) is None


def test_entry(spark):
    assert entry.entry(spark).limit(5).count() == 5
