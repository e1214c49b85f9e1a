"""Every query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from gleanspark.catalog import base
from oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


def test_every_query_has_sql():
    """The queries of the optional package are tested in its own folder."""
    assert set(base.QUERIES) == set(base.ORACLES)
    assert set(entry.queries()) >= set(base.QUERIES)


def test_entry(spark):
    assert 0 < entry.entry(spark).count() <= 5


@pytest.mark.parametrize("name", list(base.QUERIES))
def test_query(spark, db, name):
    assert compare(spark, db, name, entry.queries()[name], entry.oracle_sql()[name], FOLDER) is None
