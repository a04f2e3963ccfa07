"""Every registered query against its SQL twin."""

import pytest

import __spark_entry__ as entry
from checks.compare import connect, differences

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_a_twin():
    assert set(entry.transit_queries()) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(entry.transit_queries()))
def test_same_as_sql(name, spark, duck):
    frame = entry.queries()[name](spark, SF_DIR)
    assert differences(frame, duck, entry.oracle_sql()[name]) == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0
